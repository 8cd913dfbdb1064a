import math
from collections import Counter, defaultdict

import pytest
from helpers import ODD, documents, prose, words

from crewframe.llm import mixing as mx

SHAPE = "doc_id long, source string, text string"


def corpus(spark, sizes=(60, 30, 10, 3)):
    rows = [(s * 1000 + i, f"s{s}", prose(s * 1000 + i, 20 + i % 7)) for s, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, SHAPE).repartition(4), rows


def entropy(shares):
    return -sum(p * math.log(p) for p in shares if p)


@pytest.mark.parametrize("target", [mx.Target(entropy=0.9, repeats=50), mx.Target(entropy=0.97, repeats=3.0), mx.Target(entropy=None, repeats=2.0, budget=2.0)])
def test_exponent_is_the_smallest_that_will_do(spark, target):
    sizes = {"a": 5000, "b": 2000, "c": 400, "d": 50}
    a = mx.exponent(spark.createDataFrame(list(sizes.items()), "source string, tokens long"), target)

    def good(x):
        powers = {k: (n / sum(sizes.values())) ** x for k, n in sizes.items()}
        w = {k: v / sum(powers.values()) for k, v in powers.items()}
        most = max(target.budget * w[k] * sum(sizes.values()) / n for k, n in sizes.items())
        return most <= target.repeats and (target.entropy is None or entropy(w.values()) <= target.entropy * math.log(4))

    assert a == 1.0 or good(a + 1e-6)
    assert a == 0.0 or not good(a - 1e-6)


def test_schedule(spark):
    docs, rows = corpus(spark)
    target = mx.Target(entropy=0.9, repeats=10, block_tokens=200)
    got = mx.mixture(docs, target).collect()
    length = {i: len(words(t)) for i, _, t in rows}
    held = defaultdict(int)
    for i, s, _ in rows:
        held[s] += length[i]
    total = sum(held.values())
    served = defaultdict(int)
    for r in got:
        assert r.n_tokens == length[r.doc_id]
        served[r.source] += r.n_tokens
    sizes = spark.createDataFrame(list(held.items()), "source string, tokens long")
    for r in mx.weights(sizes, target).collect():
        assert r.quota <= served[r.source] < r.quota + 27  # beyond the quota by less than a document
        passes = Counter(x.doc_id for x in got if x.source == r.source)
        assert max(passes.values()) - min([*passes.values(), 0] if len(passes) < len([1 for _, s, _ in rows if s == r.source]) else passes.values()) <= 1
    assert abs(sum(served.values()) - total) < 4 * 27
    # a pass serves no document twice, and every block has its places 1, 2, ...
    assert len({(r.doc_id, r.epoch) for r in got}) == len(got)
    blocks = defaultdict(list)
    for r in got:
        blocks[r.block].append(r.position)
    assert sorted(blocks) == list(range(math.ceil(total / 200)))
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in blocks.values())
    # and every block the weights of the whole, up to a document of each source
    for b in blocks:
        for s in held:
            part = sum(r.n_tokens for r in got if r.block == b and r.source == s)
            assert abs(part - served[s] / len(blocks)) < 2 * 27


def test_same_whatever_the_partitions(spark):
    docs, _ = corpus(spark)
    rows = lambda df: sorted(map(tuple, mx.mixture(df).collect()))
    assert rows(docs) == rows(docs.coalesce(1))


def test_odd_rows(spark):
    df = documents(spark, ODD, extra=True)
    got = mx.mixture(df, mx.Target(entropy=None, repeats=1.0)).collect()
    assert got and all(r.n_tokens is not None for r in got)
    nulls = df.withColumn("source", df.nothing.cast("string"))
    assert {r.source for r in mx.mixture(nulls).collect()} == {""}
    assert mx.mixture(documents(spark, [])).collect() == []
    assert mx.mixture(documents(spark, [(1, None), (2, "")])).collect() == []
