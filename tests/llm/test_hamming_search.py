import random

import pytest
from pyspark.sql import functions as F

from crewframe.llm import hamming_search as hs


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(rows, k, every):
    rows = sorted({(i, c) for i, c in rows if i is not None})
    out = []
    for q, code in rows:
        if q % every == 0:
            near = sorted(((code ^ c) & (2**64 - 1)).bit_count() * 10**9 + i for i, c in rows if i != q)[:k]
            out += [(q, n + 1, x % 10**9, x // 10**9) for n, x in enumerate(near)]
    return sorted(out)


def test_equals_brute_force_with_ties_and_a_common_code(spark):
    draw = random.Random(2)
    centres = [draw.getrandbits(64) for _ in range(4)]
    codes = [centres[i % 4] ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(20))) for i in range(300)]
    rows = [(i, signed(c)) for i, c in enumerate(codes)] + [(1000 + i, signed(centres[0])) for i in range(200)]
    rows += [(5, signed(codes[5])), (None, 7)]
    got = hs.top_k(spark.createDataFrame(rows, "id long, code long"), k=7, every=10)
    assert sorted(map(tuple, got.collect())) == brute(rows, 7, 10)


def test_far_codes_and_few_rows(spark):
    rows = [(0, 0), (1, -1), (2, signed(0xFFFF0000FFFF0000)), (50, 1)]
    got = hs.top_k(spark.createDataFrame(rows, "id long, code long"))
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 50)


def test_empty(spark):
    assert hs.top_k(spark.createDataFrame([], "id long, code long")).collect() == []


def test_sign_code(spark):
    vectors = [([1.0] * 63 + [2.0],), ([-1.0] * 64,), (None,), ([float("nan"), 1.0],), ([0.0, None, 3.0],)]
    got = [r[0] for r in spark.createDataFrame(vectors, "v array<float>").select(hs.sign_code(F.col("v"))).collect()]
    assert got == [-1, 0, 0, 2, 4]


def test_longer_vectors_are_an_error(spark):
    vectors = spark.createDataFrame([([1.0] * 65,)], "v array<float>")
    with pytest.raises(Exception, match="65 components, a code holds 64"):
        vectors.select(hs.sign_code(F.col("v"))).collect()
