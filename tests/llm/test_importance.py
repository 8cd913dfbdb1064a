import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from helpers import ODD, documents, prose

from crewframe.llm import importance as im


def features(text, run):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    runs = [" ".join(words[i : i + w]) for w in range(1, run + 1) for i in range(len(words) - w + 1)]
    return len(words), [zlib.crc32(r.encode()) % im.BUCKETS for r in runs]


def brute(docs, target, run=1, percent=10, least=20):
    found = [(i, *features(t, run)) for i, t in docs]
    s = Counter(b for _, _, f in found for b in f)
    t = Counter(b for text in target for b in features(text, run)[1])
    n_s, n_t = sum(s.values()) + im.BUCKETS, sum(t.values()) + im.BUCKETS
    rows = []
    for i, n, f in found:
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * n_s / ((s[b] + 1.0) * n_t))) for b in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    long = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    out = [(i, n, w, sc, None) for i, _, n, w, sc in rows]
    k = percent * len(long) // 100
    for place, (i, _, n, w, sc) in enumerate(long[:k], 1):
        out.remove((i, n, w, sc, None))
        out.append((i, n, w, sc, place))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("run", [1, 2, 3])
def test_equals_brute_force(spark, run, monkeypatch):
    monkeypatch.setattr(im, "BATCH_BYTES", 4_000)
    docs = [(i, prose(i % 150, 10 + i % 40)) for i in range(300)] + [(1000, "ÄB-ä\x00b İx\x7fy 数1 ' '" * 9)]
    target = [prose(i, 25) for i in range(0, 60, 7)] + [None, ""]
    made = im.resample(documents(spark, docs), spark.createDataFrame([(t,) for t in target], "text string"), run=run, percent=35)
    assert got(made) == brute(docs, target, run, 35)


def test_ties_and_repeated_rows(spark):
    docs = [(7, prose(1, 30))] * 900 + [(8, prose(1, 30))] * 2 + [(None, prose(2, 30))] * 3
    made = im.resample(documents(spark, docs), spark.createDataFrame([(prose(1, 30),)], "text string"), percent=50)
    assert got(made) == brute(docs, [prose(1, 30)], percent=50)


def test_words_of_two_documents_are_no_run():
    owner, bucket, words = im.batch_features(["a b", None, "", "c", "d e"], 2, 1 << 20)
    assert words.tolist() == [2, 0, 0, 1, 2]
    wanted = Counter((d, zlib.crc32(w) % (1 << 20)) for d, w in [(0, b"a"), (0, b"b"), (0, b"a b"), (3, b"c"), (4, b"d"), (4, b"e"), (4, b"d e")])
    assert Counter(zip(owner.tolist(), bucket.tolist(), strict=True)) == wanted


def test_odd_rows_and_empty_tables(spark):
    empty = spark.createDataFrame([], "text string")
    made = im.resample(documents(spark, ODD, extra=True), empty, percent=100)
    assert got(made) == brute(ODD, [], percent=100)
    assert im.resample(documents(spark, []), spark.createDataFrame([("x",)], "text string")).collect() == []
    assert got(im.resample(documents(spark, [(1, None)]), empty)) == brute([(1, None)], [])
