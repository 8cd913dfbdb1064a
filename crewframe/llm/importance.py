"""Target-distribution importance resampling on hashed runs of words."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crewframe.llm.base import query, read
from crewframe.session import cut, discard

BUCKETS = 10_000
#: words of a run at most, words a document needs to be drawn, draws in a hundred of those documents, key of the noise
RUN, LEAST_WORDS, PERCENT, SEED = 1, 20, 10, 2024
#: bytes of text that are searched by one pass
BATCH_BYTES = 8 << 20

# bytes: after A-Z are lowered a word is all that is not ASCII, or 0-9a-z
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: between the texts of a batch; no word holds it, so none crosses it
SENTINEL = b"\x00"


def batch_features(texts: list[str | None], run: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each feature, bucket of each feature, words of each document) of a batch, null texts as empty ones.

    The texts become one string with sentinels between them; one pass finds all words, and the documents' offsets tell
    by binary search whose they are.  A run of words counts where its first and last word are of one document.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = SENTINEL.join(raw).lower()
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + len(SENTINEL))
    spans = [m.span() for m in WORD.finditer(joined)] if run > 1 else []
    words = [joined[a:b] for a, b in spans] if run > 1 else WORD.findall(joined)
    if run > 1:
        starts = np.array([a for a, _ in spans], np.int64)
    else:  # each word's place follows from where the words and the rest lie
        starts = _word_starts(joined, len(words))
    owner = np.searchsorted(ends, starts, side="right")
    owners, found = [owner], [np.fromiter(map(zlib.crc32, words), np.int64, len(words))]
    for width in range(2, run + 1):
        first = np.flatnonzero(owner[width - 1 :] == owner[: len(owner) - width + 1]) if len(words) >= width else []
        hashed = (zlib.crc32(b" ".join(words[i : i + width])) for i in first)
        owners.append(owner[first] if len(first) else np.empty(0, np.int64))
        found.append(np.fromiter(hashed, np.int64, len(first)))
    counts = np.bincount(owner, minlength=len(raw)).astype(np.int64)
    return np.concatenate(owners), np.concatenate(found) % buckets, counts


#: per byte: part of a word
IN_WORD = np.array([bool(WORD.match(bytes([b]))) for b in range(256)])


def _word_starts(joined: bytes, n: int) -> np.ndarray:
    inside = IN_WORD[np.frombuffer(joined, np.uint8)]
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    starts = np.concatenate(([0], starts)) if len(inside) and inside[0] else starts
    assert len(starts) == n
    return starts


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Parts of a batch that hold about BATCH_BYTES each; a text is never cut."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += 4 * len(text or "")
        if held >= BATCH_BYTES:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def bucket_counts(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts of ``texts`` (text) fall into each bucket that has any.

    Tasks add up their batches and send one row for each bucket at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            listed = batch.column(0).to_pylist()
            for a, b in _slices(listed):
                held += np.bincount(batch_features(listed[a:b], run, buckets)[1], minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int64()), "n": pa.array(held[some], pa.int64())})

    made = texts.select(F.col("text").cast("string")).mapInArrow(count, "bucket long, n long")
    return made.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Gain of each bucket: floor(1000 ln((t+1)(S+B)/((s+1)(T+B)))) of two tables (bucket, n), one row a bucket."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(
        target.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t"))
    )
    rows = both.groupBy("bucket").agg(F.sum("s"), F.sum("t")).collect()  # a row for each bucket
    s, t = [0] * buckets, [0] * buckets
    for bucket, in_source, in_target in rows:
        s[bucket], t[bucket] = in_source, in_target
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return [math.floor(1000 * math.log(((b + 1.0) * all_s) / ((a + 1.0) * all_t))) for a, b in zip(s, t, strict=True)]


def with_weights(docs: DataFrame, gain: list[int], run: int = RUN) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of ``docs`` (doc_id, text)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(gain, np.int64)
        for batch in batches:
            listed = batch.column(1).to_pylist()
            for a, b in _slices(listed):
                owner, bucket, n_words = batch_features(listed[a:b], run, len(gain))
                weight = np.zeros(b - a, np.int64)
                np.add.at(weight, owner, table[bucket])
                features = np.bincount(owner, minlength=b - a)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(a, b - a), "n_words": pa.array(n_words),
                        "n_features": pa.array(features.astype(np.int64)), "weight": pa.array(weight),
                    }
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of SHA-256 of seed and id (a null id as an empty one)."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, percent: int = PERCENT,
    least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text), drawn towards ``target`` (text).

    Features are all runs of 1 to ``run`` words, hashed to ``buckets``; weights add up the log ratio of the target's
    and the documents' smoothed bucket shares, and scores add Gumbel noise, so the highest are a draw without
    replacement.  Of the rows with ``least_words`` words, ``percent`` in a hundred (rounded down) get a rank, ties to the smaller
    doc_id, null ids last; the others' rank is null.  Null and empty texts have no feature and the weight 0; repeated
    rows count and are drawn each; an empty target has no features and leaves equal shares.

    Ranks come from a sort over the cluster: tasks count their range, and ranges add what stands before them.
    """
    rows = docs.select("doc_id", "text")
    gain = gains(bucket_counts(rows, run, buckets), bucket_counts(target, run, buckets), buckets)
    weighed = with_weights(rows, gain, run)
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    last = F.when(F.col("n_words") >= least_words, F.col("score"))
    scored = scored.withColumn("at", -last).withColumn("row", F.monotonically_increasing_id())
    scored = cut(scored)  # texts are read once for this
    # the last key deals out rows that are alike
    order = [F.col("at").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranges = cut(scored.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    sizes = ranges.filter("at is not null").groupBy("range").agg(F.count("*").alias("n"))
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    before = sizes.select("range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    placed = ranges.withColumn("place", place).join(F.broadcast(before), "range", "left")  # a row per task
    rank = F.col("before") + F.col("place")
    drawn = F.col("at").isNotNull() & (rank <= F.floor(F.col("all") * percent / 100))
    out = placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, rank).alias("rank"))
    discard(docs.sparkSession, scored)
    return out


#: CRC-32 of a list of bytes, bit by bit, as a lambda over the list
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: "
    + "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))"
    + ", 4294967295)"
)


def _words_of(table: str, key: str) -> str:
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT {key} AS id, unnest(regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM {table}"


SQL = f"""
WITH d AS MATERIALIZED (SELECT id, word, count(*) AS k FROM ({_words_of("documents", "doc_id")}) GROUP BY ALL),
b AS MATERIALIZED ({_words_of("benchmark", "item_id")}),
v AS MATERIALIZED (
  SELECT word, {_CRC} % {BUCKETS} AS bucket FROM (
    SELECT word, list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::INT, 2))::BIGINT) AS bytes
    FROM (SELECT word FROM d UNION SELECT word FROM b))),
s AS (SELECT bucket, sum(k) AS s FROM d JOIN v USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM b JOIN v USING (word) GROUP BY 1),
c AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE + {BUCKETS} AS cs, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + {BUCKETS} AS ct),
g AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0)::DOUBLE + 1) * cs) / ((coalesce(s, 0)::DOUBLE + 1) * ct)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket), c),
w AS (SELECT id, sum(k)::BIGINT AS n_features, sum(k * gain)::BIGINT AS weight FROM d JOIN v USING (word) JOIN g USING (bucket) GROUP BY 1),
a AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN w ON doc_id = id),
r AS (
  SELECT *, n_features >= {LEAST_WORDS} AS long_enough,
    row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place FROM a)
SELECT doc_id, n_features, weight, score,
  CASE WHEN long_enough AND place <= (SELECT {PERCENT} * count(*) // 100 FROM r WHERE long_enough) THEN place END AS rank
FROM r
"""


@query("op12_importance", SQL)
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a tenth of them drawn towards the benchmark's texts."""
    docs, target = (read(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return resample(docs.select("doc_id", "text"), target.select("text"))
