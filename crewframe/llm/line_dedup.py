"""Lines that many documents share, found with levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crewframe.llm.base import SPACE, ascii_lower, query, read, row_key, text_key
from crewframe.session import cut, discard, scratch

HASHES = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    """Lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    return F.transform(lines_of(text), lambda line: ascii_lower(F.btrim(line, F.lit(SPACE))))


def hashed(key: Column) -> list[Column]:
    """128 bits of a key, so that keys of 100 TB do not meet by chance."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def key_counts(docs: DataFrame, text: str, min_chars: int, *by: Column) -> DataFrame:
    """(h1, h2, n_docs): in how many rows of ``docs`` a key stands.  Hot lines combine before the shuffle."""
    keys = docs.select(*by, F.explode(F.array_distinct(line_keys(F.col(text)))).alias("key"))
    names = keys.columns[:-1]
    keys = keys.filter(F.char_length("key") >= min_chars).select(*names, *hashed(F.col("key")))
    return keys.groupBy(*names, *HASHES).agg(F.count("*").alias("n_docs"))


class LineRuns:
    """Counts of line hashes as levelled runs, each a table bucketed and sorted by the hash.

    A batch merge-anti-joins the run of settled keys (those that have reached ``min_docs``, whose count no
    longer matters) and adds what is left as a run of level 0.  ``fanout`` runs of a level are compacted
    into one of the next level; keys that reach ``min_docs`` then move to the settled run.  Equal bucketing
    makes the anti-join a merge of sorted files without a shuffle.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.settled: str | None = None
        self.tables: dict[str, str] = {}

    def _store(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex[:12]}"
        self.tables[name] = scratch(self.spark, "line-run")
        (
            run.repartition(self.buckets, *HASHES).write.format("parquet").option("path", self.tables[name])
            .bucketBy(self.buckets, *HASHES).sortBy(*HASHES).saveAsTable(name)
        )
        return name

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            discard(self.spark, self.tables.pop(name))

    def add(self, counts: DataFrame) -> None:
        """Take a batch of (h1, h2, n_docs), each hash once."""
        if self.settled:
            counts = counts.join(self.spark.table(self.settled), HASHES, "left_anti")
        self.levels[0].append(self._store(counts.select(*HASHES, "n_docs")))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _plain(self, *names: str) -> DataFrame:
        """Rows of runs, read as files: a union of bucketed scans claims a partitioning that it does not have."""
        schema = self.spark.table(names[0]).schema
        return self.spark.read.schema(schema).parquet(*[self.tables[name] for name in names])

    def _merged(self, names: list[str]) -> DataFrame:
        return self._plain(*names).groupBy(*HASHES).agg(F.sum("n_docs").alias("n_docs"))

    def _compact(self, level: int) -> None:
        runs, self.levels[level] = self.levels[level], []
        if level + 1 == len(self.levels):
            self.levels.append([])
        merged = cut(self._merged(runs))
        self.levels[level + 1].append(self._store(merged.filter(F.col("n_docs") < self.min_docs)))
        risen = merged.filter(F.col("n_docs") >= self.min_docs).select(*HASHES)
        old = [self.settled] if self.settled else []
        self.settled = self._store((risen.unionByName(self._plain(*old)) if old else risen).distinct())
        discard(self.spark, merged)
        self._drop(*runs, *old)

    def frequent(self) -> DataFrame:
        """Every key found in ``min_docs`` documents or more, as a stored table (h1, h2); drops the runs."""
        parts = [self._plain(self.settled)] if self.settled else []
        if runs := [name for level in self.levels for name in level]:
            parts.append(self._merged(runs).filter(F.col("n_docs") >= self.min_docs).select(*HASHES))
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        stored = cut(found.distinct())
        self._drop(*list(self.tables))
        return stored


def frequent_lines(docs: DataFrame, text: str, min_docs: int, min_chars: int, batches: int) -> DataFrame:
    """Keys of at least ``min_docs`` rows, gathered batch by batch.

    The rows are read once: all batches are counted in one job and stored by batch.
    """
    batch = F.pmod(F.xxhash64(text), F.lit(batches)).cast("int").alias("batch")
    counts = cut(key_counts(docs, text, min_chars, batch), "batch")
    runs = LineRuns(docs.sparkSession, min_docs)
    for number in range(batches):
        runs.add(counts.filter(F.col("batch") == number).drop("batch"))
    found = runs.frequent()
    discard(docs.sparkSession, counts)
    return found


def drop_shared_lines(
    docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 4
) -> DataFrame:
    """``docs`` with ``text`` less every line whose key stands in ``min_docs`` rows; adds ``n_lines``, ``n_dropped``.

    A key is the line without white space at its ends, A-Z in lower case; keys shorter than ``min_chars`` stay.
    Each row counts as a document of its own, also a repeated one.  A null or empty text is one empty line and
    stays empty (a null becomes empty).  No rows: no rows.  Other columns pass through whatever their names,
    but ``n_lines`` and ``n_dropped`` are replaced.
    """
    shared = frequent_lines(docs.select(text), text, min_docs, min_chars, batches)
    key = F.struct(row_key(docs).alias("row"), *text_key(F.col(text)))  # copies under other ids go to other tasks
    lines = docs.select(key.alias("t"), F.posexplode(line_keys(F.col(text))).alias("p", "k"))
    hit = lines.select("t", "p", *hashed(F.col("k"))).join(shared, HASHES, "left_semi")
    gone = hit.groupBy("t").agg(F.collect_set("p").alias("gone"))
    packed = docs.select(F.struct("*").alias("all"), key.alias("t"), F.col(text).alias("text"), lines_of(F.col(text)).alias("lines"))
    cleaned = _without(packed.join(gone, "t", "left"))
    kept = {text: "text", "n_lines": "n_lines", "n_dropped": "n_dropped"}
    others = [F.col("all").getField(c).alias(c) if c not in kept else F.col(kept[c]).alias(c) for c in docs.columns]
    return cleaned.select(*others, *[c for c in ("n_lines", "n_dropped") if c not in docs.columns])


def _without(joined: DataFrame) -> DataFrame:
    """Lines at the places in ``gone`` leave; places are looked up by a hash set, not a scan per line."""
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(
        F.array_join(F.transform(stay, lambda at: F.get("lines", at)), "\n")
    )
    dropped = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    return joined.select("all", kept.alias("text"), F.size("lines").cast("long").alias("n_lines"), dropped.alias("n_dropped"))


SQL = r"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM split
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), shared AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10
), marked AS (
  SELECT keyed.*, shared.k IS NOT NULL AS gone FROM keyed LEFT JOIN shared USING (k)
)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""


@query("op4_line_dedup", SQL)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dropped from each document and the digest of what stays."""
    kept = drop_shared_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
