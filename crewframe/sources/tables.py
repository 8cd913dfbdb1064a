"""Append-only logs read as latest-per-key, and the canonical table writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_upsert(df: DataFrame, path: str) -> None:
    """Append new versions of keys to a Parquet log."""
    df.write.mode("append").parquet(path)


def latest_by_key(
    log: DataFrame, keys: list[str], as_of: Column, updated_at: str = "updated_at", tie: str | None = None,
    hide_expired: bool = True,
) -> DataFrame:
    """Last write per key, hidden when that write has expired by ``as_of``.

    A combining ``max_by`` instead of a window: a key written very often is one buffer per task.
    """
    others = [c for c in log.columns if c not in keys]
    order = F.struct(updated_at, tie) if tie else F.col(updated_at)
    latest = log.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_row"))
    rows = latest.select(*keys, "_row.*")
    if hide_expired and "expires_at" in others:
        rows = rows.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= as_of))
    return rows


def write_canonical(df: DataFrame, path: str, mode: str = "append") -> None:
    """Persist canonical rows partitioned by tenant and entity, so readers prune by folder.

    Rows are first rebalanced by folder: a small tenant gives one file, a big one as many as its size asks for.
    """
    (
        df.withColumn("entity_type", F.col("source_ref.entity_type"))
        .hint("rebalance", "tenant_id", "entity_type")
        .write.mode(mode)
        .partitionBy("tenant_id", "entity_type")
        .parquet(path)
    )


# --------------------------------------------------------------------------- compaction
# A log lives in one folder: ``log`` holds the appended files, ``base/version=n`` the compacted rows and
# ``covered/version=n`` the names of the appended files that are in it.  A base counts from its success mark on.


def append_log(df: DataFrame, path: str) -> None:
    """Append new versions of keys to a log that :func:`compact_log` may compact."""
    append_upsert(df, f"{path}/log")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete bases, oldest first."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/base/version=*/_SUCCESS")
    marks = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found) or []
    return sorted(int(m.getPath().getParent().getName().removeprefix("version=")) for m in marks)


def _appended(spark: SparkSession, path: str) -> dict[str, str]:
    """Appended files by name; one entry for a file, not for a row."""
    return {name.rsplit("/", 1)[1]: name for name in spark.read.parquet(f"{path}/log").inputFiles()}


def _open_files(spark: SparkSession, path: str, version: int | None) -> list[str]:
    files = _appended(spark, path)
    if version is not None:
        for row in spark.read.parquet(f"{path}/covered/version={version}").collect():
            files.pop(row["name"], None)
    return sorted(files.values())


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The newest base and what was appended since: rows for :func:`latest_by_key`, with the same result as the whole log."""
    versions = _versions(spark, path)
    if not versions:
        return spark.read.parquet(f"{path}/log")
    base = spark.read.parquet(f"{path}/base/version={versions[-1]}")
    files = _open_files(spark, path, versions[-1])
    return base.unionByName(spark.read.schema(base.schema).parquet(*files)) if files else base


def compact_log(
    spark: SparkSession, path: str, keys: list[str], updated_at: str = "updated_at", tie: str | None = None,
    forget_before: Column | None = None,
) -> int | None:
    """Write a new base with the last write of each key, and give its version.

    Readers go on with the base before until the new one is complete, and a run that fails leaves nothing that counts.
    Without new files nothing is written, so running it again changes nothing.  An expired write stays, for it hides older
    ones that may still arrive; with ``forget_before`` writes that expired before then go: no write older than
    that may arrive any more.
    """
    versions = _versions(spark, path)
    last = versions[-1] if versions else None
    files = _open_files(spark, path, last)
    if not files:
        return last
    fresh = spark.read.parquet(*files)
    rows = fresh if last is None else spark.read.parquet(f"{path}/base/version={last}").unionByName(fresh)
    kept = latest_by_key(rows, keys, F.lit(None).cast("timestamp"), updated_at, tie, hide_expired=False)
    if forget_before is not None:
        kept = kept.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= forget_before))
    version = 1 if last is None else last + 1
    covered = spark.createDataFrame([(f.rsplit("/", 1)[1],) for f in files], "name string")
    if last is not None:
        covered = covered.unionByName(spark.read.parquet(f"{path}/covered/version={last}"))
    covered.coalesce(1).write.mode("overwrite").parquet(f"{path}/covered/version={version}")
    kept.select(rows.columns).write.mode("overwrite").parquet(f"{path}/base/version={version}")
    return version
