"""Drop repeated writes within a time to live, in batch.

A write of a key is kept when the last *kept* write of that key is at least ``ttl`` old; a dropped
repeat does not extend the time.  Failed writes are not remembered.

The rule reads one key's times in order, but no key is ever walked in one task:

1. A write with a gap of at least ``ttl`` before it is kept whatever came earlier.
2. After a kept time ``t`` the next kept time is the first one at or after ``t + ttl``.  That jump
   is found for all times at once, sorted over the cluster.
3. What the certain ones of step 1 reach by jumps is marked by doubling the jumps, so a run of
   n kept writes takes log2(n) rounds.  Repeats that all end within one ``ttl`` need none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewframe.operators.sequences import nearest_marks, reached, successive_pairs
from crewframe.session import cut, discard


def _jumps(times: DataFrame, keys: list[str], ttl: int) -> DataFrame:
    """(keys, t, nxt): the first time at or after ``t + ttl`` microseconds."""
    asks = times.select(*keys, (F.col("t") + ttl).alias("at"), F.col("t"))
    found = nearest_marks(times.select(*keys, F.col("t").alias("at")), asks, keys, "at")
    return found.select(*keys, "t", F.col("mark.at").alias("nxt"))


def kept_times(times: DataFrame, keys: list[str], ttl_micros: int) -> DataFrame:
    """(keys, t) of the kept writes among distinct times in microseconds."""
    spark = times.sparkSession
    times = cut(times)
    stamped = times.withColumns({"at": F.timestamp_micros("t"), "tie": F.lit(0)})
    pairs = successive_pairs(stamped.select(*keys, "at", "tie"), keys, "at", "tie")
    apart = F.unix_micros(F.col("cur")["at"]) - F.unix_micros(F.col("prev")["at"])
    close = pairs.filter(apart < ttl_micros).select(*keys, F.unix_micros(F.col("cur")["at"]).alias("t"))
    # only keys with some close pair need more than step 1
    follows = cut(close)
    certain = times.join(follows, [*keys, "t"], "left_anti")
    if follows.isEmpty():
        return certain
    busy = follows.select(*keys).distinct()
    steps = _jumps(times.join(busy, keys, "left_semi"), keys, ttl_micros)
    # jumps onto a certain time add nothing
    steps = steps.join(follows.withColumnRenamed("t", "nxt"), [*keys, "nxt"], "left_semi")
    kept = reached(certain, steps, keys)
    discard(spark, times, follows)
    return kept


def dedupe_mutations(
    df: DataFrame, keys: list[str], time: str, tie: str, ttl_seconds: float = 120.0, succeeded: str | None = None
) -> DataFrame:
    """Rows whose write counts; of several at one instant the first by ``tie``."""
    done = df.filter(F.col(succeeded)) if succeeded else df
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    rows = done.withColumn("_t", micros)
    others = [c for c in df.columns if c not in keys]
    # equal instants collapse on the map side
    first = rows.groupBy(*keys, F.col("_t").alias("t")).agg(F.min_by(F.struct(*others), tie).alias("_row"))
    kept = kept_times(rows.select(*keys, F.col("_t").alias("t")).distinct(), keys, int(ttl_seconds * 1_000_000))
    return first.join(kept, [*keys, "t"], "left_semi").select(*keys, "_row.*")
