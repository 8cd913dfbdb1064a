"""Drop repeated writes on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewframe.streaming.ordered import in_order


class _Keep:
    """Keep a write when the last kept one is at least ``ttl`` microseconds old."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def __call__(self, last, row):
        if last is None or row[0] - last[0] >= self.ttl:
            return row, (row[0], row[1])
        return last, None


def dedupe_mutations(
    stream: DataFrame, key: str, time: str, tie: str, ttl_seconds: float = 120.0, watermark: str = "10 minutes",
    succeeded: str | None = None, bucket_seconds: float = 60.0,
) -> DataFrame:
    """(key, time, tie) of the writes that count; failed writes are not remembered.

    Exact for any arrival order within the watermark.  State per key is the last kept write and
    the rows the watermark has not passed yet, in buckets of ``bucket_seconds``.
    """
    done = stream.filter(F.col(succeeded)) if succeeded else stream
    timed = done.withWatermark(time, watermark).select(
        F.col(key).cast("string").alias("key"), time, F.unix_micros(time).alias("at"), F.col(tie).cast("long").alias("tie")
    )
    kept = in_order(
        timed, ["key"], ["at", "tie"], "at long, tie long", ["kept_at", "kept_tie"],
        "key string, kept_at long, kept_tie long", _Keep(int(ttl_seconds * 1_000_000)), bucket_seconds,
    )
    return kept.select("key", F.timestamp_micros("kept_at").alias("kept_at"), F.col("kept_tie").alias("tie"))


def first_in_window(stream: DataFrame, keys: list[str], time: str, window: str = "120 seconds") -> DataFrame:
    """The cheaper built-in form: drops repeats while the first write is within the watermark.

    It forgets by the progress of the stream and not by the time of the write, so it may drop a
    write the exact form keeps.
    """
    return stream.withWatermark(time, window).dropDuplicatesWithinWatermark(keys)
