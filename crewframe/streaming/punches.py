"""Travel alerts and worked hours from a stream of punches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewframe.operators.attendance import TRAVEL_FIELDS, hours_by_day, session_ends, travel_columns, with_open_shifts
from crewframe.streaming.ordered import in_order

_KEYS = ["tenant_id", "employee_id"]


def _pair_places(last, row):
    """Every located row against the one before it."""
    made = None if last is None else (*last, *row)
    return row, made


def travel_alerts(
    stream: DataFrame, watermark: str = "1 day", max_kmh: float = 850.0, bucket_seconds: float = 3600.0
) -> DataFrame:
    """Successive punches of an employee with distance, speed and verdict; the batch twin is
    ``impossible_travel``."""
    located = stream.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    timed = located.withWatermark("ts", watermark).withColumn("at", F.unix_micros("ts"))
    names = ["at", "punch_id", "lat", "lng"]
    both = [f"p_{n}" for n in names] + [f"c_{n}" for n in names]
    kinds = "at long, punch_id long, lat double, lng double"
    out = "tenant_id string, employee_id long, " + ", ".join(
        f"{side}_{part}" for side in ("p", "c") for part in kinds.split(", ")
    )
    pairs = in_order(timed.select(*_KEYS, "ts", *names), _KEYS, names, kinds, both, out, _pair_places, bucket_seconds)
    punch = lambda side: F.struct(
        F.timestamp_micros(f"{side}_at").alias("ts"), F.col(f"{side}_lat").alias("lat"), F.col(f"{side}_lng").alias("lng")
    )
    shaped = pairs.select(*_KEYS, F.col("c_punch_id").alias("punch_id"), punch("p").alias("prev"), punch("c").alias("cur"))
    return travel_columns(shaped, max_kmh).select(*_KEYS, "punch_id", *TRAVEL_FIELDS)


def _pair_shift(last, row):
    """An OUT punch directly after an IN punch ends a shift."""
    made = (last[0], row[0]) if last is not None and last[2] == "IN" and row[2] == "OUT" else None
    return row, made


def shifts(stream: DataFrame, watermark: str = "1 day", bucket_seconds: float = 3600.0) -> DataFrame:
    """(tenant_id, employee_id, in_ts, out_ts) of finished shifts."""
    timed = stream.withWatermark("ts", watermark).withColumn("at", F.unix_micros("ts"))
    names = ["at", "punch_id", "punch_type"]
    found = in_order(
        timed.select(*_KEYS, "ts", *names), _KEYS, names, "at long, punch_id long, punch_type string",
        ["in_at", "out_at"], "tenant_id string, employee_id long, in_at long, out_at long", _pair_shift, bucket_seconds,
    )
    return found.select(*_KEYS, F.timestamp_micros("in_at").alias("in_ts"), F.timestamp_micros("out_at").alias("out_ts"))


def hours_from_shifts(table: DataFrame) -> DataFrame:
    """Daily hours over the appended shift table.  A shift may end a day after it began, so the
    sum is taken when read instead of being closed by a window."""
    return hours_by_day(table)


def sessions(stream: DataFrame, gap_seconds: int = 43_200, watermark: str = "1 day") -> DataFrame:
    """Sessions of an employee's punches, one row when the watermark has passed the gap after the last punch.

    Built-in session windows: state is one small row per open session, and punches of a session combine before the shuffle.
    """
    return session_ends(stream.withWatermark("ts", watermark), gap_seconds)


def open_shifts(sessions_table: DataFrame, shifts_table: DataFrame, gap_seconds: int = 43_200) -> DataFrame:
    """Sessions whose last punch is IN, with the finished shifts that began in them; the batch twin is
    :func:`crewframe.operators.attendance.open_shifts`."""
    return with_open_shifts(sessions_table, shifts_table, gap_seconds)
