"""Leave decisions, impossible travel and hours worked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewframe.functions.geo import haversine_km
from crewframe.operators.findings import text
from crewframe.operators.sequences import successive_pairs

# The texts of leave decisions and alerts below must read exactly so.

# Leave types a probationer may not take beyond the balance.
PROBATION_TYPES = ["ANNUAL", "PRIVILEGE", "CASUAL"]


def evaluate_leave(df: DataFrame) -> DataFrame:
    """Approve or reject leave: requested_days, current_balance, on_probation, allow_negative."""
    wanted, left = F.col("requested_days"), F.col("current_balance")
    probation = F.coalesce(F.col("on_probation"), F.lit(False)) & F.upper(F.col("leave_type")).isin(PROBATION_TYPES)
    short = left < wanted
    negative_ok = F.coalesce(F.col("allow_negative"), F.lit(False))
    after = F.round(left - wanted, 2)

    def verdict(approved: bool, remaining: Column, reason: Column | None, override: bool) -> Column:
        return F.struct(
            F.lit(approved).alias("is_approved"),
            remaining.alias("remaining_balance"),
            (F.lit(None).cast("string") if reason is None else reason).alias("rejection_reason"),
            F.lit(override).alias("requires_manager_override"),
        )

    outcome = (
        F.when(wanted <= 0, verdict(False, left, F.lit("Requested leave days must be greater than 0."), False))
        .when(
            probation & short,
            verdict(
                False, left, F.lit("Insufficient balance and employee is currently in probationary status."), True
            ),
        )
        .when(~short, verdict(True, after, None, False))
        .when(negative_ok, verdict(True, after, None, True))
        .otherwise(
            verdict(
                False, left,
                text("Insufficient balance: requested ", wanted, " days but only ", left, " days available."), False,
            )
        )
    )
    return df.withColumn("_verdict", outcome).select(*df.columns, "_verdict.*")


def leave_requests_with_balance(requests: DataFrame, balances: DataFrame, employees: DataFrame) -> DataFrame:
    """Bring balance and probation flag to each request; a missing balance is zero."""
    return (
        requests.join(balances, ["tenant_id", "employee_id", "leave_type"], "left")
        .join(employees.select("tenant_id", "employee_id", "on_probation"), ["tenant_id", "employee_id"], "left")
        .withColumn("current_balance", F.coalesce(F.col("current_balance"), F.lit(0.0)))
    )


def travel_columns(df: DataFrame, max_kmh: float = 850.0) -> DataFrame:
    """Distance, hours, speed and verdict for rows holding ``prev`` and ``cur`` punches."""
    prev, cur = F.col("prev"), F.col("cur")
    seconds = F.abs(F.unix_micros(cur["ts"]) - F.unix_micros(prev["ts"])) / F.lit(1_000_000.0)
    km, hours = F.col("_km"), F.col("_hours")
    speed = F.when(hours == 0, F.when(km > 0.1, F.lit(999999.0)).otherwise(F.lit(0.0))).otherwise(km / hours)
    anomaly = F.coalesce((km > 5.0) & (F.col("_speed") > max_kmh), F.lit(False))
    one = lambda c: F.format_string("%.1f", c)
    return (
        df.withColumns(
            {
                "_km": haversine_km(prev["lat"], prev["lng"], cur["lat"], cur["lng"]),
                "_hours": seconds / F.lit(3600.0),
            }
        )
        .withColumn("_speed", speed)
        .withColumns(
            {
                "is_anomaly": anomaly,
                "speed_kmh": F.round("_speed", 2),
                "distance_km": F.round("_km", 2),
                "time_delta_hours": F.round("_hours", 2),
                "explanation": F.when(
                    anomaly,
                    text(
                        "Impossible travel detected: ", one(km), " km traversed in ", F.format_string("%.2f", hours),
                        " hours (", one(F.col("_speed")),
                        f" km/h), exceeding maximum realistic transit threshold of {max_kmh} km/h.",
                    ),
                ).otherwise(
                    text(
                        "Travel speed of ", one(F.col("_speed")), " km/h across ", one(km),
                        " km is within physically plausible parameters.",
                    )
                ),
                "first_punch_time": prev["ts"],
                "second_punch_time": cur["ts"],
            }
        )
    )


TRAVEL_FIELDS = [
    "is_anomaly", "speed_kmh", "distance_km", "time_delta_hours", "explanation", "first_punch_time",
    "second_punch_time",
]


def impossible_travel(punches: DataFrame, max_kmh: float = 850.0) -> DataFrame:
    """Compare every punch with the one before it.

    ``punches``: tenant_id, employee_id, punch_id, ts, lat, lng.  A punch without coordinates or
    time is not evaluated.
    """
    located = punches.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select(
        "tenant_id", "employee_id", "ts", "punch_id", "lat", "lng"
    )
    pairs = successive_pairs(located, ["tenant_id", "employee_id"], "ts", "punch_id")
    return travel_columns(pairs, max_kmh).select(
        "tenant_id", "employee_id", F.col("cur")["punch_id"].alias("punch_id"), *TRAVEL_FIELDS
    )


def daily_hours(punches: DataFrame) -> DataFrame:
    """Hours per employee and day from IN punches directly followed by an OUT punch.

    A shift across midnight counts on the day it began.
    """
    return hours_by_day(_shifts(punches))


def _shifts(punches: DataFrame) -> DataFrame:
    """(tenant_id, employee_id, in_ts, out_ts) of IN punches directly followed by an OUT punch."""
    typed = punches.select("tenant_id", "employee_id", "ts", "punch_id", "punch_type")
    pairs = successive_pairs(typed, ["tenant_id", "employee_id"], "ts", "punch_id")
    prev, cur = F.col("prev"), F.col("cur")
    return pairs.filter((prev["punch_type"] == "IN") & (cur["punch_type"] == "OUT")).select(
        "tenant_id", "employee_id", prev["ts"].alias("in_ts"), cur["ts"].alias("out_ts")
    )


def hours_by_day(shifts: DataFrame) -> DataFrame:
    """Sum shifts (in_ts, out_ts) per employee and day of the IN punch."""
    micros = F.unix_micros("out_ts") - F.unix_micros("in_ts")
    return (
        shifts.groupBy("tenant_id", "employee_id", F.to_date("in_ts").alias("work_date"))
        .agg(F.sum(micros).alias("_micros"), F.count("*").alias("shifts"))
        .withColumn("total_hours", F.round(F.col("_micros") / F.lit(3_600_000_000.0), 2))
        .drop("_micros")
    )


def session_ends(punches: DataFrame, gap_seconds: int) -> DataFrame:
    """(tenant_id, employee_id, started_at, last_at, last_type, punches) of each session: punches less than the gap apart.

    The last punch is by time, then id.  Works on tables and streams.
    """
    last = F.max(F.struct("ts", "punch_id", "punch_type"))
    session = F.session_window("ts", f"{gap_seconds} seconds").alias("session")
    found = punches.groupBy("tenant_id", "employee_id", session).agg(last.alias("last"), F.count("*").alias("punches"))
    return found.select(
        "tenant_id", "employee_id", F.col("session.start").alias("started_at"), F.col("last.ts").alias("last_at"),
        F.col("last.punch_type").alias("last_type"), "punches",
    )


def with_open_shifts(sessions: DataFrame, shifts: DataFrame, gap_seconds: int) -> DataFrame:
    """Open shifts: sessions that end with an IN punch, with the number and hours of the shifts that began in them.

    Sessions of an employee are a gap apart, so of time cut into pieces of a gap each has two at most: shifts meet
    the sessions of their piece, never all of the employee.
    """
    open_ = sessions.filter(F.col("last_type") == "IN")
    piece = lambda t: F.floor(F.unix_micros(t) / (gap_seconds * 1_000_000)).cast("long")
    began = shifts.select(
        "tenant_id", "employee_id", "in_ts", piece("in_ts").alias("piece"), (F.unix_micros("out_ts") - F.unix_micros("in_ts")).alias("micros")
    )
    keys = ["tenant_id", "employee_id", "started_at"]
    spread = open_.select(*keys, "last_at", F.explode(F.sequence(piece("started_at"), piece("last_at"))).alias("piece"))
    inside = spread.join(began, ["tenant_id", "employee_id", "piece"]).filter(
        (F.col("in_ts") >= F.col("started_at")) & (F.col("in_ts") < F.col("last_at"))
    )
    closed = inside.groupBy(*keys).agg(F.count("*").alias("closed"), F.sum("micros").alias("micros"))
    hours = F.round(F.coalesce("micros", F.lit(0)) / F.lit(3_600_000_000.0), 2)
    return open_.join(closed, keys, "left").select(
        "tenant_id", "employee_id", "started_at", F.col("last_at").alias("open_since"), "punches",
        F.coalesce("closed", F.lit(0)).alias("closed_shifts"), hours.alias("closed_hours"),
    )


def open_shifts(punches: DataFrame, gap_seconds: int = 43_200) -> DataFrame:
    """Shifts begun and not ended within the gap: see :func:`with_open_shifts`."""
    timed = punches.filter(F.col("ts").isNotNull())
    return with_open_shifts(session_ends(timed, gap_seconds), _shifts(punches), gap_seconds)
