"""Stream queries: the given tables replayed as landed files, compared with their batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewframe.operators import attendance
from crewframe.operators.retries import dedupe_mutations
from crewframe.plans import adapters as ad
from crewframe.plans.audit_queries import DAYS, SHIFTS, TRAVEL, TRAVEL_OUT
from crewframe.plans.people_queries import PII_VAULT, SECRET, _mask_steps
from crewframe.plans.registry import query
from crewframe.plans.schema_queries import DRIFT, KEYS, REJECTED, STAFF_MAPPING
from crewframe.plans.sqlviews import with_views
from crewframe.session import scratch
from crewframe.streaming import landing, mutations, punches


#: state partitions of the registered streams; a stream's first start fixes them, so they are a parameter here
STATE_PARTITIONS = 16
#: their watermark, and the width of the buckets in which rows wait for it
WATERMARK, BUCKET = "60 days", 20 * 86_400
#: hours after which a shift without an OUT punch counts as open
OPEN_AFTER = 12
#: punches of ids with this remainder land after the watermark has passed them
LATE_EVERY, LATE_REST = 50, 7


#: micro-batches that a landed table is read in, about: more files go into a batch where there are more
LANDINGS = 8


def _replay(
    spark: SparkSession, rows: DataFrame, name: str, last: DataFrame | None = None, late: DataFrame | None = None
) -> DataFrame:
    """Land a table as files in the shared folder, as many as it is read in, and read them back as a stream.

    ``last`` lands after them: one row far ahead, which moves the watermark past everything.  ``late`` lands in
    batches of its own after that.  A batch takes a file for each core or more, so all cores work on it and
    the number of batches does not grow with the table.
    """
    folder = scratch(spark, f"landed-{name}")
    rows.write.parquet(folder)
    files = len(spark.read.schema(rows.schema).parquet(folder).inputFiles())
    at_once = max(2, spark.sparkContext.defaultParallelism, -(-files // LANDINGS))
    if last is not None:
        # rows count as late from the second batch after the one that has moved the watermark: fill a batch between
        copies = 1 if late is None else 2 * at_once
        row = last.first()
        one = [F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in rows.schema]
        # a file for each copy
        spark.range(0, copies, 1, copies).select(*one).write.mode("append").parquet(folder)
    if late is not None:
        late.write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", at_once).parquet(folder)


def _events(spark, sf_dir) -> DataFrame:
    return ad.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")


def _event_stream(spark, sf_dir, name: str, some=None, late=None) -> DataFrame:
    whole = _events(spark, sf_dir)
    events = whole if some is None else whole.filter(some)
    ahead = events.agg(
        F.lit(-1).cast("bigint").alias("event_id"), (F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"),
        F.lit(-1).cast("bigint").alias("user_id"), F.lit("view").alias("event_type"),
    )
    return _replay(spark, events, name, last=ahead, late=None if late is None else whole.filter(late))


@query("travel_alerts_stream", with_views(["punches"], TRAVEL_OUT, TRAVEL))
def travel_alerts_stream(spark, sf_dir):
    """Speed between successive punches, from the event stream."""
    stream = ad.punches_from_events(_event_stream(spark, sf_dir, "travel"))
    alerts = punches.travel_alerts(stream, WATERMARK, bucket_seconds=BUCKET)
    return landing.run_to_end(alerts, "travel", state_partitions=STATE_PARTITIONS).drop("explanation")


@query("daily_hours_stream", with_views(["punches"], DAYS, SHIFTS))
def daily_hours_stream(spark, sf_dir):
    """Hours per employee and day, from the event stream."""
    stream = ad.punches_from_events(_event_stream(spark, sf_dir, "hours"))
    shifts = punches.shifts(stream, WATERMARK, BUCKET)
    return punches.hours_from_shifts(landing.run_to_end(shifts, "hours", state_partitions=STATE_PARTITIONS))


@query(
    "late_punches_stream",
    with_views(
        ["all_punches"],
        "SELECT tenant_id, employee_id, d::VARCHAR AS work_date, shifts, total_hours, "
        f"(SELECT count(*) FROM all_punches WHERE punch_id % {LATE_EVERY} = {LATE_REST}) AS late_rows FROM days",
        f"punches AS (SELECT * FROM all_punches WHERE punch_id % {LATE_EVERY} <> {LATE_REST}),\n{SHIFTS}",
    ),
)
def late_punches_stream(spark, sf_dir):
    """Hours from the event stream when some punches land behind the watermark: they are left out and counted."""
    late = F.col("event_id") % LATE_EVERY == LATE_REST
    stream = ad.punches_from_events(_event_stream(spark, sf_dir, "late", ~late, late))
    shifts = landing.run_to_end(punches.shifts(stream, WATERMARK, BUCKET), "late", state_partitions=STATE_PARTITIONS, late="late_rows")
    dropped = shifts.agg(F.max("late_rows")).first()[0]
    return punches.hours_from_shifts(shifts).withColumn("late_rows", F.lit(dropped))


OPEN_SHIFTS = f"""marked AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL {OPEN_AFTER} HOUR THEN 0 ELSE 1 END AS opens FROM punches
  WINDOW w AS (PARTITION BY tenant_id, employee_id ORDER BY ts, punch_id)),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY tenant_id, employee_id ORDER BY ts, punch_id ROWS UNBOUNDED PRECEDING) AS n FROM marked),
ends AS (
  SELECT tenant_id, employee_id, n, min(ts) AS started_at, max(ts) AS open_since, count(*) AS punches,
    arg_max(punch_type, (ts, punch_id)) AS last_type FROM numbered GROUP BY ALL)"""


OPEN_OUT = """SELECT e.tenant_id, e.employee_id, strftime(e.started_at, '%Y-%m-%d %H:%M:%S.%f') AS started_at,
  strftime(e.open_since, '%Y-%m-%d %H:%M:%S.%f') AS open_since, any_value(e.punches) AS punches, count(s.in_ts) AS closed_shifts,
  round(coalesce(sum(epoch_us(out_ts) - epoch_us(in_ts)), 0)::DOUBLE / 3600000000.0, 2) AS closed_hours
FROM ends e LEFT JOIN shifts s ON s.tenant_id = e.tenant_id AND s.employee_id = e.employee_id AND s.in_ts >= e.started_at
  AND s.in_ts < e.open_since
WHERE e.last_type = 'IN' GROUP BY e.tenant_id, e.employee_id, e.started_at, e.open_since"""


@query("open_shifts", with_views(["punches"], OPEN_OUT, f"{SHIFTS},\n{OPEN_SHIFTS}"))
def open_shifts(spark, sf_dir):
    """Shifts begun and not ended within half a day."""
    return attendance.open_shifts(ad.punches(spark, sf_dir), OPEN_AFTER * 3600)


@query("open_shifts_stream", with_views(["punches"], OPEN_OUT, f"{SHIFTS},\n{OPEN_SHIFTS}"))
def open_shifts_stream(spark, sf_dir):
    """The same from the event stream: session windows merged with the finished shifts.  The row that moves the watermark
    never ends a session, and its employee has no other punch."""
    ends = punches.sessions(ad.punches_from_events(_event_stream(spark, sf_dir, "sessions")), OPEN_AFTER * 3600, WATERMARK)
    pairs = punches.shifts(ad.punches_from_events(_event_stream(spark, sf_dir, "pairs")), WATERMARK, BUCKET)
    stored = [landing.run_to_end(s, n, state_partitions=STATE_PARTITIONS) for s, n in ((ends, "sessions"), (pairs, "pairs"))]
    return punches.open_shifts(*stored, OPEN_AFTER * 3600)


TTL_HOURS = 30
KEPT = f"""WITH RECURSIVE e AS (
  SELECT user_id, ts, min(event_id) AS event_id FROM events WHERE event_type <> 'error' GROUP BY user_id, ts),
kept AS (
  SELECT user_id, min(ts) AS ts FROM e GROUP BY user_id
  UNION ALL
  SELECT k.user_id, min(e.ts) FROM kept k JOIN e ON e.user_id = k.user_id AND e.ts >= k.ts + INTERVAL {TTL_HOURS} HOUR
  GROUP BY k.user_id)
SELECT e.user_id AS user_id, e.event_id AS event_id, strftime(e.ts, '%Y-%m-%d %H:%M:%S.%f') AS kept_at
FROM kept JOIN e ON e.user_id = kept.user_id AND e.ts = kept.ts"""


@query("mutation_dedupe", KEPT)
def mutation_dedupe(spark, sf_dir):
    """Events as writes per user: repeats within thirty hours of the last kept one go, failed ones never count."""
    writes = _events(spark, sf_dir).withColumn("done", F.col("event_type") != "error")
    kept = dedupe_mutations(writes, ["user_id"], "ts", "event_id", TTL_HOURS * 3600, "done")
    return kept.select("user_id", "event_id", F.col("ts").alias("kept_at"))


@query("mutation_dedupe_stream", KEPT)
def mutation_dedupe_stream(spark, sf_dir):
    """The same rule on the event stream."""
    stream = _event_stream(spark, sf_dir, "writes").withColumn("done", F.col("event_type") != "error")
    kept = landing.run_to_end(
        mutations.dedupe_mutations(stream, "user_id", "ts", "event_id", TTL_HOURS * 3600, WATERMARK, "done", BUCKET), "writes",
        state_partitions=STATE_PARTITIONS,
    )
    return kept.select(F.col("key").cast("bigint").alias("user_id"), F.col("tie").alias("event_id"), "kept_at")


@query("drift_stream", DRIFT)
def drift_stream(spark, sf_dir):
    """Unmapped fields of the staff records as they land."""
    stream = _replay(spark, ad.staff_json(spark, sf_dir), "staff").withColumn("payload", F.try_parse_json("body")).drop("body")
    return landing.drift_events(stream, STAFF_MAPPING, "employee_id", KEYS[:1], "drift")


@query("mask_stream", with_views(["private_texts"], "SELECT doc_id, tenant_id, md5(text) AS text_md5 FROM masked", _mask_steps()))
def mask_stream(spark, sf_dir):
    """Documents masked as they land."""
    documents = ad.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    texts = ad.private_texts_from(_replay(spark, documents, "documents"))
    return landing.run_to_end(landing.masked_stream(texts, "text", SECRET), "mask").select(
        "doc_id", "tenant_id", F.md5("text").alias("text_md5")
    )


@query("mask_stream_vault", PII_VAULT)
def mask_stream_vault(spark, sf_dir):
    """The vault of the documents as they land."""
    documents = ad.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    texts = ad.private_texts_from(_replay(spark, documents, "vault-documents"))
    return landing.stream_vault(texts, "text", SECRET, "vault")


@query(
    "rejection_stream",
    f"""{REJECTED} SELECT order_id, entity_type, field_name,
      'Host HTTP ' || status_code || ' schema rejection: ' || said AS description FROM e""",
)
def rejection_stream(spark, sf_dir):
    """Rejected writes diagnosed as they land."""
    stream = _replay(spark, ad.order_rejections(spark, sf_dir).drop("body"), "rejections")
    return landing.run_to_end(landing.rejection_stream(stream), "rejections").select(
        "order_id", "entity_type", "field_name", "description"
    )
