import random

from pyspark.sql import functions as F

from crewframe.operators import attendance, quality
from crewframe.operators.mapping import FieldRule, Mapping
from crewframe.operators.retries import dedupe_mutations as batch_dedupe
from crewframe.plans import adapters as ad
from crewframe.streaming import landing, mutations, punches

EVENTS = "event_id long, ts timestamp, user_id long"


def feed(spark, tmp_path, rows, schema, files, far):
    """Land shuffled rows in several files, then one row far ahead that moves the watermark."""
    folder = tmp_path / "in"
    for n in range(files):
        spark.createDataFrame(rows[n::files], schema).coalesce(1).write.mode("append").parquet(str(folder))
    spark.createDataFrame([far], schema).coalesce(1).write.mode("append").parquet(str(folder))
    reader = spark.readStream.schema(spark.read.parquet(str(folder)).schema).option("maxFilesPerTrigger", 2)
    return reader.parquet(str(folder))


def _events(spark, tmp_path, count=240):
    import datetime as dt

    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [
        (n, start + dt.timedelta(seconds=rng.randrange(0, 5 * 86400)), rng.choice([1, 1, 1, 2, 3, 4])) for n in range(count)
    ]
    stream = feed(spark, tmp_path, rows, EVENTS, 4, (10**6, start + dt.timedelta(days=400), -1))
    return spark.createDataFrame(rows, EVENTS), stream


def test_travel_equals_batch(spark, tmp_path):
    batch, stream = _events(spark, tmp_path)
    got = landing.run_to_end(punches.travel_alerts(ad.punches_from_events(stream), "30 days"), "travel")
    want = attendance.impossible_travel(ad.punches_from_events(batch))
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 236


def test_hours_equal_batch(spark, tmp_path):
    batch, stream = _events(spark, tmp_path)
    got = punches.hours_from_shifts(landing.run_to_end(punches.shifts(ad.punches_from_events(stream), "30 days"), "shifts"))
    want = attendance.daily_hours(ad.punches_from_events(batch))
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 10


def test_mutations_equal_batch(spark, tmp_path):
    batch, stream = _events(spark, tmp_path)
    got = landing.run_to_end(mutations.dedupe_mutations(stream, "user_id", "ts", "event_id", 7200, "30 days"), "writes")
    want = batch_dedupe(batch, ["user_id"], "ts", "event_id", 7200)
    assert sorted(r["tie"] for r in got.collect()) == sorted(r["event_id"] for r in want.collect())


def test_builtin_window_dedupe(spark, tmp_path):
    _, stream = _events(spark, tmp_path)
    rows = landing.run_to_end(mutations.first_in_window(stream, ["user_id"], "ts", "30 days"), "first").collect()
    assert sorted(r["user_id"] for r in rows) == [-1, 1, 2, 3, 4]


def test_open_shifts_equal_batch_and_rule(spark, tmp_path):
    batch, stream = _events(spark, tmp_path)
    table = ad.punches_from_events(batch)
    ends = landing.run_to_end(punches.sessions(ad.punches_from_events(stream), 5400, "30 days"), "sessions")
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    pairs = landing.run_to_end(punches.shifts(ad.punches_from_events(stream), "30 days"), "pairs")
    got = sorted(map(tuple, punches.open_shifts(ends, pairs, 5400).collect()))
    assert got == sorted(map(tuple, attendance.open_shifts(table, 5400).collect()))

    rows = sorted((r.employee_id, r.ts, r.punch_id, r.punch_type) for r in table.collect())
    want, session = [], []
    for row, after in zip(rows, [*rows[1:], None]):
        session.append(row)
        if after is None or after[0] != row[0] or (after[1] - row[1]).total_seconds() >= 5400:
            pairs = [(a[1], b[1]) for a, b in zip(session, session[1:]) if (a[3], b[3]) == ("IN", "OUT")]
            if row[3] == "IN":
                hours = round(sum((b - a).total_seconds() for a, b in pairs) / 3600, 2)
                want.append((row[0], session[0][1], row[1], len(session), len(pairs), hours))
            session = []
    assert [tuple(r[1:]) for r in got] == sorted(want, key=lambda r: (f"T{r[0] % 5}", *r)) and len(got) > 5


def test_a_bucket_is_read_once_and_alone(monkeypatch):
    """State reads are those of the rows served, whatever waits in other buckets."""
    from types import SimpleNamespace

    class Map(dict):
        reads = 0

        def getValue(self, key):
            found = self.get(key)
            Map.reads += len(found[0]) if found and isinstance(found[0], list) else 0
            return found

        updateValue, removeKey = dict.__setitem__, dict.__delitem__

    class Value(list):
        get, exists = (lambda self: self[0]), (lambda self: bool(self))

        def update(self, value):
            self[:] = [value]

    import pandas as pd

    from crewframe.streaming import ordered

    monkeypatch.setattr(ordered, "PART_ROWS", 7)
    work = ordered.InOrder(["k"], ["at", "tie"], "at long, tie long", ["a", "b"], lambda last, row: (row, row), 10_000)
    timers = []
    handle = SimpleNamespace(
        getMapState=lambda *a: Map(), getValueState=lambda *a: Value(), registerTimer=timers.append,
    )
    work.init(handle)
    rows = [(at * 97 % 50_000, at) for at in range(1000)]
    for n in range(0, 1000, 100):
        list(work.handleInputRows(("x",), iter([pd.DataFrame(rows[n : n + 100], columns=["at", "tie"])]), None))
    assert sorted(timers) == [10, 20, 30, 40, 50]
    served = []
    for timer in sorted(timers):
        Map.reads = 0
        out = list(work.handleExpiredTimer(("x",), None, SimpleNamespace(getExpiryTimeInMs=lambda t=timer: t)))
        assert Map.reads == len(out[0])
        served += out[0][["a", "b"]].values.tolist()
    assert served == sorted(map(list, rows)) and not work.waiting and not work.parts


def test_a_million_rows_of_one_key_wait(spark, tmp_path):
    n = 1_000_000
    rows = spark.range(n).selectExpr(
        "id as event_id", "timestamp_seconds(1704067200 + (id * 7919) % 1000000) as ts", "cast(7 as long) as user_id"
    )
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    far = spark.range(1).selectExpr("-1L as event_id", "timestamp_seconds(1804067200) as ts", "cast(-1 as long) as user_id")
    far.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = mutations.dedupe_mutations(stream, "user_id", "ts", "event_id", 100, "30 days", bucket_seconds=43_200)
    got = landing.run_to_end(kept, "million", state_partitions=2).filter("key = '7'").agg(F.count("*"), F.sum(F.unix_seconds("kept_at") % 100)).first()
    assert tuple(got) == (10_000, 0)


def test_drift_stream(spark, tmp_path):
    rows = [(n, "T", f'{{"id": {n}, "badge": "B{n}"}}') for n in range(9)]
    stream = feed(spark, tmp_path, rows, "n int, tenant_id string, body string", 3, (99, "T", '{"id": 1}'))
    rule = Mapping("v", "EMPLOYEE", "id", (FieldRule("x", "x"),))
    payloads = stream.withColumn("payload", F.parse_json("body")).drop("body")
    event = landing.drift_events(payloads, rule, "n", ["tenant_id"], "drift").collect()[0]
    assert event["field_name"] == "badge" and event["occurrences"] == 9


def test_stateless_streams(spark, tmp_path):
    rows = [(1, "T", "PAN ABCDE1234F"), (2, "T", "none")]
    stream = feed(spark, tmp_path, rows, "n int, tenant_id string, text string", 1, (3, "T", "x"))
    got = {r["n"]: r["text"] for r in landing.run_to_end(landing.masked_stream(stream, "text", "k"), "mask").collect()}
    assert got[1].startswith("PAN [VAULT_PAN_") and got[2] == "none"
    errors = spark.createDataFrame([(1, "EMPLOYEE", 400, "'x' is required")], "n int, entity_type string, status_code int, error string")
    assert quality.diagnose_rejections(errors).collect()[0]["field_name"] == "x"


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    import datetime as dt

    base, folder = dt.datetime(2024, 1, 1), tmp_path / "late"
    days = [("a", 0, 1), ("b", 30, 2), ("c", 1, 3), ("d", 400, 4)]  # c lands a month behind b
    out = tmp_path / "out"
    running = None
    for name, day, ident in days:
        row = [(ident, base + dt.timedelta(days=day), 7)]
        spark.createDataFrame(row, EVENTS).coalesce(1).write.parquet(str(folder / f"part={name}"))
        stream = spark.readStream.schema(EVENTS).parquet(str(folder))
        kept = mutations.dedupe_mutations(stream, "user_id", "ts", "event_id", 3600, "2 days")
        running = landing.append_to(kept, str(out), str(tmp_path / "check"))
        running.awaitTermination()
        dropped = landing.late_rows(running)
        assert spark.conf.get(landing.STATE_PARTITIONS) == "4"
        assert dropped == (1 if name == "c" else 0), name
    rows = spark.read.option("basePath", str(out)).parquet(str(out)).collect()
    assert sorted(r["tie"] for r in rows) == [1, 2]


def test_the_late_counter_holds_one_number_for_a_run():
    from types import SimpleNamespace as Fake

    counter = landing.LateRows()
    counter.onQueryStarted(Fake(runId="r"))
    for n in range(10_000):
        counter.onQueryProgress(Fake(progress=Fake(runId="r", stateOperators=[Fake(numRowsDroppedByWatermark=n % 3), Fake(numRowsDroppedByWatermark=1)])))
    counter.onQueryTerminated(Fake(runId="r"))
    assert counter.total("r", 1.0) == sum(n % 3 + 1 for n in range(10_000))
    assert len(counter.rows) == 1 and counter.total("unknown", None) == 0


def test_keys_share_shards_and_null_keys_and_ties_stay_whole(spark, tmp_path):
    """A batch costs by shards: three hundred keys in four shards, some without key or tie."""
    import datetime as dt

    from crewframe.streaming import ordered

    start, big = dt.datetime(2024, 1, 1), 2**53 + 1
    rows = [(None if n % 50 == 3 else big + n, start + dt.timedelta(minutes=n), None if n % 60 == 7 else n % 300) for n in range(1200)]
    stream = feed(spark, tmp_path, rows, EVENTS, 3, (10**6, start + dt.timedelta(days=400), -1))
    timed = stream.withWatermark("ts", "30 days").withColumn("at", F.unix_micros("ts"))
    found = ordered.in_order(
        timed.select("user_id", "ts", "at", "event_id"), ["user_id"], ["at", "event_id"], "at long, event_id long", ["p", "c"],
        "user_id long, p long, c long", lambda last, row: (row, None if last is None else (last[1], row[1])), 86_400, shards=4,
    )
    got = [tuple(r) for r in landing.run_to_end(found, "shards", state_partitions=2).collect()]
    last, want = {}, []
    for event, _, user in rows:
        if user in last:
            want.append((user, last[user], event))
        last[user] = event
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_batches_do_not_grow_with_files(spark):
    from crewframe.plans import stream_queries as sq

    rows = spark.range(400).repartition(40)
    got = landing.run_to_end(sq._replay(spark, rows, "many-files"), "many-files")
    batches = {f.split("batch=")[1].split("/")[0] for f in got.inputFiles()}
    assert got.count() == 400 and len(batches) <= sq.LANDINGS


def test_late_rows_land_two_batches_after_the_mark(spark):
    """However many files a batch takes, late rows are never in the batch that moves the watermark or the one after."""
    from crewframe.plans import stream_queries as sq

    rows = spark.range(12).selectExpr("id", "timestamp'2024-01-01' + make_interval(0, 0, 0, id) ts").repartition(3)
    last = rows.agg(F.lit(-1).cast("long").alias("id"), (F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"))
    stream = sq._replay(spark, rows, "late-test", last=last, late=rows.withColumn("id", F.col("id") + 100))
    got = landing.run_to_end(stream, "late-test", lambda batch: batch.distinct())
    where = {}
    for id_, path in got.select("id", F.input_file_name()).collect():
        where.setdefault(id_, set()).add(int(path.split("batch=")[1].split("/")[0]))
    assert min(min(where[n]) for n in range(100, 112)) >= min(where[-1]) + 2
