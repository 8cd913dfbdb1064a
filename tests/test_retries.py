import random

from pyspark.sql import functions as F

from crewframe.operators import sequences
from crewframe.operators.retries import dedupe_mutations


def walk(rows, ttl):
    """The rule in order, one key at a time."""
    last, kept = {}, set()
    for key, at, ident, ok in sorted(rows):
        if ok and (key not in last or at - last[key] >= ttl):
            last[key] = at
            kept.add(ident)
    return kept


def test_against_the_walk(spark):
    rng = random.Random(11)
    rows = []
    for n in range(900):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(60)}"
        rows.append((key, rng.randrange(0, 4000) if key == "hot" else rng.randrange(0, 9000), n, rng.random() < 0.9))
    df = spark.createDataFrame(rows, "k string, s long, id long, ok boolean").withColumn("at", F.timestamp_seconds("s"))
    for ttl in (120, 7, 100000):
        got = {r["id"] for r in dedupe_mutations(df, ["k"], "at", "id", ttl, "ok").collect()}
        assert got == walk(rows, ttl), ttl


def test_replays_do_not_extend(spark):
    rows = [("a", t, i, True) for i, t in enumerate((0, 100, 119, 120, 200, 240, 241))]
    df = spark.createDataFrame(rows, "k string, s long, id long, ok boolean").withColumn("at", F.timestamp_seconds("s"))
    assert sorted(r["s"] for r in dedupe_mutations(df, ["k"], "at", "id").collect()) == [0, 120, 240]


def test_nearest_marks_against_search(spark, monkeypatch, request):
    """One key on a third of the rows, all of them within one time to live, is sorted by several tasks."""
    import bisect

    rng = random.Random(2)
    key = lambda: "hot" if rng.random() < 0.34 else rng.choice([None, *"abcdefgh"])
    marks = {(key(), rng.randrange(3000)) for _ in range(3000)}
    asks = [(key(), rng.randrange(3300), n) for n in range(3000)]
    stored = []
    real = sequences.cut
    monkeypatch.setattr(sequences, "cut", lambda df, *by: stored.append(real(df, *by)) or stored[-1])
    small = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(small, "false")
    request.addfinalizer(lambda: spark.conf.unset(small))
    tables = [
        spark.createDataFrame([(k, at, f"m{at}") for k, at in marks], "k string, at long, name string").repartition(4),
        spark.createDataFrame(asks, "k string, at long, id long").repartition(4),
    ]
    after = sequences.nearest_marks(*tables, ["k"], "at").select("k", "at", "id", "mark.at", "mark.name").collect()
    before = sequences.nearest_marks(*tables, ["k"], "at", before=True).select("k", "at", "id", "mark.at").collect()
    by_key = {}
    for k, at in sorted(marks, key=lambda m: m[1]):
        by_key.setdefault(k, []).append(at)
    later, earlier = set(), set()
    for k, at, n in asks:
        held = by_key.get(k, [])
        place = bisect.bisect_left(held, at)
        if place < len(held):
            later.add((k, at, n, held[place], f"m{held[place]}"))
        if place > 0:
            earlier.add((k, at, n, held[place - 1]))
    assert set(map(tuple, after)) == later and len(after) == len(later)
    assert set(map(tuple, before)) == earlier and len(before) == len(earlier)
    assert stored[0].filter("k = 'hot'").select("_range").distinct().count() > 1


def test_a_burst_within_one_time_to_live(spark):
    rows = [("hot", n, n, True) for n in range(0, 400)] + [("hot", 1000 + n, 400 + n, True) for n in range(0, 400, 3)] + [("b", 5, 9000, True)]
    df = spark.createDataFrame(rows, "k string, s long, id long, ok boolean").withColumn("at", F.timestamp_seconds("s"))
    assert {r["id"] for r in dedupe_mutations(df, ["k"], "at", "id", 450.0).collect()} == walk(rows, 450)
