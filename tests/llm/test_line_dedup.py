import hashlib
from collections import Counter

import pytest
from helpers import ODD, documents

from crewframe.llm import line_dedup as ld

BLANK = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, chars=1):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    keys = [[x.strip(BLANK).translate(LOWER) for x in lines] for _, lines in split]
    seen = Counter(k for ks in keys for k in set(ks))
    out = []
    for (i, lines), ks in zip(split, keys):
        kept = [x for x, k in zip(lines, ks) if len(k) < chars or seen[k] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=repr)


@pytest.mark.parametrize("batches", [1, 5])
def test_equals_brute_force(spark, batches):
    rows = [(i, "\n".join([f"own {i}", " Shared\t", "SHARED", "", f"few {i // 3}", f"often {i % 2} É"])) for i in range(23)] + ODD
    got = ld.drop_shared_lines(documents(spark, rows), min_docs=3, batches=batches)
    assert rows_of(got) == brute(rows, 3)


def test_copies_and_a_hot_line(spark):
    rows = [(i, "same text\nof many") for i in range(60)] + [(100 + i, f"hot\nown {i}") for i in range(40)]
    assert rows_of(ld.drop_shared_lines(documents(spark, rows))) == brute(rows, 10)


def test_other_columns_stay(spark):
    df = documents(spark, [(i, f"hot\n{i}") for i in range(12)] + ODD, extra=True)
    got = ld.drop_shared_lines(df)
    assert [c for c in got.columns if c != "n_dropped"] == df.columns
    assert got.filter("row = 'k' and h1 = 2").count() == 23


def test_empty_table(spark):
    assert ld.drop_shared_lines(documents(spark, [])).collect() == []


def test_levels_compact_and_leave_no_table(spark):
    runs = ld.LineRuns(spark, min_docs=4, fanout=2)
    for i in range(7):
        counts = spark.createDataFrame([(1, 1, 1), (2, 2, 1 + i % 2), (10 + i, 0, 5), (20 + i, 0, 1)], "h1 long, h2 long, n_docs long")
        runs.add(counts)
        assert all(len(level) < 2 for level in runs.levels)
    assert len(runs.levels) == 3
    found = {r.h1 for r in runs.frequent().collect()}
    assert found == {1, 2, *range(10, 17)}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_anti_join_of_runs_needs_no_shuffle(spark):
    runs = ld.LineRuns(spark, min_docs=1)
    made = spark.range(3000).selectExpr("id h1", "id h2", "1L n_docs")
    a, b = runs._store(made), runs._store(made)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = spark.table(a).join(spark.table(b), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    runs._drop(a, b)
    assert "SortMergeJoin" in text and "Exchange" not in text


def test_no_python_on_the_main_path(spark):
    plan = ld.drop_shared_lines(documents(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_digest(spark):
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
