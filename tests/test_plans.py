"""What the plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from crewframe import plans as entry
from crewframe.operators import attendance, compliance, expenses, profiling
from crewframe.plans import adapters as ad

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def executed(df):
    """Final adaptive plan after the rows were computed once."""
    query = df._jdf.queryExecution()
    query.executedPlan().executeCollect()
    return query.executedPlan().toString()


NAMES = [n for n in entry.queries() if not n.endswith("_stream")]


@pytest.mark.parametrize("name", NAMES)
def test_stays_in_the_engine(spark, name):
    text = plan(entry.queries()[name](spark, SMALL))
    assert not re.search(r"Python|Pandas", text)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", text)


def test_every_query_has_sql():
    assert set(entry.oracle_sql()) == set(entry.queries())


def test_scans_are_pruned_and_filtered(spark):
    text = plan(entry.queries()["employee_audit"](spark, SMALL))
    assert "c_acctbal" in text and "ReadSchema: struct<n_nationkey:int,n_regionkey:int>" in text
    text = plan(entry.queries()["impossible_travel"](spark, SMALL))
    assert "props" not in text and "value#" not in text


def test_pushdown_reaches_parquet(spark, tmp_path):
    rows = spark.range(100).selectExpr(
        "'T' as tenant_id", "if(id % 2 = 0, 'AE', 'IN') as jurisdiction", "id as employee_id", "cast(id as double) as total_hours"
    )
    rows.write.parquet(str(tmp_path / "hours"))
    text = plan(compliance.audit_daily_hours(spark.read.parquet(str(tmp_path / "hours"))))
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(jurisdiction,AE\)", text)


def test_hot_instant_is_spread_over_tasks(spark):
    """A third of all rows at one instant of one key: its pairs are made in several tasks, and none is lost."""
    from crewframe.operators.sequences import successive_pairs

    rows = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 500).alias("user"),
        F.when(F.col("id") % 3 == 0, F.lit("2024-01-01")).otherwise("2024-02-02").cast("timestamp").alias("ts"), F.col("id").alias("tie"),
    )
    name, before = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(name, "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        pairs = successive_pairs(rows, ["user"], "ts", "tie")
        tasks = pairs.filter("user = 1").select(F.spark_partition_id().alias("p"), "prev", "cur").collect()
    finally:
        spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ties = sorted(r["cur"]["tie"] for r in tasks)
    mine = sorted(r["id"] for r in spark.range(30000).filter("id % 3 = 0 or id % 500 = 1").collect())
    assert len(ties) == len(mine) - 1 and len({r["p"] for r in tasks}) >= 2
    order = {(r["prev"]["ts"], r["prev"]["tie"]) < (r["cur"]["ts"], r["cur"]["tie"]) for r in tasks}
    assert order == {True}


def test_first_samples_are_cut_before_the_shuffle(spark):
    text = plan(profiling.profile_records(ad.staff_payloads(spark, SMALL), ["tenant_id"], "employee_id"))
    assert re.search(r"WindowGroupLimit .*Partial", text)


def test_hot_receipt_is_split(spark):
    """A third of all lines repeat one receipt: the join that brings back its first line splits it."""
    lines = spark.range(60000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5000 + 2).alias("claim_id"),
        F.format_string("%08d-%s", "id", F.lit("x" * 40)).alias("line_no"),
        F.when(F.col("id") % 3 == 0, "HOTEL").otherwise("MEAL").alias("category"),
        F.when(F.col("id") % 3 == 0, 100).otherwise(F.col("id") % 7).cast("decimal(18,2)").alias("amount"),
        F.lit(None).cast("date").alias("date"), F.lit(True).alias("has_receipt"),
    ).repartition(12)
    claims = spark.range(5002).select(
        F.col("id").alias("claim_id"), F.lit("INR").alias("currency"), F.lit("METRO").alias("tier"), F.lit(True).alias("has_approved_travel_request")
    )
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        found = expenses.claim_line_findings(lines, claims)
        text = executed(found)
        assert len(re.findall(r"SortMergeJoin\(skew=true\).*_hash", text)) >= 1
        assert found.filter("claim_id = 1").count() == 19999
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_search_shuffles_no_pairs_of_query_and_text(spark):
    import re

    from crewframe.operators import search

    asked = spark.createDataFrame([(1, "wages and hours")], "item_id long, query string")
    found = search.search_corpus(asked, search.index_corpus(search.statutes(spark)), ["item_id"])
    text = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(ord#", text) and not re.search(r"hashpartitioning\(item_id#\d+L?, ord#", text)
