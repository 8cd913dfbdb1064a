"""Workforce-shaped views of the given tables.

Every view is arithmetic on the keys and columns of whole tables, so its size follows theirs.
The same views exist as SQL in :mod:`crewframe.plans.sqlviews`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewframe.functions.money import MONEY

# Phrases that make prose carry the words the text operators look for.
MESSAGE_PHRASES = [
    "please show my end of service amount", "I need the ctc breakdown", "run a wps audit now", "apply leave for me",
    "there was a ghost punch", "score resume of this person", "is this gender neutral", "send the offer letter",
    "my exit clearance is open", "here is a hotel claim", "which gazette covers wages and hours", "good morning",
]
BIAS_PHRASES = [
    "We need a Rockstar.", "A ninja, please.", "Our guru left.", "Aggressive targets!", "A dominant player",
    "we work hard play hard here", "cheap manpower", "freshers only", "a calm and fair team",
]
PII_FRAGMENTS = [
    " Aadhaar 5412 8931 {n}", " PAN ABCDE{n}F", " card 784-1990-123{n}-1", " ssn 123-45-{n}", " call +1 415-555-{n}",
    " plain note {n}",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: Column | str) -> Column:
    """A two-place double as whole cents."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value * 100).cast("bigint")


def from_cents(value: Column) -> Column:
    return (value.cast("decimal(16,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY)


def pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staff master from customer and nation; basic pay is three times the absolute balance."""
    key = F.col("c_custkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat(F.lit("T"), F.col("n_regionkey").cast("string")).alias("tenant_id"),
            F.when(key % 2 == 0, "AE").otherwise("IN").alias("jurisdiction"),
            key.alias("employee_id"),
            F.concat(F.lit("EMP-"), key.cast("string")).alias("id"),
            F.initcap("c_mktsegment").alias("first_name"),
            F.col("c_name").alias("last_name"),
            from_cents(cents(F.abs("c_acctbal")) * 3).alias("basic_salary"),
            ((key * 7) % 300).cast("int").alias("probation_days"),
            (key % 3 != 0).alias("is_pf_enrolled"),
            ((key % 400).cast("decimal(6,0)") / 10).cast("decimal(10,4)").alias("tenure_years"),
            (key % 5 == 0).alias("on_probation"),
        )
    )


def claim_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expense lines from lineitem.  The order number alone repeats inside a claim, so the line
    number is spelled from all columns that tell lines apart."""
    part = F.col("l_partkey")
    pad = lambda c, n: F.lpad(F.col(c).cast("bigint").cast("string"), n, "0")
    columns = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_returnflag l_shipdate".split()
    return table(spark, sf_dir, "lineitem").select(*columns).select(
        F.col("l_orderkey").alias("claim_id"),
        F.concat(
            pad("l_linenumber", 3), pad("l_partkey", 12), pad("l_suppkey", 12), pad("l_quantity", 6),
            F.lpad(cents("l_extendedprice").cast("string"), 14, "0"),
        ).alias("line_no"),
        pick(["MEAL", "HOTEL", "FLIGHT", "LOCAL_CONVEYANCE"], part % 4).alias("category"),
        (F.lit(500) * (part % 12 + 1)).cast(MONEY).alias("amount"),
        F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("date"),
        (F.col("l_returnflag") != "N").alias("has_receipt"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("claim_id"),
        pick(["INR", "AED", "USD"], key % 3).alias("currency"),
        F.when(F.col("o_custkey") % 2 == 0, "METRO").otherwise("NON_METRO").alias("tier"),
        (F.col("o_orderstatus") != "P").alias("has_approved_travel_request"),
    )


def punches_from_events(events: DataFrame) -> DataFrame:
    key = F.col("event_id")
    return events.select(
        F.concat(F.lit("T"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"),
        F.col("user_id").alias("employee_id"),
        key.alias("punch_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(key % 2 == 0, "IN").otherwise("OUT").alias("punch_type"),
        (((key * 7919) % 12000) / 100.0 - 60.0).alias("lat"),
        (((key * 104729) % 36000) / 100.0 - 180.0).alias("lng"),
    )


def punches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return punches_from_events(table(spark, sf_dir, "events"))


def requisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings from benchmark items: all their words are the wanted skills."""
    return table(spark, sf_dir, "benchmark").select(
        F.lit("T").alias("tenant_id"),
        F.col("item_id").alias("requisition_id"),
        F.split("text", " ").alias("required_skills"),
        (F.col("item_id") % 8).cast("double").alias("required_years"),
    )


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One application per document, dealt over all openings, which are numbered from 0."""
    key = F.col("doc_id")
    openings = (table(spark, sf_dir, "benchmark").agg(F.max("item_id")).first()[0] or 0) + 1
    return table(spark, sf_dir, "documents").select("doc_id", "text").select(
        F.lit("T").alias("tenant_id"),
        key.alias("candidate_id"),
        (key % openings).alias("requisition_id"),
        F.col("text").alias("resume_text"),
        (key % 10).cast("double").alias("candidate_years"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate rows whose keys overlap; a third of them share one phone."""
    key = F.col("c_custkey")
    text = lambda c: c.cast("string")
    return table(spark, sf_dir, "customer").select(
        key.alias("arrival"),
        F.concat(F.lit("CAND-"), text(F.floor(key / 2))).alias("id"),
        F.col("c_name").alias("full_name"),
        F.when(key % 4 != 0, F.concat(F.lit("U"), text(F.floor(key / 6)), F.lit("@mail.io"))).otherwise("").alias("email"),
        F.when(key % 3 == 0, F.lit("+1 415 555 0000"))
        .when(key % 5 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("+44 20 "), text(F.floor(key / 4) + 1000000)))
        .alias("phone"),
        F.when(key % 7 == 0, F.concat(F.lit("https://in.io/p/"), text(F.floor(key / 21)), F.lit("/"))).alias("linkedin_url"),
        F.col("c_mktsegment").alias("source"),
    )


def messages_from(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        "conv_id",
        "turn",
        F.concat_ws(" ", "text", pick(MESSAGE_PHRASES, (F.col("conv_id") + F.col("turn")) % 12)).alias("text"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_from(table(spark, sf_dir, "conversations"))


def job_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.concat_ws(" ", "text", pick(BIAS_PHRASES, F.col("doc_id") % 9)).alias("jd_text"))


def private_texts_from(documents: DataFrame) -> DataFrame:
    key = F.col("doc_id")
    number = F.lpad((key % 9000 + 1000).cast("string"), 4, "0")
    fragment = F.replace(pick(PII_FRAGMENTS, key % 6), F.lit("{n}"), number)
    return documents.select("doc_id", F.col("source").alias("tenant_id"), F.concat("text", fragment).alias("text"))


def private_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an identifier appended; the source is the tenant."""
    return private_texts_from(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def staff_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tenant_id, employee_id, body) - one vendor record per customer as JSON text."""
    key = F.col("c_custkey")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    record = F.struct(
        key.alias("emp_id"),
        F.initcap("c_mktsegment").alias("first_name"),
        F.col("c_name").alias("last_name"),
        F.when(key % 11 != 0, F.concat(F.lit(" u"), key.cast("string"), F.lit("@host.io "))).alias("email"),
        F.when(key % 2 == 0, "1").when(key % 3 == 0, "2").otherwise("notice").alias("status_code"),
        F.struct(cents("c_acctbal").alias("base_cents"), F.lit("INR").alias("unit")).alias("pay"),
        F.date_format(F.date_add(F.lit("2015-01-01").cast("date"), (key % 3000).cast("int")), "yyyy-MM-dd").alias("doj"),
        (key % 4 == 0).alias("is_manager"),
        F.when(key % 5 == 0, F.array(F.lit("sql"), F.lit("spark"))).otherwise(F.array(F.lit("java"))).alias("skills"),
        F.when(key % 13 == 0, F.concat(F.lit("B"), key.cast("string"))).alias("badge_no"),
    )
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("T"), F.col("n_regionkey").cast("string")).alias("tenant_id"),
        key.alias("employee_id"),
        F.to_json(record).alias("body"),
    )


def staff_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staff_json(spark, sf_dir).select(
        "tenant_id",
        F.lit("hostco").alias("vendor"),
        F.lit("EMPLOYEE").alias("entity_type"),
        "employee_id",
        F.try_parse_json("body").alias("payload"),
    )


def order_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected writes: order rows as payloads with the error text the host gave."""
    key = F.col("o_orderkey")
    errors = [
        '{"message":"\'departmentId\' cannot be null or is required"}',
        '{"error_message":"Invalid parameter \\"start_date\\" given"}',
        '{"detail":"LastName and Department are mandatory, see company and naming_series"}',
        "plain text: missing required field 'email'",
    ]
    return table(spark, sf_dir, "orders").select(
        key.alias("order_id"),
        pick(["EMPLOYEE", "LEAVE_REQUEST", "REQUISITION"], key % 3).alias("entity_type"),
        F.when(key % 2 == 0, 400).otherwise(422).alias("status_code"),
        pick(errors, key % 4).alias("error"),
        F.when(
            key % 5 == 0,
            F.to_json(F.struct(F.lit("Acme").alias("company"), F.col("o_custkey").alias("cust"))),
        )
        .otherwise(
            F.to_json(F.struct(F.col("o_orderpriority").alias("FirstName"), F.col("o_custkey").alias("cust")))
        )
        .alias("body"),
    )


# --------------------------------------------------------------------------- plain output
def plain(df: DataFrame) -> DataFrame:
    """Result columns in types every engine shows alike: bigint, double, boolean, string."""
    out = []
    for field in df.schema.fields:
        column, kind = F.col(field.name), field.dataType
        if isinstance(kind, (T.DecimalType, T.FloatType)):
            column = column.cast("double")
        elif isinstance(kind, T.IntegralType):
            column = column.cast("bigint")
        elif isinstance(kind, T.DateType):
            column = column.cast("string")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), "|")
        if isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.ArrayType)):
            column = F.coalesce(column, F.lit(""))
        out.append(column.alias(field.name))
    return df.select(*out)
