"""Expense claim audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewframe import refdata
from crewframe.functions.money import MONEY, dec, half_up, money, thousands
from crewframe.operators.findings import text

# The texts of verdicts, policies and explanations below must read exactly so.

# What identifies the same receipt twice inside a claim; an undated line equals another undated one.
RECEIPT = ["claim_id", "_date", "_amount", "_category"]


def per_diem(currency: Column, tier: Column) -> Column:
    """Daily meal cap of a currency and tier as one CASE."""
    cap = None
    for (cur, level), amount in refdata.PER_DIEM.items():
        hit = (currency == cur) & (tier == level)
        cap = F.when(hit, dec(amount)) if cap is None else cap.when(hit, dec(amount))
    return cap.otherwise(dec(refdata.PER_DIEM_DEFAULT))


def _normalised(lines: DataFrame) -> DataFrame:
    receipt = [F.col("has_receipt")] if "has_receipt" in lines.columns else []
    uri = F.col("receipt_uri") if "receipt_uri" in lines.columns else F.lit(None).cast("string")
    return lines.withColumns(
        {
            "_category": F.upper(F.coalesce(F.col("category"), F.lit("MISC"))),
            "_amount": F.coalesce(money("amount"), dec("0.00")),
            # an undated line equals another undated one, in joins too
            "_date": F.coalesce(F.col("date").cast("date"), F.lit("0001-01-01").cast("date")),
            "_receipt": F.when(uri != "", F.lit(True)).otherwise(F.coalesce(*receipt, F.lit(True))),
        }
    )


def _no_receipt() -> Column:
    return ~F.col("_receipt") & (F.col("_amount") > dec(refdata.RECEIPT_THRESHOLD))


def _verdict(claim_approved: Column) -> Column:
    """Outcome of the two checks that need only the line and its claim; null means passed."""
    return F.when(
        ~F.coalesce(claim_approved, F.lit(True)) & F.col("_category").isin(refdata.PREAPPROVAL_CATEGORIES),
        F.lit("POLICY_BREACH"),
    ).when(_no_receipt(), F.lit("MISSING_DOCUMENTATION"))


def _with_terms(lines: DataFrame, claims: DataFrame) -> DataFrame:
    """Lines with the terms of their claim; a missing term, or a missing claim, has the default."""
    terms = claims.select(
        "claim_id", F.col("currency").alias("_currency"), F.col("tier").alias("_tier"),
        F.col("has_approved_travel_request").alias("_allowed"),
    )
    return lines.join(terms, "claim_id", "left").select(
        *lines.columns,
        F.upper(F.coalesce("_currency", F.lit("INR"))).alias("currency"),
        F.upper(F.coalesce("_tier", F.lit("METRO"))).alias("tier"),
        F.coalesce("_allowed", F.lit(True)).alias("_approved"),
    )


def claim_report(lines: DataFrame, claims: DataFrame) -> DataFrame:
    """Totals and verdict per claim.

    Equal lines of a claim share every check but the receipt, so lines collapse to one row per
    distinct (claim, date, amount, category) with two counts before anything is joined: a claim
    of any size is combined on the map side and no window over a claim is needed.  Of the lines
    that pass the first two checks one is kept and the rest are duplicates.  Sums run on whole cents.
    """
    packed = (
        _normalised(lines)
        .groupBy(*RECEIPT)
        .agg(F.count("*").alias("_lines"), F.count_if(_no_receipt()).alias("_unproven"))
    )
    barred = ~F.col("_approved") & F.col("_category").isin(refdata.PREAPPROVAL_CATEGORIES)
    cents = lambda c: (c * 100).cast("bigint")
    cap, amount = cents(per_diem(F.col("currency"), F.col("tier"))), F.col("_cents")
    judged = (
        _with_terms(packed, claims)
        .withColumns(
            {"_cents": cents(F.col("_amount")), "_refused": F.when(barred, F.col("_lines")).otherwise(F.col("_unproven"))}
        )
        .withColumn("_passed", F.col("_lines") - F.col("_refused"))
        .withColumns(
            {
                "_repeats": F.when(F.col("_passed") > 1, F.col("_passed") - 1).otherwise(F.lit(0)),
                "_excess": F.when(
                    (F.col("_passed") > 0) & F.col("_category").isin(refdata.MEAL_CATEGORIES) & (amount > cap), amount - cap
                ).otherwise(F.lit(0)),
            }
        )
    )
    gone = F.col("_refused") + F.col("_repeats")
    totals = judged.groupBy("claim_id", "currency").agg(
        F.sum(amount * F.col("_lines")).alias("_claimed"),
        F.sum(amount * gone + F.col("_excess")).alias("_gone"),
        F.sum(gone + F.when(F.col("_excess") > 0, 1).otherwise(0)).alias("violations_count"),
    )
    paid = F.col("_claimed") - F.col("_gone")
    whole = lambda c: half_up(c.cast("decimal(20,0)") * dec("0.01", "decimal(3,2)"))
    return totals.select(
        "claim_id",
        "currency",
        whole(F.col("_claimed")).alias("total_claimed"),
        whole(F.when(paid < 0, F.lit(0)).otherwise(paid)).alias("total_approved"),
        whole(F.col("_gone")).alias("total_disallowed"),
        "violations_count",
        (F.col("violations_count") == 0).alias("is_fully_approved"),
        F.when(paid > 0, F.lit("Next Payroll Cycle Disbursement")).otherwise(F.lit("N/A")).alias("reimbursement_schedule"),
    )


def claim_line_findings(lines: DataFrame, claims: DataFrame) -> DataFrame:
    """One row per line that breaks a rule, in the order of the checks.

    Which of equal lines is kept (the first by ``line_no``) needs no claim data: where travel
    was not approved, every one of them is refused anyway.  So the first line is a combining
    aggregate over the lines alone, and only receipts seen more than once go back to the lines.

    The extra key ``_hash`` makes both sides of that join plain shuffles.  Those the adaptive skew
    join can split, so equal lines of one huge claim spread over as many tasks as their size asks
    for; on top of the aggregate's own partitioning it could not.
    """
    hashed = F.xxhash64(*RECEIPT)
    marked = _normalised(lines).withColumn("_hash", hashed)
    firsts = (
        marked.filter(~_no_receipt())
        .groupBy(*RECEIPT)
        .agg(F.min("line_no").alias("_first"), F.count("*").alias("_n"))
        .filter(F.col("_n") > 1)
        .select(*RECEIPT, "_first", hashed.alias("_hash"))
    )
    checked = _with_terms(marked.join(firsts, [*RECEIPT, "_hash"], "left"), claims).withColumn(
        "_verdict", _verdict(F.col("_approved"))
    )
    cap = per_diem(F.col("currency"), F.col("tier"))
    amount, category = F.col("_amount"), F.col("_category")
    duplicate = F.col("_verdict").isNull() & (F.col("line_no") > F.col("_first"))
    over = F.col("_verdict").isNull() & category.isin(refdata.MEAL_CATEGORIES) & (amount > cap)
    severity = (
        F.when(F.col("_verdict").isNotNull(), F.col("_verdict"))
        .when(duplicate, F.lit("SUSPECTED_DUPLICATE"))
        .when(over, F.lit("EXCEEDS_PER_DIEM"))
    )
    level = F.col("severity")
    currency, excess = F.col("currency"), amount - cap
    money_text = lambda c: F.concat(currency, F.lit(" "), thousands(c))
    explanation = (
        F.when(level == "POLICY_BREACH", text(category, " booked without an approved corporate travel authorization."))
        .when(
            level == "MISSING_DOCUMENTATION", F.lit("Expenses over threshold require valid GST / VAT tax invoice.")
        )
        .when(
            level == "SUSPECTED_DUPLICATE",
            text("Duplicate line item detected with identical date, amount (", amount, "), and category."),
        )
        .otherwise(
            text(
                "Meal expense of ", money_text(amount), " exceeds ", F.col("tier"), " per-diem cap of ",
                money_text(cap), " by ", money_text(excess), ".",
            )
        )
    )
    reference = (
        F.when(level == "POLICY_BREACH", F.lit("Corporate Travel Policy Sec 3.1 (Pre-Approval Mandate)"))
        .when(level == "MISSING_DOCUMENTATION", F.lit("Corporate Travel Policy Sec 5.2 (Receipt Retention)"))
        .when(
            level == "SUSPECTED_DUPLICATE",
            F.lit("Corporate Finance Compliance (Anti-Fraud Duplicate Detection)"),
        )
        .otherwise(F.lit("Corporate Travel Policy Schedule B (Per-Diem Allowances)"))
    )
    allowed = F.when(level == "EXCEEDS_PER_DIEM", cap).otherwise(dec("0.00"))
    return (
        checked.withColumn("severity", severity)
        .filter(level.isNotNull())
        .select(
            "claim_id",
            "line_no",
            "severity",
            category.alias("category"),
            amount.alias("claimed_amount"),
            allowed.cast(MONEY).alias("allowed_amount"),
            half_up(amount - allowed).alias("disallowed_amount"),
            explanation.alias("explanation"),
            reference.alias("policy_reference"),
        )
    )
