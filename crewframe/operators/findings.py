"""Shape and summary of audit findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewframe import refdata

FINDING_FIELDS = [
    "violation_id", "rule_key", "severity", "entity_type", "entity_id", "summary", "detailed_findings",
    "statutory_citation", "penalty_risk", "remediation_recommendation", "remediation_patch",
]


def text(*parts: Column | str) -> Column:
    """Concatenate literals and columns; null parts read as empty."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def finding(
    rule_key: str,
    severity: str,
    entity_type: str,
    violation_id: Column,
    entity_id: Column,
    summary: Column,
    detail: Column,
    penalty: str,
    advice: str,
    patch: str | None,
) -> Column:
    """One finding as a struct.  The citation is resolved once, as a literal of the rule."""
    return F.struct(
        violation_id.alias("violation_id"),
        F.lit(rule_key).alias("rule_key"),
        F.lit(severity).alias("severity"),
        F.lit(entity_type).alias("entity_type"),
        entity_id.alias("entity_id"),
        summary.alias("summary"),
        detail.alias("detailed_findings"),
        F.lit(refdata.RULE_CITATIONS[rule_key]).alias("statutory_citation"),
        F.lit(penalty).alias("penalty_risk"),
        F.lit(advice).alias("remediation_recommendation"),
        F.lit(patch).cast("string").alias("remediation_patch"),
    )


def attach_citation(findings: DataFrame, rule: str = "rule_key") -> DataFrame:
    """Statute footnote by rule for findings that came without one.

    Each rule's statute is the first of its jurisdiction that holds the rule's key; with five rules
    that is resolved once into a CASE of literals.
    """
    citation = None
    for key, footnote in refdata.RULE_CITATIONS.items():
        hit = F.col(rule) == key
        citation = F.when(hit, F.lit(footnote)) if citation is None else citation.when(hit, F.lit(footnote))
    return findings.withColumn("statutory_citation", citation)


def emit(df: DataFrame, rules: list[tuple[Column, Column]], keep: list[str]) -> DataFrame:
    """Rows of ``df`` times the rules they break, one finding per row.

    The filter in front lets the scan skip rows and row groups no rule can hit.
    """
    broken = reduce(lambda a, b: a | b, [condition for condition, _ in rules])
    hits = F.array_compact(F.array(*[F.when(condition, struct) for condition, struct in rules]))
    return df.filter(broken).select(*keep, F.inline(hits))


def compliance_report(findings: DataFrame, base: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per tenant and jurisdiction: records audited, findings by severity, verdict, dashboard score.

    Both sides are aggregated before they meet, so the join carries one row per group.
    """
    keys = keys or ["tenant_id", "jurisdiction"]
    audited = base.groupBy(*keys).agg(F.count("*").alias("total_records_audited"))
    counts = findings.groupBy(*keys).agg(
        F.count("*").alias("violations_count"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_count"),
        F.count_if(F.col("severity") == "HIGH").alias("high_count"),
    )
    found = F.coalesce(F.col("violations_count"), F.lit(0))
    return audited.join(counts, keys, "left").select(
        *keys,
        "total_records_audited",
        found.alias("violations_count"),
        F.coalesce("critical_count", F.lit(0)).alias("critical_count"),
        F.coalesce("high_count", F.lit(0)).alias("high_count"),
        (found == 0).alias("is_compliant"),
        F.when(found == 0, F.lit(92)).otherwise(F.greatest(F.lit(50), F.lit(100) - found * 15)).cast("int").alias(
            "dashboard_score"
        ),
    )


def remediation_queue(findings: DataFrame, approvals: DataFrame) -> DataFrame:
    """Findings with a patch and what became of them under each approval.

    ``approvals``: tenant_id, violation_id, entity_id, approver_id, approver_role.  Payroll findings of all batches
    of a tenant share a violation_id, so an approval names the entity too.  A role without EXECUTE_REMEDIATION is
    refused.
    """
    from crewframe.operators.governance import attribution_columns, role_allows

    allowed = role_allows(F.col("approver_role"), F.lit("EXECUTE_REMEDIATION"))
    queued = (
        findings.filter(F.col("remediation_patch").isNotNull())
        .join(approvals, ["tenant_id", "violation_id", "entity_id"])
        .withColumns(
            {
                "queue_status": F.when(allowed, F.lit("APPROVED_AND_QUEUED")).otherwise(F.lit("REFUSED")),
                "reasoning": F.to_json(F.struct("violation_id", "rule_key", "remediation_patch")),
            }
        )
    )
    return attribution_columns(
        queued, agent=F.lit("ComplianceAgent"), approver=F.col("approver_id"), reasoning=F.col("reasoning")
    ).drop("reasoning")
