"""Dry-run checks of a mapping, schema drift and repair of rejected writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewframe import refdata
from crewframe.functions.payload import as_text, is_object, variant_at
from crewframe.operators.findings import text
from crewframe.operators.mapping import Mapping, _is_empty, external_id, mapped_to_text, project


# -------------------------------------------------------------------------------- probe
def probe_issues(
    df: DataFrame, mapping: Mapping, order: str, keys: list[str], required: list[str] | None = None,
    payload: str = "payload",
) -> DataFrame:

# The messages of issues and drift events below must read exactly so.
    """One row per problem: no id, a required field left empty, a required canonical field empty, and as warnings
    dates and numbers that a value map turns into text.

    A record whose own required field is empty has no projection, so it gives one
    ``to_canonical`` issue and no further field checks.  Without keys, no records at all are one issue.
    """
    rows = project(df, mapping, payload)

    def issue(name: str, message: Column, severity: str = "ERROR") -> Column:
        return F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("field"), message.alias("message"))

    broken = F.size("_errors") > 0
    checks = [
        F.when(
            external_id(F.col(payload), mapping).isNull(),
            issue(
                mapping.id_path,
                F.lit(f"{mapping.vendor}/{mapping.entity}: no id at path {mapping.id_path!r}."),
            ),
        ),
        F.when(
            broken,
            issue("to_canonical", text("Unexpected exception during projection: ", F.get("_errors", F.lit(0)))),
        ),
    ]
    by_target = {rule.target: rule for rule in mapping.fields}
    for name in sorted(set(required or []) | {r.target for r in mapping.fields if r.required}):
        rule = by_target.get(name)
        empty = F.lit(True) if rule is None else _is_empty(F.col(f"m_{name}"), rule)
        checks.append(
            F.when(~broken & empty, issue(name, F.lit(f"Required canonical field {name!r} evaluated to empty/None")))
        )
    for rule in mapping.fields:
        wanted = "Decimal" if rule.transform == "decimal" else "date/datetime"
        message = F.lit(f"Field {rule.target!r} expected {wanted}, got str")
        checks.append(
            F.when(~broken & mapped_to_text(F.col(payload), rule), issue(rule.target, message, "WARNING"))
        )
    found = rows.select(
        *keys, F.col(order).alias("sample_index"), F.inline(F.array_compact(F.array(*checks)))
    )
    if keys:
        return found
    nothing = df.agg(F.count("*").alias("_n")).filter(F.col("_n") == 0).select(
        F.lit(None).cast(df.schema[order].dataType).alias("sample_index"), F.lit("ERROR").alias("severity"),
        F.lit("payload").alias("field"), F.lit("Cannot probe mapping: zero sample records provided").alias("message"),
    )
    return found.unionByName(nothing)


def probe_report(df: DataFrame, issues: DataFrame, mapping: Mapping, keys: list[str]) -> DataFrame:
    """Quality score per key group: 1 - 0.25 per error - 0.05 per warning, within 0 and 1.

    ``error_rate`` is ours: the score alone falls to zero with four errors in any number of rows.
    Without keys an empty input still gives one row: invalid, score 0.
    """
    none = F.lit(0).cast("bigint")
    tested = df.groupBy(*keys).agg(
        F.count("*").alias("records_tested"), F.max(none).alias("_errors"), F.max(none).alias("_warnings")
    )
    counted = issues.groupBy(*keys).agg(
        F.max(none).alias("records_tested"),
        F.count_if(F.col("severity") == "ERROR").alias("_errors"),
        F.count_if(F.col("severity") == "WARNING").alias("_warnings"),
    )
    totals = ("records_tested", "_errors", "_warnings")
    joined = tested.unionByName(counted).groupBy(*keys).agg(*[F.coalesce(F.sum(c), none).alias(c) for c in totals])
    errors, warnings = F.col("_errors"), F.col("_warnings")
    some = F.col("records_tested") > 0
    raw = F.round(F.lit(1.0) - (errors * 0.25 + warnings * 0.05), 3)
    return joined.select(
        *keys,
        "records_tested",
        F.lit(len(mapping.fields)).alias("mapped_fields_count"),
        errors.alias("error_count"),
        warnings.alias("warning_count"),
        F.when(some, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).otherwise(F.lit(0.0)).alias("quality_score"),
        (some & (errors == 0)).alias("is_valid"),
        F.when(some, F.round(errors / F.col("records_tested"), 6)).otherwise(F.lit(1.0)).alias("error_rate"),
    )


def projections(df: DataFrame, mapping: Mapping, order: str, limit: int = 5, payload: str = "payload") -> DataFrame:
    """The first records a mapping projects without error (a preview, so the limit is the feature)."""
    rows = project(df, mapping, payload).filter(F.size("_errors") == 0)
    return rows.orderBy(order).limit(limit).select(
        order, *[F.col(f"m_{rule.target}").alias(rule.target) for rule in mapping.fields]
    )


# -------------------------------------------------------------------------------- drift
def detect_unmapped_fields(
    df: DataFrame, mapping: Mapping, order: str, keys: list[str], payload: str = "payload"
) -> DataFrame:
    """Top-level payload keys no rule reads, one INFO event per key group and field."""
    return drift_as_events(unmapped_counts(df, mapping, order, keys, payload), mapping.entity, keys)


def unmapped_counts(
    df: DataFrame, mapping: Mapping, order: str, keys: list[str], payload: str = "payload"
) -> DataFrame:
    """(keys, field_name, occurrences, first): how often a key no rule reads occurs, and its first value by ``order``.

    The known names are a handful of literals, so they are taken out inside the row; only
    drifted keys are exploded, and their counts combine before the shuffle.
    """
    heads = {p.split(".")[0].split("[")[0] for rule in mapping.fields for p in rule.source}
    heads |= {mapping.id_path.split(".")[0].split("[")[0]} | set(refdata.DRIFT_IGNORED_KEYS)
    entries = F.map_filter(
        F.try_variant_get(F.col(payload), "$", "map<string,variant>"),
        lambda key, _: ~key.isin(sorted(heads)) & ~key.startswith("_"),
    )
    return (
        df.select(*keys, F.col(order).alias("_ord"), F.explode(entries).alias("field_name", "_value"))
        .withColumn("_sample", as_text(F.col("_value")))
        .groupBy(*keys, "field_name")
        .agg(F.count("*").alias("occurrences"), F.min(F.struct(F.col("_ord").alias("at"), F.col("_sample").alias("sample"))).alias("first"))
    )


def drift_as_events(found: DataFrame, entity: str, keys: list[str]) -> DataFrame:
    """Counts of :func:`unmapped_counts`, of one run or of many, as events with the first sample in a patch."""
    name = F.col("field_name")
    merged = found.groupBy(*keys, "field_name").agg(F.sum("occurrences").alias("occurrences"), F.min("first").alias("first"))
    return merged.withColumn("sample_value", F.col("first.sample")).select(
        *keys,
        F.lit(entity).alias("entity_type"),
        F.lit("INFO").alias("severity"),
        "field_name",
        text("Host response contains unmapped field '", name, "'. Consider synthesizing canonical binding.").alias("description"),
        F.to_json(
            F.struct(F.lit("ADD_MAPPING").alias("action"), name.alias("host_field"), F.col("sample_value"))
        ).alias("suggested_patch"),
        "occurrences",
    )


def diagnose_rejections(df: DataFrame, error: str = "error", entity: str = "entity_type", status: str = "status_code") -> DataFrame:
    """A CRITICAL event per rejected write, naming the field its error text quotes."""
    body = F.try_parse_json(F.col(error))
    said = lambda key: F.nullif(as_text(variant_at(body, key)), F.lit(""))
    message = F.when(
        is_object(body),
        F.coalesce(*[said(k) for k in ("message", "error_message", "detail", "error")], F.col(error)),
    ).otherwise(F.coalesce(F.col(error), F.lit("")))
    lowered = F.lower(F.col("_message"))
    told = F.lit(False)
    for phrase in refdata.REJECTION_PHRASES:
        told = told | F.contains(lowered, F.lit(phrase))
    quoted = F.get(F.regexp_extract_all("_message", F.lit("['\"]([a-zA-Z0-9_-]+)['\"]"), F.lit(1)), F.lit(0))
    name = F.col("field_name")
    return (
        df.withColumn("_message", message)
        .withColumn("field_name", F.coalesce(F.when(told, quoted), F.lit("unknown_field")))
        .withColumns(
            {
                "severity": F.lit("CRITICAL"),
                "description": text("Host HTTP ", F.col(status), " schema rejection: ", F.substring("_message", 1, 120)),
                "suggested_patch": F.to_json(
                    F.struct(
                        F.lit("ADD_REQUIRED_FIELD").alias("action"), name.alias("missing_field"),
                        F.col(entity).alias("endpoint_type"),
                    )
                ),
            }
        )
        .drop("_message")
    )


def remediation_delta(events: DataFrame, entity: str = "entity_type") -> DataFrame:
    """Patch rows for drift events."""
    return events.select(
        *[c for c in events.columns if c not in (entity, "severity", "description", "suggested_patch", "field_name")],
        F.lit("1.0.0").alias("patch_version"),
        F.col(entity).alias("target_entity"),
        "field_name",
        F.col("suggested_patch").alias("patch_instruction"),
        F.lit("APPLIED").alias("status"),
    )


# ------------------------------------------------------------------------------- repair
def error_message(body: Column, vendor: str, default: str = "") -> Column:
    """Readable message of a vendor's error response."""
    if refdata.vendor_name(vendor) == "zoho":
        response = variant_at(body, "response")
        errors = variant_at(response, "errors")
        own = variant_at(errors, "message")
        return F.coalesce(
            F.when(
                is_object(response),
                F.coalesce(
                    F.when(is_object(errors), as_text(own)), as_text(errors), as_text(variant_at(response, "message"))
                ),
            ),
            as_text(variant_at(body, "message")),
            F.lit(default),
        )
    found = []
    for key in ("error_message", "message", "error", "detail", "status"):
        value = variant_at(body, key)
        found.append(F.when((F.schema_of_variant(value) == "STRING") & (as_text(value) != ""), as_text(value)))
    return F.coalesce(*found, F.lit(default))


def repair_rejected(
    df: DataFrame, vendor: str, entity: str, payload: str = "payload", error: str = "error",
    company: str = "Standard Company", department: str = "General",
) -> DataFrame:
    """Add what a rejected payload lacks according to its error text; ``repaired`` is null otherwise."""
    vendor = refdata.vendor_name(vendor)
    fields = F.try_variant_get(F.col(payload), "$", "map<string,variant>")
    said = F.lower(F.coalesce(F.col(error), F.lit("")))
    lacks = lambda word, key: F.contains(said, F.lit(word)) & ~F.map_contains_key(fields, key)
    value = lambda literal: F.parse_json(F.to_json(F.array(F.lit(literal))))
    constant = lambda literal: F.try_variant_get(value(literal), "$[0]", "variant")
    additions: list[tuple[Column, str, Column]] = []
    if vendor == "frappe":
        series = "EMP-" if entity.upper() == "EMPLOYEE" else "HR-"
        additions = [
            (lacks("company", "company"), "company", constant(company)),
            (lacks("naming_series", "naming_series"), "naming_series", constant(series)),
        ]
    elif vendor == "zoho":
        first = F.try_element_at(fields, F.lit("FirstName"))
        additions = [
            (lacks("department", "Department"), "Department", constant(department)),
            (lacks("lastname", "LastName") & first.isNotNull(), "LastName", first),
        ]
    if not additions:
        return df.withColumns({"is_repairable": F.lit(False), "repaired": F.lit(None).cast("string")})
    needed = additions[0][0]
    for condition, _, _ in additions[1:]:
        needed = needed | condition
    extra = F.array_compact(
        F.array(*[F.when(c, F.struct(F.lit(k).alias("key"), v.alias("value"))) for c, k, v in additions])
    )
    healed = F.to_json(F.to_variant_object(F.map_concat(fields, F.map_from_entries(extra))))
    return df.withColumns(
        {"is_repairable": F.coalesce(needed, F.lit(False)), "repaired": F.when(needed, healed)}
    )
