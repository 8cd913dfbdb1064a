"""Read landed API responses and strip the vendor's envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crewframe import refdata
from crewframe.functions.payload import as_list, is_array, is_filled, is_object, variant_at


def _first_present(body: Column, names: list[str], otherwise: Column) -> Column:
    """Value under the first of several keys that exists, even if it is null."""
    chain = None
    for name in names:
        value = variant_at(body, name)
        chain = F.when(value.isNotNull(), value) if chain is None else chain.when(value.isNotNull(), value)
    return chain.otherwise(otherwise)


def _with_items(value: Column) -> Column:
    items = variant_at(value, "items")
    return F.when(items.isNotNull(), items).otherwise(value)


def _only_entry(result: Column) -> Column:
    """A one-element list holding a one-key object gives that key's list or object."""
    rows = as_list(result)
    entries = F.try_variant_get(F.get(rows, F.lit(0)), "$", "map<string,variant>")
    inner = F.get(F.map_values(entries), F.lit(0))
    single = (F.size(rows) == 1) & (F.size(entries) == 1) & (is_array(inner) | is_object(inner))
    return F.when(F.coalesce(single, F.lit(False)), inner).otherwise(result)


def unwrap_envelope(body: Column, vendor: str, entity: str = "") -> Column:
    """The domain part of a response; the first rule of the vendor that matches wins."""
    vendor = refdata.vendor_name(vendor)
    data = variant_at(body, "data")
    if vendor == "generic":
        return F.when(data.isNotNull(), _with_items(data)).otherwise(_first_present(body, ["items"], body))
    if vendor == "dynamic":
        found = _first_present(body, ["data", "items", "records", "result", "rows"], body)
        return F.when(
            F.coalesce(*[variant_at(body, k) for k in ("data", "items", "records", "result", "rows")]).isNotNull(),
            _with_items(found),
        ).otherwise(body)
    if vendor == "iceipts":
        rows, items = variant_at(data, "rows"), variant_at(data, "items")
        inside = F.when(is_array(rows), rows).when(is_array(items), items).otherwise(data)
        if entity.upper() == "REQUISITION":
            job = variant_at(data, "job")
            inside = F.when(job.isNotNull(), job).otherwise(inside)
        return F.when(is_object(data), inside).when(is_array(data), data).otherwise(body)
    if vendor == "frappe":
        message = variant_at(body, "message")
        return (
            F.when(data.isNotNull(), data).when(is_object(message) | is_array(message), message).otherwise(body)
        )
    if vendor == "bamboohr":
        return _first_present(body, ["employees", "requests", "jobs", "applications"], body)
    if vendor == "workday":
        return _first_present(body, ["data", "Report_Entry", "items"], body)
    response = variant_at(body, "response")  # zoho
    result, inner = variant_at(response, "result"), variant_at(response, "data")
    return (
        F.when(is_object(response) & result.isNotNull(), _only_entry(result))
        .when(is_object(response) & inner.isNotNull(), inner)
        .when(data.isNotNull(), data)
        .otherwise(body)
    )


def record_list(unwrapped: Column) -> Column:
    """array<variant> of the object records in an unwrapped response."""
    inside = None
    for key in ("items", "rows", "records", "data"):
        value = variant_at(unwrapped, key)
        inside = (
            F.when(is_array(value), as_list(value))
            if inside is None
            else inside.when(is_array(value), as_list(value))
        )
    rows = F.when(is_array(unwrapped), as_list(unwrapped)).otherwise(
        inside.when(is_filled(unwrapped), F.array(unwrapped))
    )
    return F.filter(rows, is_object)


def explode_responses(df: DataFrame, body: str, vendor: str, entity: str) -> DataFrame:
    """One row per record of each response text in column ``body``; unreadable text gives none."""
    others = [c for c in df.columns if c != body]
    return (
        df.withColumn("_body", F.try_parse_json(F.col(body)))
        .withColumn("_unwrapped", unwrap_envelope(F.col("_body"), vendor, entity))
        .select(*others, F.posexplode(record_list(F.col("_unwrapped"))).alias("position", "payload"))
    )


def read_landed(spark: SparkSession, path: str, vendor: str, entity: str, whole_files: bool = False) -> DataFrame:
    """Landed list responses as (file, position, payload variant).

    One response per line is the layout that splits over tasks; ``whole_files`` reads
    pretty-printed dumps, one response per file.
    """
    text = spark.read.text(path, wholetext=whole_files).select("value", F.col("_metadata.file_path").alias("file"))
    return explode_responses(text, "value", vendor, entity)


EMPLOYEE_JSON = (
    "id string, employee_id string, tenant_id string, jurisdiction string, first_name string, last_name string, "
    "basic_salary decimal(18,2), probation_days int, probation_period_days int, is_pf_enrolled boolean, "
    "pf_applicable boolean"
)


def read_employees_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Employee master records for the audit from a JSON array file, or JSON lines for large dumps."""
    return spark.read.schema(EMPLOYEE_JSON).json(path, multiLine=multi_line)
