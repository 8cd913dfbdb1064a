"""Landing, profiling, matching, mapping, quality, drift, export and log queries."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import functions as F

from crewframe import refdata
from crewframe.operators import compliance
from crewframe.operators import mapping as mp
from crewframe.operators import matching, profiling, quality
from crewframe.operators.findings import attach_citation
from crewframe.plans import adapters as ad
from crewframe.plans.audit_queries import FINDINGS
from crewframe.plans.registry import query
from crewframe.plans.sqlviews import listed, pick, text, with_views
from crewframe.session import cut, scratch
from crewframe.sources import export, landed, tables

# ------------------------------------------------------------------------------- landing
PAGE = 50  # records per landed response


def _pages(spark, sf_dir, envelope):
    """Customers as landed responses of one vendor, fifty records to a page."""
    record = F.to_variant_object(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    pages = (
        ad.table(spark, sf_dir, "customer")
        .groupBy(F.floor(F.col("c_custkey") / PAGE).alias("page"))
        .agg(F.to_json(F.collect_list(record)).alias("_list"))
    )
    head, tail = envelope.split("@")
    return pages.select("page", F.concat(F.lit(head), "_list", F.lit(tail)).alias("body"))


# Where each vendor keeps its records; @ stands for the list.
ENVELOPES = {
    "generic": '{"status":"ok","data":{"items":@,"total":9}}',
    "dynamic": '{"records":{"items":@}}',
    "iceipts": '{"success":true,"data":{"rows":@}}',
    "frappe": '{"message":@}',
    "bamboohr": '{"fields":[],"employees":@}',
    "workday": '{"Report_Entry":@}',
    "zoho": '{"response":{"result":[{"rec":@}]}}',
}


def _landed(vendor):
    @query(
        f"landed_{vendor}",
        f"SELECT c_custkey // {PAGE} AS page, {text(vendor)} AS vendor, c_custkey AS record_id, c_name AS name FROM customer",
    )
    def landed_records(spark, sf_dir):
        rows = landed.explode_responses(_pages(spark, sf_dir, ENVELOPES[vendor]), "body", vendor, "EMPLOYEE")
        return rows.select(
            "page",
            F.lit(vendor).alias("vendor"),
            F.try_variant_get("payload", "$.id", "bigint").alias("record_id"),
            F.try_variant_get("payload", "$.name", "string").alias("name"),
        )

    landed_records.__doc__ = f"Records of every landed {vendor} response."


for _vendor in ENVELOPES:
    _landed(_vendor)



@query("landed_files", "SELECT c_custkey AS record_id, c_name AS name FROM customer")
def landed_files(spark, sf_dir):
    """Write every response as a line of landed text files, read the files and unwrap them."""
    folder = scratch(spark, "landed-files")
    _pages(spark, sf_dir, ENVELOPES["bamboohr"]).select("body").write.text(folder)
    rows = landed.read_landed(spark, folder, "bamboohr", "EMPLOYEE")
    return rows.select(
        F.try_variant_get("payload", "$.id", "bigint").alias("record_id"),
        F.try_variant_get("payload", "$.name", "string").alias("name"),
    )


@query(
    "employees_json_audit",
    with_views(["employees"], "SELECT tenant_id, violation_id, severity, statutory_citation FROM found", FINDINGS),
)
def employees_json_audit(spark, sf_dir):
    """Write the staff master as JSON, read it with the audit schema and audit it."""
    folder = scratch(spark, "staff-json")
    ad.employees(spark, sf_dir).drop("employee_id", "tenure_years", "on_probation").write.json(folder)
    staff = landed.read_employees_json(spark, folder, multi_line=False)
    return attach_citation(compliance.audit_employees(staff).drop("statutory_citation")).select(
        "tenant_id", "violation_id", "severity", "statutory_citation"
    )


@query(
    "employees_array_audit",
    with_views(["employees"], "SELECT tenant_id, violation_id, severity, statutory_citation FROM found", FINDINGS),
)
def employees_array_audit(spark, sf_dir):
    """The same from files that each hold one JSON array over several lines, as the audit's input file does."""
    folder = scratch(spark, "staff-arrays")
    staff = ad.employees(spark, sf_dir)
    record = F.to_json(F.struct([c for c in staff.columns if c not in ("employee_id", "tenure_years", "on_probation")]))
    files = staff.select(F.floor(F.col("employee_id") / 500).alias("file"), record.alias("record")).groupBy("file")
    body = F.concat(F.lit("[\n  "), F.array_join(F.collect_list("record"), ",\n  "), F.lit("\n]"))
    files.agg(body.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(folder)
    staff = landed.read_employees_json(spark, folder)
    return attach_citation(compliance.audit_employees(staff).drop("statutory_citation")).select(
        "tenant_id", "violation_id", "severity", "statutory_citation"
    )


# -------------------------------------------------------------------- profile and match
KEYS = ["tenant_id", "vendor", "entity_type"]
# field -> (type, value as text, nullable text) of the staff records, for the SQL side
STAFF_FIELDS = {
    "badge_no": ("string", "badge_no"),
    "doj": ("date", "doj"),
    "email": ("string", "email"),
    "emp_id": ("integer", "k::VARCHAR"),
    "first_name": ("string", "first_name"),
    "is_manager": ("boolean", "CASE WHEN is_manager THEN 'True' ELSE 'False' END"),
    "last_name": ("string", "last_name"),
    "pay": ("object", """'{"base_cents":' || base_cents || ',"unit":"INR"}'"""),
    "skills": ("array", """CASE WHEN k % 5 = 0 THEN '["sql","spark"]' ELSE '["java"]' END"""),
}
UNPIVOT = (
    "cells AS ("
    + " UNION ALL ".join(
        f"SELECT tenant_id, k, {text(f)} AS field, {text(t)} AS t, {v} AS v FROM staff" for f, (t, v) in STAFF_FIELDS.items()
    )
    + """ UNION ALL SELECT tenant_id, k, 'status_code', CASE WHEN status_code = 'notice' THEN 'string' ELSE 'integer' END, status_code FROM staff)"""
)


FIELD_PROFILE = with_views(
    ["staff"],
    """SELECT c.tenant_id AS tenant_id, 'hostco' AS vendor, 'EMPLOYEE' AS entity_type, field, arg_min(t, k) AS data_type,
      count(*) < any_value(n) AS is_nullable, count(*) = any_value(n) AS is_required,
      CASE WHEN count(DISTINCT v) <= 12 THEN array_to_string(list_sort(list_distinct(list(v))), '|') ELSE '' END AS enum_values,
      array_to_string(list(v ORDER BY k)[1:3], '|') AS sample_values, count(*) AS non_null_count, any_value(n) AS record_count
    FROM cells c JOIN (SELECT tenant_id, count(*) AS n FROM staff GROUP BY 1) s ON c.tenant_id = s.tenant_id
    WHERE v IS NOT NULL GROUP BY 1, 2, 3, 4""",
    UNPIVOT,
)


@query("field_profile", FIELD_PROFILE)
def field_profile(spark, sf_dir):
    """Profile of every field of every tenant's staff records."""
    return profiling.profile_records(ad.staff_payloads(spark, sf_dir), KEYS, "employee_id")


@query("merged_profile", FIELD_PROFILE)
def merged_profile(spark, sf_dir):
    """The same from two landings: each is profiled alone and stored, then only the stored parts are merged."""
    records = ad.staff_payloads(spark, sf_dir)
    first = F.col("employee_id") % 3 == 0
    stored = [cut(profiling.profile_parts(records.filter(part), KEYS, "employee_id")) for part in (first, ~first)]
    return profiling.finished_profile(profiling.merge_parts(stored[0].unionByName(stored[1]), KEYS), KEYS)


ID_NAMES = listed([name.format(entity="employee") for name in refdata.ID_FIELDS])


@query(
    "id_fields",
    with_views(
        ["staff"],
        f"""SELECT tenant_id, 'hostco' AS vendor, 'EMPLOYEE' AS entity_type, arg_min(field, list_position({ID_NAMES}, field)) AS id_field
          FROM cells WHERE v IS NOT NULL AND list_contains({ID_NAMES}, field) GROUP BY tenant_id""",
        UNPIVOT,
    ),
)
def id_fields(spark, sf_dir):
    """The id field of every tenant's staff records."""
    profile = profiling.profile_records(ad.staff_payloads(spark, sf_dir), KEYS, "employee_id")
    return profiling.pick_id_field(profile, KEYS)


def _matched(spark, sf_dir):
    """The profile is read several times from here on, so it is stored first."""
    profile = cut(profiling.profile_records(ad.staff_payloads(spark, sf_dir), KEYS, "employee_id"))
    return profile, matching.match_fields(profile, KEYS)


def _spec_sql(entity: str) -> str:
    rows = [r for r in refdata.canonical_spec() if r["entity"] == entity]
    return "spec(position, target, transform, syns, pair) AS (VALUES " + ", ".join(
        f"({r['position']}, {text(r['target'])}, {text(r['transform'])}, {listed(r['synonyms'])}, {str(bool(r['compound'])).lower()})"
        for r in rows
    ) + ")"


def _norm(value: str) -> str:
    return f"regexp_replace(lower({value}), '[^a-z0-9]', '', 'g')"


def _name_part(index: int, own: str) -> str:
    names = listed([_plain_name(n) for n in [own, *refdata.NAME_PART_SYNONYMS[index]]])
    return f"arg_min(field, (list_position({names}, {_norm('field')}), field)) FILTER (WHERE list_contains({names}, {_norm('field')}))"


def _plain_name(name: str) -> str:
    return name.replace("_", "").lower()


def _matches_sql(cells: str, entity: str) -> str:
    """One recursion step per target in spec order, carrying the host fields already used."""
    return (
        cells
        + f""",
fields AS (SELECT DISTINCT tenant_id, field FROM cells WHERE v IS NOT NULL),
{_spec_sql(entity)},
pairs AS (SELECT tenant_id, {_name_part(0, "first_name")} AS a, {_name_part(1, "last_name")} AS b, list(field) AS all_fields
  FROM fields GROUP BY tenant_id),
cand AS (
  SELECT tenant_id, position, target, 1 AS level, 0 AS ord, '' AS host, [a, b] AS source, 0.95 AS confidence, 'join_names' AS transform
  FROM pairs, spec WHERE pair AND a IS NOT NULL AND b IS NOT NULL AND NOT list_contains(all_fields, target)
  UNION ALL
  SELECT tenant_id, position, target, level, CASE WHEN level = 2 THEN ex ELSE 0 END, field, [field],
    CASE level WHEN 2 THEN CASE WHEN lower(field) = target THEN 1.0 ELSE 0.95 END WHEN 3 THEN CASE WHEN same THEN 0.90 ELSE 0.85 END ELSE 0.75 END,
    transform
  FROM (
    SELECT *, CASE WHEN ex > 0 THEN 2 WHEN same OR near THEN 3 WHEN part THEN 4 END AS level FROM (
      SELECT tenant_id, field, position, target, transform,
        coalesce(list_position(list_transform(syns, lambda s: lower(s)), lower(field)), 0) AS ex,
        {_norm('field')} = {_norm('target')} AS same,
        list_contains(list_transform(syns, lambda s: {_norm('s')}), {_norm('field')}) AS near,
        len(list_filter(syns, lambda s: (contains(lower(field), lower(s)) OR contains(lower(s), lower(field)))
          AND len(s) >= 4 AND len(field) >= 4)) > 0 AS part
      FROM fields, spec)) WHERE level IS NOT NULL),
steps AS (
  SELECT tenant_id, -1 AS at, []::VARCHAR[] AS used, NULL::STRUCT(target VARCHAR, source VARCHAR[], confidence DOUBLE, transform VARCHAR) AS pick
  FROM pairs
  UNION ALL
  SELECT s.tenant_id, s.at + 1,
    CASE WHEN count(c.target) = 0 THEN any_value(s.used)
      ELSE list_concat(any_value(s.used), arg_min(c.source, (c.level, c.ord, c.host))) END,
    CASE WHEN count(c.target) = 0 THEN NULL ELSE arg_min({{'target': c.target, 'source': c.source, 'confidence': c.confidence::DOUBLE,
      'transform': c.transform}}, (c.level, c.ord, c.host)) END
  FROM steps s LEFT JOIN cand c ON c.tenant_id = s.tenant_id AND c.position = s.at + 1
    AND (c.level = 1 OR NOT list_contains(s.used, c.host))
  WHERE s.at < (SELECT max(position) FROM spec)
  GROUP BY s.tenant_id, s.at),
picked AS (SELECT tenant_id, pick.target AS target, pick.source AS source, pick.confidence AS confidence, pick.transform AS transform
  FROM steps WHERE pick IS NOT NULL)"""
    )


MATCHES = _matches_sql(UNPIVOT, "EMPLOYEE")


def _enums_sql(entity: str) -> str:
    """enums: the aligned values of each picked target, from the host's few values and the canonical keys in test order."""
    keys = [
        f"({text(target)}, {n}, {text(key)}, {text(value)})"
        for (owner, target), values in refdata.CANONICAL_ENUMS.items() if owner == entity
        for n, (key, value) in enumerate(values.items())
    ]
    return f"""
enum_keys(target, n, key, value) AS (VALUES {", ".join(keys)}),
host_values AS (SELECT DISTINCT p.tenant_id, p.target, c.v FROM picked p JOIN cells c ON c.tenant_id = p.tenant_id AND c.field = p.source[1]
  WHERE c.v IS NOT NULL),
few AS (SELECT tenant_id, target FROM host_values GROUP BY 1, 2 HAVING count(*) <= 12),
aligned AS (SELECT h.tenant_id, h.target, h.v, arg_min(k.value, (upper(trim(h.v)) <> k.key, k.n)) AS value
  FROM host_values h JOIN few USING (tenant_id, target) JOIN enum_keys k ON k.target = h.target
    AND (contains(upper(trim(h.v)), k.key) OR contains(k.key, upper(trim(h.v)))) GROUP BY 1, 2, 3),
enums AS (SELECT tenant_id, target, string_agg(v || '=' || value, '|' ORDER BY v || '=' || value) AS enum_map FROM aligned GROUP BY 1, 2)"""


MATCHED_ROWS = """SELECT p.tenant_id AS tenant_id, p.target AS target, array_to_string(source, '|') AS source, confidence, transform,
  coalesce(enum_map, '') AS enum_map, confidence >= 0.8 AND len(source) = 1 AS writeback
FROM picked p LEFT JOIN enums e ON e.tenant_id = p.tenant_id AND e.target = p.target"""


@query(
    "field_matches",
    with_views(
        ["staff"],
        MATCHED_ROWS,
        MATCHES + "," + _enums_sql("EMPLOYEE"),
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def field_matches(spark, sf_dir):
    """Canonical target of every tenant's fields."""
    return _matches_out(_matched(spark, sf_dir)[1])


def _matches_out(matches):
    pairs = F.array_sort(F.transform(F.map_entries("enum_map"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return matches.select(
        "tenant_id", "target", "source", "confidence", "transform", F.array_join(pairs, "|").alias("enum_map"), "writeback"
    )


@query(
    "match_report",
    with_views(
        ["staff"],
        """SELECT p.tenant_id AS tenant_id, 'hostco' AS vendor, 'EMPLOYEE' AS entity_type, round(avg(confidence), 3) AS average_confidence,
          count(*) AS mapped_count,
          (SELECT array_to_string(list(target ORDER BY position), '|') FROM spec
            WHERE target NOT IN (SELECT target FROM picked q WHERE q.tenant_id = p.tenant_id)) AS unmapped_canonical_fields,
          (SELECT count(*) FROM fields f WHERE f.tenant_id = p.tenant_id
            AND f.field NOT IN (SELECT unnest(source) FROM picked q WHERE q.tenant_id = p.tenant_id)) AS unmapped_host_count,
          count(*) FILTER (WHERE confidence >= 0.8 AND len(source) = 1) AS writeback_count
        FROM picked p GROUP BY p.tenant_id""",
        MATCHES,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def match_report(spark, sf_dir):
    """Confidence and gaps of every tenant's mapping."""
    profile, matches = _matched(spark, sf_dir)
    return matching.match_report(profile, cut(matches), KEYS)


# Records of other entities, field by field: entity -> table, key, tenant, and SQL of each host field.
HOST_RECORDS = {
    "LEAVE_REQUEST": (
        "orders", "o_orderkey", "o_custkey % 3",
        {
            "empId": "o_custkey", "leaveType": "o_orderpriority", "fromDate": "o_orderdate", "leave_to": "o_orderdate",
            "duration": "o_orderkey % 9 + 1", "justification_text": "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END",
            "approval_status": "CASE o_orderstatus WHEN 'O' THEN 'submitted' WHEN 'F' THEN 'Approved' ELSE 'withdrawn' END",
        },
    ),
    "EXPENSE_CLAIM": (
        "lineitem", "l_orderkey", "l_suppkey % 4",
        {
            "claimant_id": "l_suppkey", "expenseType": "CASE l_returnflag WHEN 'N' THEN 'meal' ELSE 'hotel' END", "claim_amount": "l_quantity", "curr": "CASE WHEN l_linenumber > 1 THEN 'INR' END",
            "incurred_on": "l_shipdate", "purpose_of_trip": "l_linestatus",
            "claim_state": "l_returnflag", "claim-status": "CASE l_linestatus WHEN 'O' THEN ' draft ' ELSE 'reimbursed late' END",
        },
    ),
    "PUNCH": (
        "events", "event_id", "user_id % 5",
        {
            "user_id": "user_id", "logTime": "ts", "direction": "CASE WHEN event_id % 2 = 0 THEN 'in' ELSE 'CheckOut' END",
            "terminal": "CASE WHEN event_id % 7 = 0 THEN 'gate' END", "reader_id": "event_id % 11",
        },
    ),
}


def _host_cells(entity: str) -> str:
    source, _, tenant, fields = HOST_RECORDS[entity]
    rows = (f"SELECT 'T' || ({tenant}) AS tenant_id, {text(f)} AS field, ({v})::VARCHAR AS v FROM {source}" for f, v in fields.items())
    return "cells AS (" + " UNION ALL ".join(rows) + ")"


def _entity_matches(name: str, entity: str):
    source, key, tenant, fields = HOST_RECORDS[entity]

    @query(
        name,
        "WITH RECURSIVE " + _matches_sql(_host_cells(entity), entity) + "," + _enums_sql(entity)
        + "\n" + MATCHED_ROWS,
    )
    def entity_matches(spark, sf_dir):
        record = F.struct(*[F.expr(f"CAST({v} AS STRING)").alias(f) for f, v in fields.items()])
        rows = ad.table(spark, sf_dir, source).select(
            F.concat(F.lit("T"), F.expr(tenant).cast("string")).alias("tenant_id"), F.lit("hostco").alias("vendor"),
            F.lit(entity).alias("entity_type"), F.expr(key).alias("record_id"), F.try_parse_json(F.to_json(record)).alias("payload"),
        )
        profile = cut(profiling.profile_records(rows, KEYS, "record_id"))
        return _matches_out(matching.match_fields(profile, KEYS))

    entity_matches.__doc__ = f"Canonical target of every field of landed {entity} records."


for _name, _entity in (("leave_field_matches", "LEAVE_REQUEST"), ("expense_field_matches", "EXPENSE_CLAIM"), ("punch_field_matches", "PUNCH")):
    _entity_matches(_name, _entity)


# ------------------------------------------------------------------------------- mapping
STAFF_MAPPING = mp.Mapping(
    vendor="hostco",
    entity="EMPLOYEE",
    id_path="emp_id",
    fields=(
        mp.FieldRule("full_name", ("first_name", "last_name"), "join_names", required=True),
        mp.FieldRule("work_email", "email", "strip", required=True),
        mp.FieldRule("status", "status_code", "upper", values={"1": "ACTIVE", "2": "PROBATION", "NOTICE": "NOTICE_PERIOD"}),
        mp.FieldRule("salary", "pay.base_cents", "decimal"),
        mp.FieldRule("currency", ("pay.curr", "pay.unit"), "strip", default="USD"),
        mp.FieldRule("joining_date", "doj", "date"),
        mp.FieldRule("designation", "skills[0]", "upper"),
    ),
    writeback={
        "work_email": "contact.email", "employment_status": "status_code", "joining_date": "doj", "currency": "pay.unit",
    },
)
STATUS = "CASE status_code WHEN '1' THEN 'ACTIVE' WHEN '2' THEN 'PROBATION' ELSE 'NOTICE_PERIOD' END"


def _canonical(spark, sf_dir):
    return mp.to_canonical(ad.staff_payloads(spark, sf_dir), STAFF_MAPPING, tenant=F.col("tenant_id"))


CANONICAL = with_views(
    ["staff"],
    f"""SELECT tenant_id, 'hostco:EMPLOYEE:' || k AS source_ref, first_name || ' ' || last_name AS full_name, trim(email) AS work_email,
          {STATUS} AS employment_status, base_cents::DOUBLE AS salary, 'INR' AS currency, doj AS joining_date,
          CASE WHEN k % 5 = 0 THEN 'SQL' ELSE 'JAVA' END AS designation
        FROM staff WHERE email IS NOT NULL""",
)


def _canonical_out(good):
    return good.select(
        "tenant_id",
        F.concat_ws(":", "source_ref.vendor", "source_ref.entity_type", "source_ref.external_id").alias("source_ref"),
        "full_name", "work_email", "employment_status", "salary", "currency", "joining_date", "designation",
    )


@query("canonical_employees", CANONICAL)
def canonical_employees(spark, sf_dir):
    """Canonical employees of every accepted staff record."""
    return _canonical_out(_canonical(spark, sf_dir)[0])


@query("catalog_employees", CANONICAL)
def catalog_employees(spark, sf_dir):
    """The same with the mapping out of a catalog that was saved twice: the later one is listed and loaded."""
    folder = scratch(spark, "catalog")
    older = replace(STAFF_MAPPING, fields=STAFF_MAPPING.fields[:3], writeback={})
    mp.save_mappings(spark, folder, "T0", [older], datetime(2024, 1, 1))
    mp.save_mappings(spark, folder, "T0", [STAFF_MAPPING], datetime(2024, 6, 1))
    listed_now = mp.list_mappings(spark.read.parquet(folder), "T0")
    loaded = mp.load_mapping(listed_now, "T0", "HostCo", "employee")
    good, _ = mp.to_canonical(ad.staff_payloads(spark, sf_dir), loaded, tenant=F.col("tenant_id"))
    return _canonical_out(good)


@query(
    "unknown_entity_rules",
    """WITH e AS (SELECT event_type, unnest(json_keys(j)) AS field, j FROM (
        SELECT event_type, json_object('event_id', event_id, 'user_id', user_id, 'value', value, 'kind', event_type, 'flag', user_id % 2 = 0) AS j
        FROM events)),
    t AS (SELECT event_type, field, min(json_type(j, '$.' || field)) AS kind FROM e GROUP BY 1, 2)
    SELECT event_type, field AS target, field AS source, CASE WHEN kind IN ('UBIGINT', 'BIGINT') THEN 'int' WHEN kind = 'DOUBLE' THEN 'decimal'
        WHEN kind = 'BOOLEAN' THEN 'bool' ELSE 'strip' END AS transform, 1.0::DOUBLE AS confidence, true AS writeback
    FROM t""",
)
def unknown_entity_rules(spark, sf_dir):
    """One-to-one rules for an entity without a canonical spec: events as landed records, by type."""
    record = F.struct(
        "event_id", "user_id", "value", F.col("event_type").alias("kind"), (F.col("user_id") % 2 == 0).alias("flag")
    )
    rows = ad.table(spark, sf_dir, "events").select(
        "event_type", F.lit("hostco").alias("vendor"), F.lit("TELEMETRY").alias("entity_type"), "event_id",
        F.parse_json(F.to_json(record)).alias("payload"),
    )
    keys = ["event_type", "vendor", "entity_type"]
    profile = cut(profiling.profile_records(rows, keys, "event_id"))
    rules = matching.match_fields(profile, keys)
    return rules.select("event_type", "target", F.array_join("source", "|").alias("source"), "transform", "confidence", "writeback")


@query(
    "canonical_table",
    with_views(
        ["staff"],
        """SELECT tenant_id, count(*) AS employees, sum(base_cents)::DOUBLE AS salary FROM staff
        WHERE email IS NOT NULL GROUP BY tenant_id""",
    ),
)
def canonical_table(spark, sf_dir):
    """Write the canonical table by tenant and entity and read the entity's folders back."""
    folder = scratch(spark, "canonical")
    tables.write_canonical(_canonical(spark, sf_dir)[0], folder)
    stored = spark.read.parquet(folder).filter(F.col("entity_type") == "EMPLOYEE")
    return stored.groupBy("tenant_id").agg(F.count("*").alias("employees"), F.sum("salary").alias("salary"))


@query(
    "canonical_rejects",
    with_views(
        ["staff"],
        """SELECT tenant_id, k AS employee_id, 'required field ''work_email'' is empty; looked in [''email'']' AS errors
        FROM staff WHERE email IS NULL""",
    ),
)
def canonical_rejects(spark, sf_dir):
    """Staff records without a required field, with the reason."""
    return _canonical(spark, sf_dir)[1].select("tenant_id", "employee_id", "errors")


@query(
    "vendor_writeback",
    with_views(
        ["staff"],
        f"""SELECT tenant_id, '{{"contact":{{"email":"' || trim(email) || '"}},"status_code":"' || {STATUS} || '","doj":"' || doj
          || '","pay":{{"unit":"INR"}}}}' AS payload FROM staff WHERE email IS NOT NULL""",
    ),
)
def vendor_writeback(spark, sf_dir):
    """Canonical employees projected back to the vendor's write paths."""
    return mp.to_vendor(_canonical(spark, sf_dir)[0], STAFF_MAPPING, keep=["tenant_id"])


PROBE = """issues AS (
  SELECT tenant_id, k AS sample_index, 'ERROR' AS severity, 'to_canonical' AS field,
    'Unexpected exception during projection: required field ''work_email'' is empty; looked in [''email'']' AS message
  FROM staff WHERE email IS NULL)"""


def _probe(spark, sf_dir):
    rows = ad.staff_payloads(spark, sf_dir)
    return rows, quality.probe_issues(rows, STAFF_MAPPING, "employee_id", ["tenant_id"], ["salary"])


@query("mapping_issues", with_views(["staff"], "SELECT * FROM issues", PROBE))
def mapping_issues(spark, sf_dir):
    """Problems a dry run of the mapping finds in every staff record."""
    return _probe(spark, sf_dir)[1]


@query(
    "mapping_quality",
    with_views(
        ["staff"],
        """SELECT s.tenant_id AS tenant_id, n AS records_tested, 7::BIGINT AS mapped_fields_count, e AS error_count, 0::BIGINT AS warning_count,
          greatest(0.0, least(1.0, round(1 - 0.25 * e, 3)))::DOUBLE AS quality_score, e = 0 AS is_valid,
          round(e::DOUBLE / n, 6) AS error_rate
        FROM (SELECT tenant_id, count(*) AS n, count(*) FILTER (WHERE email IS NULL) AS e FROM staff GROUP BY 1) s""",
    ),
)
def mapping_quality(spark, sf_dir):
    """Score of the mapping per tenant."""
    rows, issues = _probe(spark, sf_dir)
    return quality.probe_report(rows, issues, STAFF_MAPPING, ["tenant_id"])


# first segments of every path that a rule reads
KNOWN_HEADS = {
    path.replace("[", ".").split(".")[0]
    for rule in STAFF_MAPPING.fields for path in ((rule.source,) if isinstance(rule.source, str) else rule.source)
} | {STAFF_MAPPING.id_path, *refdata.DRIFT_IGNORED_KEYS}
DRIFT = """SELECT tenant_id, 'EMPLOYEE' AS entity_type, 'INFO' AS severity, field_name,
  'Host response contains unmapped field ''' || field_name || '''. Consider synthesizing canonical binding.' AS description,
  '{"action":"ADD_MAPPING","host_field":"' || field_name || '","sample_value":"' || arg_min(v, k) || '"}' AS suggested_patch,
  count(*) AS occurrences
FROM (SELECT tenant_id, k, field AS field_name, CASE WHEN t = 'boolean' THEN lower(v) ELSE v END AS v FROM cells
  WHERE v IS NOT NULL AND NOT starts_with(field, '_') AND NOT list_contains({known}, field))
GROUP BY tenant_id, field_name""".replace("{known}", listed(sorted(KNOWN_HEADS)))
DRIFT = with_views(["staff"], DRIFT, UNPIVOT)


@query("unmapped_fields", DRIFT)
def unmapped_fields(spark, sf_dir):
    """Fields of the staff records no rule reads."""
    return quality.detect_unmapped_fields(ad.staff_payloads(spark, sf_dir), STAFF_MAPPING, "employee_id", ["tenant_id"])


REJECTED = f"""WITH r AS (
  SELECT o_orderkey AS order_id, {pick(['EMPLOYEE', 'LEAVE_REQUEST', 'REQUISITION'], 'o_orderkey % 3')} AS entity_type,
    CASE WHEN o_orderkey % 2 = 0 THEN 400 ELSE 422 END AS status_code, o_orderkey % 4 AS kind, o_custkey, o_orderpriority
  FROM orders),
e AS (SELECT *, {pick(['departmentId', 'start_date', 'unknown_field', 'email'], 'kind')} AS field_name,
  {pick(["'departmentId' cannot be null or is required", 'Invalid parameter "start_date" given',
         "LastName and Department are mandatory, see company and naming_series", "plain text: missing required field 'email'"],
        'kind')} AS said FROM r)"""


@query(
    "rejection_events",
    f"""{REJECTED} SELECT order_id, entity_type, field_name, 'CRITICAL' AS severity,
      'Host HTTP ' || status_code || ' schema rejection: ' || said AS description,
      '{{"action":"ADD_REQUIRED_FIELD","missing_field":"' || field_name || '","endpoint_type":"' || entity_type || '"}}' AS suggested_patch
    FROM e""",
)
def rejection_events(spark, sf_dir):
    """The field every rejected write lacks."""
    return quality.diagnose_rejections(ad.order_rejections(spark, sf_dir).drop("body")).drop("error", "status_code")


@query(
    "remediation_patches",
    f"""{REJECTED} SELECT order_id, '1.0.0' AS patch_version, entity_type AS target_entity, field_name,
      '{{"action":"ADD_REQUIRED_FIELD","missing_field":"' || field_name || '","endpoint_type":"' || entity_type || '"}}' AS patch_instruction,
      'APPLIED' AS status FROM e""",
)
def remediation_patches(spark, sf_dir):
    """Patch row of every rejection event."""
    rejected = ad.order_rejections(spark, sf_dir).drop("body")
    return quality.remediation_delta(quality.diagnose_rejections(rejected).drop("error", "status_code"))


def _repair_sql(vendor: str) -> str:
    if vendor == "frappe":
        healed = """CASE WHEN kind <> 2 THEN '' WHEN order_id % 5 = 0 THEN '{"company":"Acme","cust":' || o_custkey || ',"naming_series":"EMP-"}'
          ELSE '{"FirstName":"' || o_orderpriority || '","company":"Standard Company","cust":' || o_custkey || ',"naming_series":"EMP-"}' END"""
    else:
        healed = """CASE WHEN kind = 2 OR kind = 0 THEN CASE
            WHEN order_id % 5 = 0 THEN '{"Department":"General","company":"Acme","cust":' || o_custkey || '}'
            WHEN kind = 0 THEN '{"Department":"General","FirstName":"' || o_orderpriority || '","cust":' || o_custkey || '}'
            ELSE '{"Department":"General","FirstName":"' || o_orderpriority || '","LastName":"' || o_orderpriority
              || '","cust":' || o_custkey || '}' END ELSE '' END"""
    return f"{REJECTED} SELECT order_id, {healed} <> '' AS is_repairable, {healed} AS repaired FROM e"


def _repaired(vendor):
    @query(f"repaired_{vendor}", _repair_sql(vendor))
    def repaired(spark, sf_dir):
        rows = ad.order_rejections(spark, sf_dir).select(
            "order_id", "error", F.try_parse_json("body").alias("payload")
        )
        return quality.repair_rejected(rows, vendor, "EMPLOYEE").select("order_id", "is_repairable", "repaired")

    repaired.__doc__ = f"Rejected payloads completed by the {vendor} rules."


_repaired("frappe")
_repaired("zoho")


@query(
    "error_messages",
    """SELECT o_orderkey AS order_id, CASE o_orderkey % 4
        WHEN 0 THEN '''departmentId'' cannot be null or is required' WHEN 1 THEN 'Invalid parameter "start_date" given'
        WHEN 2 THEN 'LastName and Department are mandatory, see company and naming_series' ELSE 'unknown' END AS generic_message,
      CASE o_orderkey % 4 WHEN 0 THEN '''departmentId'' cannot be null or is required' ELSE 'unknown' END AS zoho_message
    FROM orders""",
)
def error_messages(spark, sf_dir):
    """Readable message of every error response, by two vendors' rules."""
    body = F.try_parse_json("error")
    return ad.order_rejections(spark, sf_dir).select(
        "order_id",
        quality.error_message(body, "generic", "unknown").alias("generic_message"),
        quality.error_message(body, "zoho", "unknown").alias("zoho_message"),
    )


# ------------------------------------------------------------------------------- exports
SPACE = "strpos(full_name, ' ')"


def _staff_names(spark, sf_dir):
    return ad.employees(spark, sf_dir).select(
        "employee_id",
        F.when(F.col("employee_id") % 6 == 0, F.col("first_name"))
        .otherwise(F.concat_ws(" ", "first_name", "last_name", F.lit("Jr")))
        .alias("full_name"),
        F.concat(F.col("employee_id").cast("string"), F.lit("@host.io")).alias("work_email"),
        F.when(F.col("employee_id") % 4 != 0, F.col("first_name")).alias("department"),
    )


NAMES = """names AS (SELECT employee_id, CASE WHEN employee_id % 6 = 0 THEN first_name ELSE first_name || ' ' || last_name || ' Jr' END AS full_name,
  first_name AS f, CASE WHEN employee_id % 6 = 0 THEN '' ELSE last_name || ' Jr' END AS rest,
  CASE WHEN employee_id % 4 <> 0 THEN first_name END AS department FROM employees)"""


@query(
    "export_frappe_employees",
    with_views(
        ["employees"],
        "SELECT employee_id, f AS first_name, rest AS last_name, 'Standard Company' AS company FROM names", NAMES,
    ),
)
def export_frappe_employees(spark, sf_dir):
    """Employees in the shape of one vendor: name split, company filled."""
    return export.export_vendor_payload(_staff_names(spark, sf_dir), "frappe", "EMPLOYEE").select(
        "employee_id", "first_name", "last_name", "company"
    )


@query(
    "export_bamboohr_employees",
    with_views(["employees"], """SELECT employee_id, f AS "firstName", rest AS "lastName" FROM names""", NAMES),
)
def export_bamboohr_employees(spark, sf_dir):
    """Employees with camel-case name parts."""
    return export.export_vendor_payload(_staff_names(spark, sf_dir), "bamboohr", "EMPLOYEE").select(
        "employee_id", "firstName", "lastName"
    )


@query(
    "export_zoho_employees",
    with_views(
        ["employees"],
        """SELECT employee_id, f AS "FirstName", CASE WHEN rest = '' THEN f ELSE rest END AS "LastName",
          employee_id || '@host.io' AS "EmailID", coalesce(department, 'General') AS "Department" FROM names""",
        NAMES,
    ),
)
def export_zoho_employees(spark, sf_dir):
    """Employees in form-field names with a default department."""
    return export.export_vendor_payload(_staff_names(spark, sf_dir), "zoho", "EMPLOYEE").select(
        "employee_id", "FirstName", "LastName", "EmailID", "Department"
    )


@query(
    "export_zoho_leave",
    """SELECT o_orderkey AS request_id, CASE o_orderkey % 3 WHEN 0 THEN 'Annual' WHEN 1 THEN 'Sick_Leave' ELSE 'Comp-Off Day' END AS "LeaveType",
      o_orderdate::DATE::VARCHAR AS "From", o_custkey::VARCHAR AS "Employee_ID" FROM orders""",
)
def export_zoho_leave(spark, sf_dir):
    """Leave requests in form-field names with title case."""
    key = F.col("o_orderkey")
    rows = ad.table(spark, sf_dir, "orders").select(
        key.alias("request_id"), ad.pick(["ANNUAL", "sick_leave", "comp-off DAY"], key % 3).alias("leave_type"),
        F.to_date("o_orderdate").alias("start_date"), F.col("o_custkey").cast("string").alias("employee_ref"),
    )
    return export.export_vendor_payload(rows, "zoho", "LEAVE_REQUEST").select("request_id", "LeaveType", "From", "Employee_ID")


@query(
    "export_zoho_requisitions",
    """SELECT p_partkey AS requisition_id, p_name AS "JobTitle", coalesce(CASE WHEN p_partkey % 4 <> 0 THEN p_brand END, 'General') AS "Department",
      p_type AS "JobDescription" FROM part""",
)
def export_zoho_requisitions(spark, sf_dir):
    """Requisitions in form-field names with a default department."""
    rows = ad.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("requisition_id"), F.col("p_name").alias("title"),
        F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")).alias("department"), F.col("p_type").alias("description"),
    )
    return export.export_vendor_payload(rows, "zoho", "REQUISITION").select("requisition_id", "JobTitle", "Department", "JobDescription")


@query(
    "export_zoho_punches",
    """SELECT event_id AS punch_id, user_id::VARCHAR AS "empId", strftime(ts, '%Y-%m-%d %H:%M') AS "punchTime" FROM events""",
)
def export_zoho_punches(spark, sf_dir):
    """Punches in form-field names."""
    rows = ad.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("punch_id"), F.col("user_id").cast("string").alias("employee_ref"),
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("punch_time"),
    )
    return export.export_vendor_payload(rows, "zoho", "PUNCH").select("punch_id", "empId", "punchTime")


@query(
    "export_bamboohr_leave",
    """SELECT o_orderkey AS request_id, o_orderdate::DATE::VARCHAR AS "start", (o_orderdate::DATE + (o_orderkey % 9)::INT)::VARCHAR AS "end" FROM orders""",
)
def export_bamboohr_leave(spark, sf_dir):
    """Leave requests with the dates under the names of one vendor."""
    rows = ad.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.to_date("o_orderdate").alias("start_date"),
        F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 9).cast("int")).alias("end_date"),
    )
    return export.export_vendor_payload(rows, "bamboohr", "LEAVE_REQUEST").select("request_id", "start", "end")


@query(
    "export_iceipts_requisitions",
    """SELECT p_name AS title, p_brand AS department,
      CASE WHEN p_partkey % 4 = 0 THEN 'Negotiable' ELSE p_size || '-' || (p_size + 5) || ' LPA' END AS salary,
      CASE WHEN p_partkey % 3 = 0 THEN 'WorkFromHome' WHEN p_partkey % 3 = 1 THEN 'Hybrid' ELSE 'WorkFromOffice' END AS job_mode,
      CASE WHEN p_partkey % 2 = 0 THEN 'Contract' ELSE 'Full-time' END AS type, (p_partkey % 9 + 1)::BIGINT AS position,
      p_name || ' role in ' || p_brand || '.' AS description, '00000000-0000-0000-0000-' || lpad(p_partkey::VARCHAR, 12, '0') AS skills
    FROM part""",
)
def export_iceipts_requisitions(spark, sf_dir):
    """Parts as requisitions in the nested job shape."""
    key, negotiable = F.col("p_partkey"), F.col("p_partkey") % 4 == 0
    rows = ad.table(spark, sf_dir, "part").select(
        F.col("p_name").alias("title"), F.col("p_brand").alias("department"),
        F.when(~negotiable, F.col("p_size")).alias("min_salary"), F.when(~negotiable, F.col("p_size") + 5).alias("max_salary"),
        ad.pick(["remote", "Hybrid", "on-site"], key % 3).alias("_m"),
        F.when(key % 2 == 0, "contract").otherwise("unheard of").alias("employment_type"),
        (key % 9 + 1).alias("headcount"),
        F.array(F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(key.cast("string"), 12, "0")), F.lit("python")).alias("skills"),
    ).withColumn("work_model", F.when(F.col("_m") == "on-site", "office").otherwise(F.col("_m"))).drop("_m")
    shaped = export.export_vendor_payload(rows, "iceipts", "REQUISITION")
    job = F.col("jobData")
    return shaped.select(
        job["title"].alias("title"), job["department"].alias("department"), job["salary"].alias("salary"),
        job["jobMode"].alias("job_mode"), job["type"].alias("type"), job["position"].alias("position"),
        job["description"].alias("description"), "skills",
    )


# ----------------------------------------------------------------------------------- log
LATEST = """SELECT o_custkey AS key, arg_max(o_orderkey, u) AS value FROM (
        SELECT o_custkey, o_orderkey, (o_orderdate, o_orderkey) AS u,
          CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 100 DAY END AS x FROM orders)
    GROUP BY o_custkey HAVING arg_max(coalesce(x, TIMESTAMP '2999-01-01'), u) >= TIMESTAMP '2001-06-01'"""


def _order_log(spark, sf_dir):
    at = F.col("o_orderdate").cast("timestamp")
    return ad.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"), at.alias("updated_at"),
        F.when(F.col("o_orderkey") % 3 == 0, at + F.expr("INTERVAL 100 DAYS")).alias("expires_at"),
    )


@query("latest_by_key", LATEST)
def latest_by_key(spark, sf_dir):
    """Orders as an append-only log per customer: the latest write, unless it has expired."""
    log = _order_log(spark, sf_dir)
    return tables.latest_by_key(log, ["key"], F.lit("2001-06-01").cast("timestamp"), tie="value").select("key", "value")


@query("compacted_log", LATEST)
def compacted_log(spark, sf_dir):
    """The same over a log that is compacted between its appends."""
    log, path = _order_log(spark, sf_dir), scratch(spark, "log")
    for part in range(3):
        tables.append_log(log.filter(F.col("value") % 3 == part), path)
        if part < 2:
            tables.compact_log(spark, path, ["key"], tie="value")
    rows = tables.read_log(spark, path)
    return tables.latest_by_key(rows, ["key"], F.lit("2001-06-01").cast("timestamp"), tie="value").select("key", "value")


assert set(ENVELOPES) == set(refdata.VENDORS)
