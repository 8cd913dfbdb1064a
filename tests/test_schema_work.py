import json
from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from crewframe.functions import payload as pl
from crewframe.operators import mapping as mp
from crewframe.operators import matching, profiling, quality
from crewframe.sources import export, landed, tables


def variants(spark, *records):
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "n int, text string").select("n", F.parse_json("text").alias("payload"))


def at(spark, record, path):
    value = variants(spark, record).select(F.to_json(pl.path_col(F.col("payload"), path)).alias("v")).collect()[0]["v"]
    return None if value is None else json.loads(value)


def test_paths(spark):
    record = {
        "employee": {"profile": {"name": "Dev"}}, "items": [{"id": 1}, {"id": 2}], "odd key": {"a-b": 3},
        "education": [{"degree": "BSc"}, {"degree": ""}, {"x": 1}, {"degree": None}, {"degree": "MSc"}],
        "deep": [{"in": [{"v": 1}, {"v": 2}]}, {"in": []}],
    }
    cases = {
        "employee.profile.name": "Dev", "items[1].id": 2, "items[5].id": None, "education[].degree": ["BSc", "MSc"],
        "items[]": [{"id": 1}, {"id": 2}], "employee[].x": None, "employee.profile[0]": None, "missing.a.b": None,
        "odd key.a-b": 3, "deep[].in[].v": [[1, 2], []],
    }
    for path, want in cases.items():
        assert at(spark, record, path) == want, path


@pytest.mark.parametrize(
    "name, value, want",
    [
        ("string", 12, "12"), ("strip", "  a b \n", "a b"), ("lower", "AbC", "abc"), ("upper", "abC", "ABC"),
        ("int", " 42 ", 42), ("int", "-7", -7), ("int", "4.5", None), ("int", 0, 0), ("int", None, None),
        ("decimal", "12.50", D("12.5")), ("decimal", "bad", None), ("decimal", "", None),
        ("datetime", "2026-01-02T03:04:05Z", datetime(2026, 1, 2, 3, 4, 5)),
        ("datetime", "2026-01-02 03:04:05", datetime(2026, 1, 2, 3, 4, 5)),
        ("datetime", "03/04/2026", datetime(2026, 4, 3)), ("datetime", "04/25/2026", datetime(2026, 4, 25)),
        ("datetime", "soon", None), ("datetime", "2026", None),
        ("date", "2026-01-02T23:30:00-05:00", date(2026, 1, 2)), ("date", "25/12/2025", date(2025, 12, 25)),
        ("date", "2026-13-45", None),
        ("list", "a, b;c|d,", ["a", "b", "c", "d"]), ("list", ["a", 1, None, {"name": "x"}, {"q": []}], ["a", "1", "x"]),
        ("list", None, []), ("list", 5, ["5"]),
        ("join_names", ["First", None, " Last "], "First Last"), ("join_names", " Solo ", "Solo"), ("join_names", [], None),
        ("bool", True, True), ("bool", "false", False), ("bool", 0, False), ("bool", "maybe", None),
    ],
)
def test_transforms(spark, name, value, want):
    df = variants(spark, {"v": value}).select(pl.TRANSFORMS[name](pl.path_col(F.col("payload"), "v")).alias("v"))
    assert df.collect()[0]["v"] == want


TWO_WAY = mp.Mapping(
    vendor="hostco", entity="EMPLOYEE", id_path="emp_id",
    fields=(
        mp.FieldRule("full_name", ("first_name", "last_name"), "join_names", required=True),
        mp.FieldRule("work_email", "email", "strip", required=True),
        mp.FieldRule("status", "status_code", "upper", values={"1": "ACTIVE", "2": "INACTIVE"}),
        mp.FieldRule("salary", ("ctc", "pay.base"), "decimal"),
        mp.FieldRule("currency", "curr", "strip", default="INR"),
        mp.FieldRule("joining_date", "doj", "date"),
    ),
    writeback={"work_email": "contact.email", "employment_status": "status_code", "salary": "pay.base", "joining_date": "doj"},
)


def test_two_way_mapping(spark):
    df = variants(
        spark,
        {"emp_id": "E1", "first_name": "Dev", "last_name": "Sharma", "email": " d@x.io ", "status_code": 1, "ctc": "",
         "pay": {"base": 1200.5}, "doj": "2024-02-03T00:00:00+05:30", "version": 3},
        {"id": "alt", "first_name": "Only", "email": "o@x.io", "curr": ""},
        {"emp_id": "E3", "email": None, "first_name": ""},
    )
    good, rejected = mp.to_canonical(df, TWO_WAY, tenant=F.lit("T9"))
    rows = good.orderBy("source_ref.external_id").collect()
    first = rows[0]
    assert first["full_name"] == "Dev Sharma" and first["work_email"] == "d@x.io"
    assert first["employment_status"] == "ACTIVE" and first["salary"] == D("1200.50") and first["currency"] == "INR"
    assert first["joining_date"] == date(2024, 2, 3)
    assert tuple(first["source_ref"]) == ("hostco", "EMPLOYEE", "E1", "3", None)
    assert rows[1]["source_ref"]["external_id"] == "alt" and rows[1]["source_ref"]["version"] == "1"
    bad = rejected.collect()
    assert [r["n"] for r in bad] == [2]
    assert bad[0]["errors"] == [
        "required field 'full_name' is empty; looked in ['first_name', 'last_name']",
        "required field 'work_email' is empty; looked in ['email']",
    ]
    back = [json.loads(r["payload"]) for r in mp.to_vendor(good, TWO_WAY).collect()]
    assert {"contact": {"email": "d@x.io"}, "status_code": "ACTIVE", "pay": {"base": "1200.50"}, "doj": "2024-02-03"} in back
    assert {"contact": {"email": "o@x.io"}} in back
    with pytest.raises(ValueError):
        mp.to_vendor(good, mp.Mapping("v", "EMPLOYEE", "id"))
    with pytest.raises(ValueError):
        mp.FieldRule("x", "y", "nope")


def test_collection_path(spark):
    rule = mp.Mapping("v", "EMPLOYEE", "id", collection_path="result.list")
    df = variants(spark, {"result": {"list": [{"id": 1}, {"id": 2}]}}, {"result": {"list": {"id": 3}}}, {"result": {}})
    sizes = [r["s"] for r in df.orderBy("n").select(F.size(mp.records_of(F.col("payload"), rule)).alias("s")).collect()]
    assert sizes[:2] == [2, 1] and sizes[2] in (-1, None)


def test_catalog(spark, tmp_path):
    path = str(tmp_path / "catalog")
    old = mp.Mapping("HostCo", "employee", "old_id")
    mp.save_mappings(spark, path, "T", [old, mp.Mapping("Other", "PUNCH", "id")], datetime(2026, 1, 1))
    mp.save_mappings(spark, path, "T", [TWO_WAY], datetime(2026, 1, 2))
    mp.save_mappings(spark, path, "U", [old], datetime(2026, 1, 3))
    log = spark.read.parquet(path)
    latest = mp.list_mappings(log)
    assert [(r["tenant_id"], r["vendor"], r["entity_type"]) for r in latest.collect()] == [
        ("T", "hostco", "EMPLOYEE"), ("T", "other", "PUNCH"), ("U", "hostco", "EMPLOYEE"),
    ]
    assert mp.list_mappings(log, "U").count() == 1
    loaded = mp.load_mapping(latest, "T", "HOSTCO", "employee")
    assert loaded.fields == TWO_WAY.fields and loaded.id_path == "emp_id" and loaded.writeback == TWO_WAY.writeback
    assert mp.load_mapping(latest, "T", "nobody", "employee") is None


def test_latest_by_key(spark):
    df = spark.createDataFrame(
        [("n", "a", 1, "old", None), ("n", "a", 2, "new", 5), ("n", "b", 1, "b1", 99), ("n", "b", 2, "b2", None), ("n", "c", 1, "c", 10)],
        "namespace string, key string, updated_at int, value string, expires_at int",
    )
    rows = {r["key"]: r["value"] for r in tables.latest_by_key(df, ["namespace", "key"], F.lit(10)).collect()}
    assert rows == {"b": "b2", "c": "c"}  # the expired write of a hides its older one


@pytest.mark.parametrize(
    "vendor, entity, body, ids",
    [
        ("generic", "", {"data": {"items": [{"id": 1}, 7]}}, [1]), ("generic", "", {"items": [{"id": 2}]}, [2]),
        ("generic", "", {"id": 3}, [3]), ("nobody", "", {"data": [{"id": 4}]}, [4]), ("generic", "", {"data": None}, []),
        ("dynamic", "", {"records": {"items": [{"id": 5}]}}, [5]), ("dynamic", "", {"rows": [{"id": 6}]}, [6]),
        ("iceipts", "REQUISITION", {"data": {"job": {"id": 7}}}, [7]), ("iceipts", "", {"data": {"rows": [{"id": 8}]}}, [8]),
        ("iceipts", "", {"data": [{"id": 9}]}, [9]), ("iceipts", "", {"data": None, "id": 10}, [10]),
        ("frappe", "", {"message": [{"id": 11}]}, [11]), ("erpnext", "", {"message": "ok", "id": 12}, [12]),
        ("bamboohr", "", {"requests": [{"id": 13}], "jobs": [{"id": 0}]}, [13]),
        ("workday", "", {"Report_Entry": [{"id": 14}]}, [14]),
        ("zoho", "", {"response": {"result": [{"id": 15}, {"id": 16}]}}, [15, 16]),
        ("zoho_people", "", {"response": {"result": [{"K": [{"id": 17}]}]}}, [17]),
        ("zoho", "", {"response": {"result": [{"EmployeeID": "18"}]}}, ["18"]), ("zoho", "", {"response": {"data": {"id": 19}}}, [19]),
        ("zoho", "", {"response": "x", "data": [{"id": 20}]}, [20]), ("workday", "", {}, []),
    ],
)
def test_envelopes(spark, vendor, entity, body, ids):
    df = spark.createDataFrame([(json.dumps(body),)], ["body"])
    rows = landed.explode_responses(df, "body", vendor, entity).select(F.to_json("payload").alias("p")).collect()
    got = [json.loads(r["p"]) for r in rows]
    assert [r.get("id", r.get("EmployeeID")) for r in got] == ids


def test_read_landed(spark, tmp_path):
    (tmp_path / "page1.json").write_text(json.dumps({"employees": [{"id": 1}, {"id": 2}]}) + "\nnot json\n")
    (tmp_path / "page2.json").write_text(json.dumps({"employees": [{"id": 3}]}))
    rows = landed.read_landed(spark, str(tmp_path), "bamboohr", "EMPLOYEE")
    assert sorted(r["id"] for r in rows.select(F.try_variant_get("payload", "$.id", "int").alias("id")).collect()) == [1, 2, 3]
    pretty = tmp_path / "sub"
    pretty.mkdir()
    (pretty / "a.json").write_text(json.dumps({"employees": [{"id": 4}]}, indent=2))
    assert landed.read_landed(spark, str(pretty), "bamboohr", "EMPLOYEE", whole_files=True).count() == 1


def test_employee_json_file_and_canonical_writer(spark, tmp_path):
    path = tmp_path / "staff.json"
    path.write_text(json.dumps([{"id": "E1", "tenant_id": "T", "jurisdiction": "AE", "probation_days": 240}], indent=1))
    from crewframe.operators import compliance

    df = landed.read_employees_json(spark, str(path))
    assert [r["entity_id"] for r in compliance.audit_employees(df).collect()] == ["E1"]
    good, _ = mp.to_canonical(
        variants(spark, {"emp_id": "E1", "first_name": "A", "email": "e"}), TWO_WAY, tenant=F.lit("T9")
    )
    out = str(tmp_path / "canonical")
    tables.write_canonical(good, out)
    again = spark.read.parquet(out)
    assert again.filter("tenant_id = 'T9' and entity_type = 'EMPLOYEE'").count() == 1


def test_title_case(spark):
    df = spark.createDataFrame([("sick_leave pay",), ("ANNUAL-leave2go",)], ["t"])
    assert [r["v"] for r in df.select(export.title_case(F.col("t")).alias("v")).collect()] == ["Sick_Leave Pay", "Annual-Leave2Go"]


def _export(df, vendor, entity, **options):
    return [json.loads(r["payload"]) for r in export.as_json(export.export_vendor_payload(df, vendor, entity, **options)).collect()]


def test_exports(spark):
    staff = spark.createDataFrame([("Ana Maria Cruz", "a@x.io"), ("Solo", None)], "full_name string, work_email string")
    first, second = _export(staff, "frappe", "EMPLOYEE")
    assert (first["first_name"], first["last_name"], first["company"]) == ("Ana", "Maria Cruz", "Standard Company")
    assert "last_name" not in second
    first, second = _export(staff, "bamboohr", "EMPLOYEE")
    assert (first["firstName"], first["lastName"], second["lastName"]) == ("Ana", "Maria Cruz", "")
    first, second = _export(staff, "zoho", "EMPLOYEE")
    assert (first["FirstName"], first["LastName"], first["EmailID"], first["Department"]) == ("Ana", "Maria Cruz", "a@x.io", "General")
    assert second["LastName"] == "Solo"
    leave = spark.createDataFrame([("sick_leave", "2026-01-01", "2026-01-02", "flu", "E1")],
                                  ["leave_type", "start_date", "end_date", "reason", "employee_ref"])
    row = _export(leave, "zoho_people", "LEAVE_REQUEST")[0]
    assert (row["LeaveType"], row["From"], row["To"], row["Reasonforleave"], row["Employee_ID"]) == ("Sick_Leave", "2026-01-01", "2026-01-02", "flu", "E1")
    assert _export(leave, "bamboohr", "LEAVE_REQUEST")[0]["start"] == "2026-01-01"
    assert _export(leave, "workday", "LEAVE_REQUEST")[0] == leave.collect()[0].asDict()
    job = spark.createDataFrame(
        [("Engineer", "12", 20, 3, "hybrid", "contract", ["123e4567-e89b-12d3-a456-426614174000", "python"]), (None, None, None, None, None, None, None)],
        "title string, min_salary string, max_salary int, headcount int, work_model string, employment_type string, skills array<string>",
    )
    first, second = _export(job, "iceipts_hrms", "REQUISITION")
    data = first["jobData"]
    assert (data["salary"], data["position"], data["jobMode"], data["type"]) == ("12-20 LPA", 3, "Hybrid", "Contract")
    assert (data["minthreshold"], data["matchthreshold"], data["minSalary"]) == (70, 85, 12)
    assert data["recuiterId"] == first["employeeId"] == "00000000-0000-0000-0000-000000000000"
    assert first["skills"] == ["123e4567-e89b-12d3-a456-426614174000"] and first["benefits"] == []
    assert second["jobData"]["salary"] == "Negotiable" and second["jobData"]["description"] == "Unspecified Role role in Engineering."
    assert second["jobData"]["requirements"] == "To be discussed during screening." and second["jobData"]["position"] == 1


STAFF = [
    {"emp_id": "E1", "first_name": "A", "last_name": "B", "email": "a@x.io", "salary": 1000.5, "is_manager": True,
     "joining_date": "2024-01-01", "skills": ["a"], "status": "ACTIVE", "gone": None},
    {"emp_id": "E2", "first_name": "C", "last_name": "D", "email": "c@x.io", "salary": 2000, "is_manager": False,
     "joining_date": "2024-02-01", "skills": [], "status": "PROBATION", "gone": None, "level": "7"},
]


def _keyed(spark, records, entity="EMPLOYEE"):
    return variants(spark, *records).select(
        F.lit("T").alias("tenant_id"), F.lit("hostco").alias("vendor"), F.lit(entity).alias("entity_type"), "n", "payload"
    )


KEYS = ["tenant_id", "vendor", "entity_type"]


def test_profile(spark):
    profile = profiling.profile_records(_keyed(spark, STAFF), KEYS, "n")
    rows = {r["field"]: r for r in profile.collect()}
    types = {f: rows[f]["data_type"] for f in rows}
    assert types == {
        "emp_id": "string", "first_name": "string", "last_name": "string", "email": "string", "salary": "number",
        "is_manager": "boolean", "joining_date": "date", "skills": "array", "status": "string", "gone": "string",
        "level": "integer",
    }
    assert rows["status"]["enum_values"] == ["ACTIVE", "PROBATION"] and rows["is_manager"]["enum_values"] == ["False", "True"]
    assert rows["level"]["is_nullable"] and not rows["level"]["is_required"] and rows["emp_id"]["is_required"]
    assert rows["gone"]["is_nullable"] and rows["gone"]["sample_values"] == [] and rows["gone"]["enum_values"] == []
    assert rows["email"]["sample_values"] == ["a@x.io", "c@x.io"]
    assert profiling.pick_id_field(profile, KEYS).collect()[0]["id_field"] == "emp_id"


def test_profile_enum_limit(spark):
    for distinct, expected in ((12, 12), (13, 0), (40, 0), (500, 0)):
        records = _keyed(spark, [{"v": f"k{i % distinct:03d}"} for i in range(max(distinct, 30))])
        row = profiling.profile_records(records, KEYS, "n").collect()[0]
        assert len(row["enum_values"]) == expected, distinct
        assert row["sample_values"] == ["k000", "k001", "k002"]


def test_id_field_rules(spark):
    def pick(*fields, entity="Leave"):
        df = spark.createDataFrame([("T", entity, f) for f in fields], ["tenant_id", "entity_type", "field"])
        return profiling.pick_id_field(df, ["tenant_id", "entity_type"]).collect()[0]["id_field"]

    assert pick("uuid", "leave_id", "code") == "leave_id"
    assert pick("z_id", "aId", "name") == "aId"
    assert pick("name", "title") is None
    assert pick("id", "emp_id") == "id"


def _match(spark, records, entity="EMPLOYEE"):
    profile = profiling.profile_records(_keyed(spark, records, entity), KEYS, "n")
    return profile, matching.match_fields(profile, KEYS)


def test_matching_compound(spark):
    profile, matches = _match(spark, STAFF)
    rows = {r["target"]: r for r in matches.collect()}
    assert rows["full_name"]["source"] == ["first_name", "last_name"] and rows["full_name"]["transform"] == "join_names"
    assert rows["full_name"]["confidence"] == 0.95 and not rows["full_name"]["writeback"]
    assert rows["work_email"]["source"] == ["email"] and rows["work_email"]["confidence"] == 0.95
    assert rows["joining_date"]["confidence"] == 1.0 and rows["joining_date"]["rationale"] == "Exact match on synonym 'joining_date'"
    assert rows["status"]["enum_map"] == {"ACTIVE": "ACTIVE", "PROBATION": "PROBATION"}
    report = matching.match_report(profile, matches, KEYS).collect()[0]
    assert report["unmapped_canonical_fields"] == ["department", "designation"]
    assert report["average_confidence"] == 0.975 and report["writeback_count"] == 3
    free = {r["field"] for r in matching.unmapped_host_fields(profile, matches, KEYS).collect()}
    assert free == {"emp_id", "salary", "is_manager", "skills", "gone", "level"} and report["unmapped_host_count"] == 6


def test_matching_drifted_names(spark):
    _, matches = _match(spark, [{"emp_id": "1", "emp_fname": "A", "emp_lname": "B", "mail_addr": "x", "join_dt": "2024-01-01"}])
    rows = {r["target"]: r["source"] for r in matches.collect()}
    assert rows["full_name"] == ["emp_fname", "emp_lname"] and rows["work_email"] == ["mail_addr"] and rows["joining_date"] == ["join_dt"]


def test_matching_order_takes_fields(spark):
    # an earlier target takes a field by substring that a later one names exactly
    _, matches = _match(spark, [{"position": "x", "designation": "y", "jobTitle": "z"}], "REQUISITION")
    rows = {r["target"]: (r["source"], r["confidence"]) for r in matches.collect()}
    assert rows["title"] == (["position"], 0.95)
    _, matches = _match(spark, [{"EmployeeID": "1", "LeaveTypeName": "x", "fromDate": "2024-01-01", "to_Date": "2024-01-02"}], "leave_request")
    rows = {r["target"]: (r["source"], r["confidence"]) for r in matches.collect()}
    assert rows["employee_ref"] == (["EmployeeID"], 0.95)
    assert rows["leave_type"] == (["LeaveTypeName"], 0.75)
    assert rows["start_date"] == (["fromDate"], 0.95) and rows["end_date"] == (["to_Date"], 0.95)


def _greedy_match(fields, spec):
    """The matching rules target by target, written from their description."""
    norm = lambda s: "".join(c for c in s.lower() if c.isalnum())
    used, out = set(), {}
    for row in spec:
        syns = row["synonyms"]
        if row["compound"] and row["target"] not in fields:
            parts = []
            for names in (["first_name", "first", "fname", "emp_fname", "emp_first_name"], ["last_name", "last", "lname", "emp_lname", "emp_last_name"]):
                parts.append(next((h for n in names for h in fields if norm(h) == norm(n)), None))
            if all(parts):
                out[row["target"]] = (parts, 0.95)
                used |= set(parts)
                continue
        free = [h for h in fields if h not in used]
        hit = next(((h, 1.0 if h.lower() == row["target"].lower() else 0.95) for s in syns for h in free if h.lower() == s.lower()), None)
        if not hit:
            for h in free:
                if norm(h) == norm(row["target"]):
                    hit = (h, 0.9)
                elif any(norm(h) == norm(s) for s in syns):
                    hit = (h, 0.85)
                if hit:
                    break
        if not hit:
            hit = next(((h, 0.75) for h in free for s in syns if (s.lower() in h.lower() or h.lower() in s.lower()) and min(len(s), len(h)) >= 4), None)
        if hit:
            out[row["target"]] = ([hit[0]], hit[1])
            used.add(hit[0])
    return out


def test_matching_random_against_rules(spark):
    import random

    from crewframe import refdata

    rng = random.Random(3)
    spec = refdata.canonical_spec()
    pool = [s for row in spec for s in row["synonyms"]] + ["first_name", "LastName", "fname", "empLname"]
    rows, want = [], {}
    for n in range(60):
        entity = rng.choice(sorted({row["entity"] for row in spec}))
        names = set()
        for name in rng.sample(pool, rng.randrange(3, 30)):
            names.add(rng.choice([name, name.upper(), name.replace("_", ""), "x_" + name, name + "_code", name.title()]))
        for name in names:
            rows.append((f"T{n}", "v", entity, name, "string", True, []))
        want[f"T{n}"] = _greedy_match(sorted(names), [r for r in spec if r["entity"] == entity])
    profile = spark.createDataFrame(
        rows, "tenant_id string, vendor string, entity_type string, field string, data_type string, is_required boolean, enum_values array<string>"
    )
    got = {}
    for r in matching.match_fields(profile, KEYS).collect():
        got.setdefault(r["tenant_id"], {})[r["target"]] = (r["source"], r["confidence"])
    assert got == {k: v for k, v in want.items() if v}


def test_unknown_entity_maps_one_to_one(spark):
    profile, matches = _match(spark, [{"widgetId": 1, "weight": 1.5, "made": "2024-01-01", "ok": True, "name": "x"}], "WIDGET")
    rows = {r["target"]: (r["source"], r["transform"], r["confidence"], r["writeback"]) for r in matches.collect()}
    assert rows == {
        "widgetId": (["widgetId"], "int", 1.0, True), "weight": (["weight"], "decimal", 1.0, True),
        "made": (["made"], "date", 1.0, True), "ok": (["ok"], "bool", 1.0, True), "name": (["name"], "strip", 1.0, True),
    }
    ids = matching.id_paths(profile, profiling.pick_id_field(profile, KEYS), KEYS).collect()[0]
    assert ids["id_path"] == "widgetId"


def test_matched_mapping_runs(spark):
    profile, matches = _match(spark, STAFF)
    rule = matching.mapping_of(matches, "hostco", "EMPLOYEE", "emp_id", tenant_id="T")
    good, rejected = mp.to_canonical(variants(spark, *STAFF), rule)
    assert rejected.count() == 0
    assert sorted(r["full_name"] for r in good.collect()) == ["A B", "C D"]


def test_enum_alignment(spark):
    df = spark.createDataFrame(
        [([" active", "PENDING_APPROVAL_X", "zzz"],)], "h array<string>"
    ).select(matching.align_enums(
        F.col("h"), F.array(*[F.lit(k) for k in ("PENDING", "ACTIVE")]), F.array(F.lit("P"), F.lit("A"))).alias("m"))
    assert df.collect()[0]["m"] == {" active": "A", "PENDING_APPROVAL_X": "P"}


def test_probe(spark):
    df = _keyed(spark, [
        {"emp_id": "1", "first_name": "A", "email": "x"}, {"first_name": "B", "email": "y"}, {"emp_id": "3", "first_name": "C", "email": None},
    ])
    issues = quality.probe_issues(df, TWO_WAY, "n", ["tenant_id"], ["designation"])
    got = sorted((r["sample_index"], r["field"], r["message"]) for r in issues.collect())
    assert got == [
        (0, "designation", "Required canonical field 'designation' evaluated to empty/None"),
        (1, "designation", "Required canonical field 'designation' evaluated to empty/None"),
        (1, "emp_id", "hostco/EMPLOYEE: no id at path 'emp_id'."),
        (2, "to_canonical", "Unexpected exception during projection: required field 'work_email' is empty; looked in ['email']"),
    ]
    row = quality.probe_report(df, issues, TWO_WAY, ["tenant_id"]).collect()[0]
    assert (row["records_tested"], row["error_count"], row["quality_score"], row["is_valid"]) == (3, 4, 0.0, False)
    good = df.filter("n = 0")
    row = quality.probe_report(good, quality.probe_issues(good, TWO_WAY, "n", []), TWO_WAY, []).collect()[0]
    assert row["is_valid"] and row["quality_score"] == 1.0
    none = df.filter("n > 9")
    row = quality.probe_report(none, quality.probe_issues(none, TWO_WAY, "n", []), TWO_WAY, []).collect()[0]
    assert (row["records_tested"], row["quality_score"], row["is_valid"]) == (0, 0.0, False)
    assert quality.projections(df, TWO_WAY, "n").count() == 2


def test_drift(spark):
    df = _keyed(spark, [
        {"emp_id": "1", "first_name": "A", "pay": {"base": 1}, "badge": "B1", "_meta": 1, "status": "x", "data": 1},
        {"emp_id": "2", "badge": "B2", "office": None},
    ])
    rows = {r["field_name"]: r for r in quality.detect_unmapped_fields(df, TWO_WAY, "n", ["tenant_id"]).collect()}
    assert set(rows) == {"badge", "office"} and rows["badge"]["occurrences"] == 2
    assert json.loads(rows["badge"]["suggested_patch"]) == {"action": "ADD_MAPPING", "host_field": "badge", "sample_value": "B1"}
    assert rows["badge"]["severity"] == "INFO"


def test_rejections(spark):
    df = spark.createDataFrame(
        [
            (1, "LEAVE_REQUEST", 400, json.dumps({"message": "'departmentId' cannot be null or is required"})),
            (2, "LEAVE_REQUEST", 422, json.dumps({"detail": "something else 'x'"})),
            (3, "EMPLOYEE", 400, "plain: missing required field \"email\""),
            (4, "EMPLOYEE", 400, None),
        ],
        "id int, entity_type string, status_code int, error string",
    )
    events = quality.diagnose_rejections(df)
    rows = {r["id"]: r for r in events.collect()}
    assert [rows[i]["field_name"] for i in (1, 2, 3, 4)] == ["departmentId", "unknown_field", "email", "unknown_field"]
    assert rows[1]["severity"] == "CRITICAL"
    assert rows[1]["description"] == "Host HTTP 400 schema rejection: 'departmentId' cannot be null or is required"
    patches = quality.remediation_delta(events).collect()
    assert patches[0]["status"] == "APPLIED" and json.loads(patches[0]["patch_instruction"])["missing_field"] == "departmentId"


def test_error_messages(spark):
    df = variants(
        spark, {"error": "E", "status": "S"}, {"message": 5, "detail": "D"}, {}, {"response": {"errors": {"message": "Z"}}},
        {"response": {"errors": ["q"]}}, {"response": {"message": "R"}}, {"message": "M"},
    ).select("n", *[quality.error_message(F.col("payload"), v, "none").alias(v) for v in ("generic", "zoho")])
    rows = {r["n"]: (r["generic"], r["zoho"]) for r in df.collect()}
    assert [rows[i][0] for i in (0, 1, 2)] == ["E", "D", "none"]
    assert [rows[i][1] for i in (3, 4, 5, 6, 2)] == ["Z", '["q"]', "R", "M", "none"]


def test_repair(spark):
    df = variants(spark, {"first_name": "A"}, {"company": "C"}, {"FirstName": "Z", "x": {"b": 1}})
    df = df.withColumn("error", F.lit("Company missing, naming_series mandatory; LastName and Department required"))
    rows = {r["n"]: r for r in quality.repair_rejected(df, "frappe", "EMPLOYEE").collect()}
    assert json.loads(rows[0]["repaired"]) == {"first_name": "A", "company": "Standard Company", "naming_series": "EMP-"}
    assert json.loads(rows[1]["repaired"]) == {"company": "C", "naming_series": "EMP-"}
    rows = {r["n"]: r for r in quality.repair_rejected(df, "zoho", "EMPLOYEE").collect()}
    assert json.loads(rows[2]["repaired"]) == {"FirstName": "Z", "LastName": "Z", "Department": "General", "x": {"b": 1}}
    assert json.loads(rows[0]["repaired"]) == {"first_name": "A", "Department": "General"}
    assert not quality.repair_rejected(df, "workday", "EMPLOYEE").collect()[0]["is_repairable"]


def test_value_map_reads_the_natural_number(spark):
    from crewframe.operators import mapping as mp
    from crewframe.operators import quality

    rule = mp.FieldRule("grade", "n", "decimal", values={"1": "LOW", "2.5": "MID", "10": "TEN"})
    flag = mp.FieldRule("boss", "b", "bool", values={"True": "YES"})
    spec = mp.Mapping("v", "EMPLOYEE", "id", (rule, flag))
    bodies = ['{"id": 1, "n": 1, "b": true}', '{"id": 2, "n": "2.50"}', '{"id": 3, "n": 10, "b": false}', '{"id": 4, "n": 7}']
    df = spark.createDataFrame(list(enumerate(bodies)), "k int, body string").withColumn("payload", F.parse_json("body"))
    rows = mp.project(df, spec).orderBy("k").select("m_grade", "m_boss").collect()
    assert [tuple(r) for r in rows] == [("LOW", "YES"), ("MID", None), ("TEN", "false"), ("7", None)]
    issues = quality.probe_issues(df, spec, "k", [])
    found = [(r["sample_index"], r["severity"], r["message"]) for r in issues.orderBy("sample_index").collect()]
    assert found == [(k, "WARNING", "Field 'grade' expected Decimal, got str") for k in (0, 1, 2)]
    report = quality.probe_report(df, issues, spec, []).collect()[0]
    assert report["is_valid"] and report["warning_count"] == 3 and report["quality_score"] == 0.85


def test_probe_of_no_records(spark):
    from crewframe.operators import mapping as mp
    from crewframe.operators import quality

    spec = mp.Mapping("v", "EMPLOYEE", "id", (mp.FieldRule("x", "x"),))
    empty = spark.createDataFrame([], "k int, body string").withColumn("payload", F.parse_json("body"))
    issues = quality.probe_issues(empty, spec, "k", [])
    assert [(r["severity"], r["field"]) for r in issues.collect()] == [("ERROR", "payload")]
    report = quality.probe_report(empty, issues, spec, []).collect()[0]
    assert (report["records_tested"], report["is_valid"], report["quality_score"]) == (0, False, 0.0)


# ------------------------------------------------------------------- compaction and merging
LOG = "key string, value int, updated_at timestamp, expires_at timestamp"


def _log_rows(n, seed):
    import datetime as dt
    import random

    rng, day = random.Random(seed), dt.datetime(2024, 1, 1)
    ends = lambda: None if rng.random() < 0.5 else day + dt.timedelta(days=rng.randrange(120))
    return [
        ("hot" if rng.random() < 0.3 else f"k{rng.randrange(40)}", seed * 1000 + i, day + dt.timedelta(hours=rng.randrange(2000)), ends())
        for i in range(n)
    ]


def test_compaction_changes_no_reader_and_is_idempotent(spark, tmp_path):
    from crewframe.sources import tables

    path, rows = str(tmp_path / "log"), []
    as_of = F.lit("2024-03-01").cast("timestamp")
    latest = lambda df: sorted(map(tuple, tables.latest_by_key(df, ["key"], as_of, tie="value").collect()))
    for part in range(4):
        more = _log_rows(120, part + 1)
        rows += more
        tables.append_log(spark.createDataFrame(more, LOG), path)
        before = tables.read_log(spark, path)
        want = latest(spark.createDataFrame(rows, LOG))
        assert latest(before) == want
        if part < 3:
            assert tables.compact_log(spark, path, ["key"], tie="value") == part + 1
            assert tables.compact_log(spark, path, ["key"], tie="value") == part + 1  # nothing new
            assert latest(before) == want  # a reader of the state before
            after = tables.read_log(spark, path)
            assert latest(after) == want and after.count() == len({r[0] for r in rows})
            assert after.columns == before.columns


def test_a_base_without_its_mark_does_not_count(spark, tmp_path):
    from crewframe.sources import tables

    path = str(tmp_path / "log")
    tables.append_log(spark.createDataFrame(_log_rows(30, 1), LOG), path)
    want = tables.read_log(spark, path).count()
    broken = tmp_path / "log" / "base" / "version=1"
    spark.createDataFrame(_log_rows(3, 9), LOG).write.parquet(str(broken))
    (broken / "_SUCCESS").unlink()
    assert tables.read_log(spark, path).count() == want
    assert tables.compact_log(spark, path, ["key"], tie="value") == 1


def test_expired_writes_hide_older_ones_until_they_are_forgotten(spark, tmp_path):
    import datetime as dt

    from crewframe.sources import tables

    path, day = str(tmp_path / "log"), dt.datetime(2024, 1, 1)
    at = lambda n: day + dt.timedelta(days=n)
    tables.append_log(spark.createDataFrame([("a", 2, at(5), at(6)), ("b", 1, at(5), None)], LOG), path)
    tables.compact_log(spark, path, ["key"])
    tables.append_log(spark.createDataFrame([("a", 1, at(1), None)], LOG), path)  # arrives late
    now = F.lit("2024-02-01").cast("timestamp")
    assert [r.key for r in tables.latest_by_key(tables.read_log(spark, path), ["key"], now).collect()] == ["b"]
    tables.compact_log(spark, path, ["key"], forget_before=now)
    assert [r.key for r in tables.read_log(spark, path).collect()] == ["b"]


def test_profile_of_parts_is_the_profile_of_all(spark):
    import json
    import random

    from crewframe.operators import profiling

    rng = random.Random(4)
    rows = []
    for n in range(300):
        body = {"id": n, "few": rng.choice("abc"), "many": f"v{rng.randrange(40)}", "twelve": n % 12, "thirteen": n % 13}
        if n % 3:
            body["some"] = rng.choice([None, True, "2024-01-01"])
        if n == 250:
            body["late"] = 1.5
        rows.append(("T" if n % 5 else "U", n, json.dumps(body)))
    df = spark.createDataFrame(rows, "tenant_id string, n int, body string").withColumn("payload", F.parse_json("body"))
    whole = profiling.profile_records(df, ["tenant_id"], "n")
    parts = [profiling.profile_parts(df.filter(f"n % 4 = {i}"), ["tenant_id"], "n") for i in range(4)]
    merged = profiling.merge_parts(parts[0].unionByName(parts[1]), ["tenant_id"])
    for part in parts[2:]:  # merged parts merge on
        merged = profiling.merge_parts(merged.unionByName(part), ["tenant_id"])
    got = profiling.finished_profile(merged, ["tenant_id"])
    assert got.columns == whole.columns and sorted(got.collect()) == sorted(whole.collect())
    enums = {r["field"]: len(r["enum_values"]) for r in got.filter("tenant_id = 'T'").collect()}
    assert (enums["few"], enums["twelve"], enums["thirteen"], enums["many"]) == (3, 12, 0, 0)


def test_profile_takes_few_records_apart_twice(spark):
    """The first records of a field are told by order alone: no sort and no window sees the other rows."""
    rows = [(None if n % 7 == 0 else n // 2, "a" if n % 3 else "b") for n in range(20_000)]
    df = spark.createDataFrame(rows, "n int, g string")
    reach = {r["g"]: r["reach"] for r in df.groupBy("g").agg(profiling._reach(F.col("n")).alias("reach")).collect()}
    for g, bound in reach.items():
        held = sorted(n for n, of in rows if of == g and n is not None)
        assert held[2] <= bound and sum(n <= bound for n in held) < 100
    few = spark.createDataFrame([(1,), (1,), (2,)], "n int").agg(profiling._reach(F.col("n")).alias("reach"))
    assert few.collect()[0]["reach"] is None


def test_profile_of_repeated_orders_and_booleans(spark):
    rows = [("T", n // 3, json.dumps({"flag": n % 2 == 0, "said": "true", "late": n if n > 80 else None, "rare": 5} if n != 7 else {})) for n in range(90)]
    df = spark.createDataFrame(rows, "tenant_id string, n int, body string").withColumn("payload", F.parse_json("body"))
    got = {r["field"]: r for r in profiling.profile_records(df, ["tenant_id"], "n").collect()}
    assert got["flag"]["enum_values"] == ["False", "True"] and got["said"]["enum_values"] == ["true"]
    assert got["late"]["sample_values"] == ["81", "82", "83"] and got["late"]["non_null_count"] == 9
    assert got["rare"]["sample_values"] == ["5"] * 3 and got["rare"]["data_type"] == "integer" and got["rare"]["is_nullable"]
