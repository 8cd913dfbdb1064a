from datetime import date

from pyspark.sql import functions as F

from crewframe.operators import attendance, compliance, expenses, findings


def test_employee_audit(spark):
    df = spark.createDataFrame(
        [
            ("T", "AE", "E1", "A", "B", 120, 20000.0, True),
            ("T", "AE", "E2", "Sam", "Lee", 240, 20000.0, True),
            ("T", "IN", "E3", "C", "D", 400, 14000.0, False),
            ("T", "IN", "E4", "E", "F", None, 14000.0, True),
            ("T", "IN", None, "E", "F", None, 15000.0, False),
            ("T", "IN", "E6", "E", "F", None, 0.0, False),
        ],
        "tenant_id string, jurisdiction string, id string, first_name string, last_name string, probation_days int, "
        "basic_salary double, is_pf_enrolled boolean",
    )
    found = compliance.audit_employees(df)
    rows = {r["entity_id"]: r for r in found.collect()}
    assert set(rows) == {"E2", "E3", "UNKNOWN"}
    assert rows["E2"]["rule_key"] == "UAE_MAX_PROBATION_EXCEEDED" and rows["E2"]["severity"] == "HIGH"
    assert rows["E2"]["detailed_findings"].startswith("Employee Sam Lee has probation set to 240 days.")
    assert "Article 9" in rows["E2"]["statutory_citation"]
    assert rows["E3"]["severity"] == "CRITICAL" and "Provident Funds" in rows["E3"]["statutory_citation"]
    assert rows["E3"]["detailed_findings"].startswith("Employee has monthly basic wage INR 14000.00 (")
    report = {(r["tenant_id"], r["jurisdiction"]): r for r in findings.compliance_report(found, df).collect()}
    assert report["T", "IN"]["critical_count"] == 2 and report["T", "IN"]["dashboard_score"] == 70
    assert report["T", "AE"]["total_records_audited"] == 2 and not report["T", "AE"]["is_compliant"]


def test_clean_group_still_reported(spark):
    df = spark.createDataFrame([("T", "AE", "E1", 10)], ["tenant_id", "jurisdiction", "id", "probation_days"])
    row = findings.compliance_report(compliance.audit_employees(df), df).collect()[0]
    assert row["is_compliant"] and row["dashboard_score"] == 92 and row["violations_count"] == 0


def test_hours_audit(spark):
    df = spark.createDataFrame(
        [("T", "AE", "E1", date(2026, 1, 1), 8.5), ("T", "AE", "E2", date(2026, 1, 1), 12.0), ("T", "IN", "E3", date(2026, 1, 1), 15.0)],
        ["tenant_id", "jurisdiction", "employee_id", "work_date", "total_hours"],
    )
    rows = compliance.audit_daily_hours(df).collect()
    assert [r["violation_id"] for r in rows] == ["VIO-OT-E2-2026-01-01"]
    assert "Article 17" in rows[0]["statutory_citation"]
    assert rows[0]["summary"].startswith("Daily working hours of 12.0h exceeds")


def test_wps_audit(spark):
    df = spark.createDataFrame(
        [
            ("T", "AE", "B1", 100, 82, 18), ("T", "AE", "B2", 100, None, 15), ("T", "AE", "B3", 10, 0, 0),
            ("T", "IN", "B4", 10, 0, 99),
        ],
        "tenant_id string, jurisdiction string, batch_id string, total_headcount int, paid_headcount int, "
        "days_since_period_end int",
    )
    rows = [(r["entity_id"], r["rule_key"], r["severity"]) for r in compliance.audit_wps(df).collect()]
    assert sorted(rows) == [
        ("B1", "UAE_WPS_PAYMENT_DELAYED", "CRITICAL"),
        ("B1", "UAE_WPS_SUB_90_PERCENT_QUOTA", "CRITICAL"),
        ("B3", "UAE_WPS_SUB_90_PERCENT_QUOTA", "CRITICAL"),  # nobody paid is not everybody paid
    ]


def test_payroll_batches(spark):
    staff = spark.createDataFrame(
        [("T", "AE", "B", i, date(2026, 1, 31)) for i in range(10)],
        ["tenant_id", "jurisdiction", "batch_id", "employee_id", "period_end"],
    )
    slips = spark.createDataFrame([("T", "B", i) for i in range(8)] + [("T", "B", 1)], ["tenant_id", "batch_id", "employee_id"])
    row = compliance.payroll_batches(staff, slips, F.lit("2026-02-20").cast("date")).collect()[0]
    assert (row["total_headcount"], row["paid_headcount"], row["days_since_period_end"]) == (10, 8, 20)


def test_remediation_queue(spark):
    found = compliance.audit_employees(
        spark.createDataFrame([("T", "AE", "E1", 240), ("T", "AE", "E2", 240)], ["tenant_id", "jurisdiction", "id", "probation_days"])
    )
    approvals = spark.createDataFrame(
        [("T", "VIO-PROB-E1", "E1", "U1", "HR_ADMIN"), ("T", "VIO-PROB-E2", "E2", "U2", "EMPLOYEE")],
        ["tenant_id", "violation_id", "entity_id", "approver_id", "approver_role"],
    )
    rows = {r["entity_id"]: r for r in findings.remediation_queue(found, approvals).collect()}
    assert rows["E1"]["queue_status"] == "APPROVED_AND_QUEUED" and rows["E2"]["queue_status"] == "REFUSED"
    assert rows["E1"]["reasoning_hash"].startswith("sha256:") and len(rows["E1"]["agent_invocation_id"]) == 16


def test_leave(spark):
    df = spark.createDataFrame(
        [
            (1, "CASUAL", 3.0, 10.0, False, False),
            (2, "SICK", 12.0, 5.0, False, False),
            (3, "annual", 12.0, 5.0, True, True),
            (4, "SICK", 12.0, 5.0, True, True),
            (5, "SICK", 0.0, 5.0, False, False),
        ],
        "id int, leave_type string, requested_days double, current_balance double, on_probation boolean, allow_negative boolean",
    )
    rows = {r["id"]: r for r in attendance.evaluate_leave(df).collect()}
    assert rows[1]["is_approved"] and rows[1]["remaining_balance"] == 7.0
    assert not rows[2]["is_approved"] and rows[2]["remaining_balance"] == 5.0
    assert rows[2]["rejection_reason"] == "Insufficient balance: requested 12.0 days but only 5.0 days available."
    assert not rows[3]["is_approved"] and rows[3]["requires_manager_override"]
    assert rows[4]["is_approved"] and rows[4]["remaining_balance"] == -7.0 and rows[4]["requires_manager_override"]
    assert rows[5]["rejection_reason"] == "Requested leave days must be greater than 0."


def _punches(spark, rows):
    return spark.createDataFrame(
        rows, "tenant_id string, employee_id string, punch_id long, ts string, lat double, lng double, punch_type string"
    ).withColumn("ts", F.col("ts").cast("timestamp"))


def test_impossible_travel(spark):
    df = _punches(
        spark,
        [
            ("T", "A", 1, "2026-01-01T09:00:00Z", 19.0760, 72.8777, "IN"),
            ("T", "A", 2, "2026-01-01T10:00:00Z", 25.2048, 55.2708, "OUT"),
            ("T", "B", 3, "2026-01-01T09:00:00Z", 19.0760, 72.8777, "IN"),
            ("T", "B", 4, "2026-01-01T09:30:00Z", 19.1136, 72.8697, "OUT"),
            ("T", "C", 5, "2026-01-01T09:30:00Z", 0.0, 0.0, "IN"),
            ("T", "C", 6, "2026-01-01T09:30:00Z", 0.0, 1.0, "OUT"),
            ("T", "D", 7, "2026-01-01T09:30:00Z", None, 1.0, "OUT"),
            ("T", "D", 8, "2026-01-01T09:31:00Z", 50.0, 1.0, "OUT"),
            ("T", "E", 9, "2026-01-01T23:59:00Z", 0.0, 0.0, "OUT"),
            ("T", "E", 10, "2026-03-01T00:01:00Z", 1.0, 1.0, "OUT"),
        ],
    )
    rows = {r["employee_id"]: r for r in attendance.impossible_travel(df).collect()}
    assert rows["A"]["is_anomaly"] and rows["A"]["distance_km"] == 1935.09 and rows["A"]["speed_kmh"] > 1800
    assert rows["A"]["explanation"].startswith("Impossible travel detected: 1935.1 km traversed in 1.00 hours (1935.1 km/h)")
    assert not rows["B"]["is_anomaly"] and rows["B"]["speed_kmh"] < 50
    assert rows["C"]["is_anomaly"] and rows["C"]["speed_kmh"] == 999999.0
    assert "D" not in rows
    assert rows["E"]["second_punch_time"].month == 3  # pairs reach over empty buckets


def test_pairs_equal_a_plain_window(spark):
    """Any number of ranges gives the pairs of one lag over the whole key, hot key included."""
    from pyspark.sql import Window

    from crewframe.operators.sequences import successive_pairs

    df = (
        spark.range(2000)
        .select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).alias("k"),
            F.timestamp_seconds((F.xxhash64("id") % 40000)).alias("ts"),
            "id",
        )
    )
    plain = df.withColumn("before", F.lag("id").over(Window.partitionBy("k").orderBy("ts", "id"))).filter("before is not null")
    want = {(r["k"], r["before"], r["id"]) for r in plain.collect()}
    name, before = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set(name, "false")
        for width in ("1", "5", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", width)
            got = successive_pairs(df, ["k"], "ts", "id")
            assert {(r["k"], r["prev"]["id"], r["cur"]["id"]) for r in got.collect()} == want
    finally:
        spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_daily_hours(spark):
    df = _punches(
        spark,
        [
            ("T", "A", 1, "2026-01-01T09:00:00Z", None, None, "IN"),
            ("T", "A", 2, "2026-01-01T13:00:00Z", None, None, "OUT"),
            ("T", "A", 3, "2026-01-01T22:00:00Z", None, None, "IN"),
            ("T", "A", 4, "2026-01-02T05:30:00Z", None, None, "OUT"),
            ("T", "A", 5, "2026-01-02T06:30:00Z", None, None, "OUT"),
            ("T", "B", 6, "2026-01-02T06:30:00Z", None, None, "IN"),
        ],
    )
    rows = [tuple(r) for r in attendance.daily_hours(df).collect()]
    assert rows == [("T", "A", date(2026, 1, 1), 2, 11.5)]


LINES = "claim_id string, line_no int, category string, amount decimal(18,2), date date, has_receipt boolean"


def _claims(spark):
    from decimal import Decimal as D

    lines = spark.createDataFrame(
        [
            ("C1", 1, "MEAL", D(1200), None, True), ("C1", 2, "LOCAL_CONVEYANCE", D(800), None, True),
            ("C2", 1, "Meal", D(4500), None, True),
            ("C3", 1, "FLIGHT", D(12000), None, True),
            ("C4", 1, "HOTEL", D(5000), None, True), ("C4", 2, "HOTEL", D(5000), None, True),
            ("C4", 3, "MEAL", D(500), None, False),
            # a line that failed an earlier check is no duplicate partner
            ("C5", 1, "HOTEL", D(900), None, False), ("C5", 2, "HOTEL", D(900), None, True),
            ("C5", 3, "HOTEL", D(900), None, True), ("C5", 4, "MEAL", D(250), None, False),
            ("C6", 1, "DINING", D(500), date(2026, 1, 1), None), ("C6", 2, "DINING", D(500), date(2026, 1, 2), None),
        ],
        LINES,
    )
    claims = spark.createDataFrame(
        [
            ("C1", "INR", "METRO", True), ("C2", "inr", "metro", True), ("C3", "INR", "METRO", False),
            ("C4", "INR", "METRO", True), ("C5", "INR", "METRO", None), ("C6", "AED", "NON_METRO", True),
        ],
        "claim_id string, currency string, tier string, has_approved_travel_request boolean",
    )
    return lines, claims


def test_claim_report(spark):
    rows = {r["claim_id"]: r for r in expenses.claim_report(*_claims(spark)).collect()}
    totals = {k: tuple(int(r[c]) for c in ("total_claimed", "total_approved", "total_disallowed", "violations_count")) for k, r in rows.items()}
    assert totals == {
        "C1": (2000, 2000, 0, 0), "C2": (4500, 3000, 1500, 1), "C3": (12000, 0, 12000, 1),
        "C4": (10500, 5000, 5500, 2), "C5": (2950, 1150, 1800, 2), "C6": (1000, 500, 500, 2),
    }
    assert rows["C1"]["is_fully_approved"] and rows["C3"]["reimbursement_schedule"] == "N/A"


def test_claim_line_findings(spark):
    rows = expenses.claim_line_findings(*_claims(spark)).collect()
    got = sorted((r["claim_id"], r["line_no"], r["severity"], int(r["disallowed_amount"])) for r in rows)
    assert got == [
        ("C2", 1, "EXCEEDS_PER_DIEM", 1500), ("C3", 1, "POLICY_BREACH", 12000),
        ("C4", 2, "SUSPECTED_DUPLICATE", 5000), ("C4", 3, "MISSING_DOCUMENTATION", 500),
        ("C5", 1, "MISSING_DOCUMENTATION", 900), ("C5", 3, "SUSPECTED_DUPLICATE", 900),
        ("C6", 1, "EXCEEDS_PER_DIEM", 250), ("C6", 2, "EXCEEDS_PER_DIEM", 250),
    ]
    meal = next(r for r in rows if r["claim_id"] == "C2")
    assert meal["explanation"] == "Meal expense of INR 4,500.00 exceeds METRO per-diem cap of INR 3,000.00 by INR 1,500.00."


def test_line_findings_add_up_to_the_report(spark):
    lines, claims = _claims(spark)
    per_line = expenses.claim_line_findings(lines, claims).groupBy("claim_id").agg(F.sum("disallowed_amount").alias("d"))
    report = expenses.claim_report(lines, claims).filter("total_disallowed > 0")
    assert {tuple(r) for r in per_line.collect()} == {(r["claim_id"], r["total_disallowed"]) for r in report.collect()}
