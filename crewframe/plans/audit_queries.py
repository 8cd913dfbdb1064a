"""Compliance, attendance, leave and expense queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewframe import refdata
from crewframe.operators import attendance, compliance, expenses, findings
from crewframe.operators.governance import authorize_actions
from crewframe.plans import adapters as ad
from crewframe.plans.registry import query
from crewframe.plans.sqlviews import listed, pick, text, with_views

CITE = refdata.RULE_CITATIONS
FINDINGS = f"""found AS (
  SELECT tenant_id, jurisdiction, 'VIO-PROB-' || id AS violation_id, 'UAE_MAX_PROBATION_EXCEEDED' AS rule_key,
    'HIGH' AS severity, id AS entity_id,
    'Probation period of ' || probation_days || ' days exceeds statutory maximum of 6 months (180 days).' AS summary,
    'Employee ' || first_name || ' ' || last_name || ' has probation set to ' || probation_days
      || ' days. UAE Labor Law strictly caps probation at 180 days.' AS detailed_findings,
    {text(CITE['UAE_MAX_PROBATION_EXCEEDED'])} AS statutory_citation, '{{"probation_days":180}}' AS remediation_patch
  FROM employees WHERE jurisdiction = 'AE' AND probation_days > 180
  UNION ALL
  SELECT tenant_id, jurisdiction, 'VIO-PF-' || id, 'INDIA_MANDATORY_PF_MISSING', 'CRITICAL', id,
    'Employee earning <= INR 15,000 basic is not enrolled in statutory Provident Fund.',
    'Employee has monthly basic wage INR ' || (basic // 100) || '.' || lpad((basic % 100)::VARCHAR, 2, '0')
      || ' (< 15,000 threshold) but PF coverage is disabled.',
    {text(CITE['INDIA_MANDATORY_PF_MISSING'])}, '{{"is_pf_enrolled":true,"pf_applicable":true}}'
  FROM employees WHERE jurisdiction = 'IN' AND basic > 0 AND basic <= 1500000 AND NOT is_pf_enrolled)"""


@query("employee_audit", with_views(["employees"], "SELECT * FROM found", FINDINGS))
def employee_audit(spark, sf_dir):
    """Findings on every employee with the statute cited."""
    return compliance.audit_employees(ad.employees(spark, sf_dir)).select(
        "tenant_id", "jurisdiction", "violation_id", "rule_key", "severity", "entity_id", "summary",
        "detailed_findings", "statutory_citation", "remediation_patch",
    )


@query(
    "compliance_report",
    with_views(
        ["employees"],
        """SELECT e.tenant_id, e.jurisdiction, e.n AS total_records_audited, coalesce(v.n, 0) AS violations_count,
          coalesce(v.c, 0) AS critical_count, coalesce(v.h, 0) AS high_count, coalesce(v.n, 0) = 0 AS is_compliant,
          CASE WHEN coalesce(v.n, 0) = 0 THEN 92 ELSE greatest(50, 100 - 15 * v.n) END AS dashboard_score
        FROM (SELECT tenant_id, jurisdiction, count(*) AS n FROM employees GROUP BY 1, 2) e
        LEFT JOIN (SELECT tenant_id, jurisdiction, count(*) AS n, count(*) FILTER (WHERE severity = 'CRITICAL') AS c,
            count(*) FILTER (WHERE severity = 'HIGH') AS h FROM found GROUP BY 1, 2) v
          ON e.tenant_id = v.tenant_id AND e.jurisdiction = v.jurisdiction""",
        FINDINGS,
    ),
)
def compliance_report(spark, sf_dir):
    """Violations and score per tenant and jurisdiction."""
    staff = ad.employees(spark, sf_dir)
    return findings.compliance_report(compliance.audit_employees(staff), staff)


ROLES = list(refdata.ROLE_PERMISSIONS)


@query(
    "remediation_queue",
    with_views(
        ["employees"],
        f"""SELECT f.tenant_id, f.violation_id, a.approver_id, a.role AS approver_role,
          CASE WHEN a.role IN ('SUPER_ADMIN', 'HR_ADMIN', 'PAYROLL_ADMIN') THEN 'APPROVED_AND_QUEUED' ELSE 'REFUSED' END AS queue_status,
          'sha256:' || sha256('{{"remediation_patch":' || to_json(f.remediation_patch)::VARCHAR || ',"rule_key":"' || f.rule_key
            || '","violation_id":"' || f.violation_id || '"}}') AS reasoning_hash
        FROM found f JOIN (SELECT tenant_id, 'U' || employee_id AS approver_id, {pick(ROLES, 'employee_id % 6')} AS role,
            unnest(['VIO-PROB-' || id, 'VIO-PF-' || id]) AS violation_id FROM employees) a
          ON f.tenant_id = a.tenant_id AND f.violation_id = a.violation_id""",
        FINDINGS,
    ),
)
def remediation_queue(spark, sf_dir):
    """What became of every finding under its approval."""
    staff = ad.employees(spark, sf_dir)
    approvals = staff.select(
        "tenant_id", F.col("id").alias("entity_id"),
        F.concat(F.lit("U"), F.col("employee_id").cast("string")).alias("approver_id"),
        ad.pick(ROLES, F.col("employee_id") % 6).alias("approver_role"),
        F.explode(F.array(F.concat(F.lit("VIO-PROB-"), "id"), F.concat(F.lit("VIO-PF-"), "id"))).alias("violation_id"),
    )
    return findings.remediation_queue(compliance.audit_employees(staff), approvals).select(
        "tenant_id", "violation_id", "approver_id", "approver_role", "queue_status", "reasoning_hash"
    )


SHIFTS = """shifts AS (
  SELECT tenant_id, employee_id, pt AS in_ts, ts AS out_ts FROM (
    SELECT *, lag(ts) OVER w AS pt, lag(punch_type) OVER w AS pp FROM punches
    WINDOW w AS (PARTITION BY tenant_id, employee_id ORDER BY ts, punch_id))
  WHERE pp = 'IN' AND punch_type = 'OUT'),
days AS (
  SELECT tenant_id, employee_id, in_ts::DATE AS d, count(*) AS shifts,
    round(sum(epoch_us(out_ts) - epoch_us(in_ts))::DOUBLE / 3600000000.0, 2) AS total_hours
  FROM shifts GROUP BY 1, 2, 3)"""
DAYS = "SELECT tenant_id, employee_id, d::VARCHAR AS work_date, shifts, total_hours FROM days"


@query("daily_hours", with_views(["punches"], DAYS, SHIFTS))
def daily_hours(spark, sf_dir):
    """Hours per employee and day from the event stream's punches."""
    return attendance.daily_hours(ad.punches(spark, sf_dir))


@query(
    "hours_audit",
    with_views(
        ["punches"],
        f"""SELECT tenant_id, 'VIO-OT-' || employee_id || '-' || d AS violation_id, employee_id::VARCHAR AS entity_id,
          {text(CITE['UAE_MAX_DAILY_HOURS_EXCEEDED'])} AS statutory_citation
        FROM days WHERE employee_id % 2 = 0 AND total_hours > 10""",
        SHIFTS,
    ),
)
def hours_audit(spark, sf_dir):
    """Days over ten hours of employees under Emirati rules."""
    days = attendance.daily_hours(ad.punches(spark, sf_dir)).withColumn(
        "jurisdiction", F.when(F.col("employee_id") % 2 == 0, "AE").otherwise("IN")
    )
    return compliance.audit_daily_hours(days).select("tenant_id", "violation_id", "entity_id", "statutory_citation")


TRAVEL = """pairs AS (
  SELECT *, lag(ts) OVER w AS pt, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng FROM punches
  WINDOW w AS (PARTITION BY tenant_id, employee_id ORDER BY ts, punch_id)),
chord AS (
  SELECT *, pow(sin(radians(lat - plat) / 2), 2)
    + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lng - plng) / 2), 2) AS a FROM pairs WHERE pt IS NOT NULL),
dist AS (
  SELECT *, 2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)) AS km, (epoch_us(ts) - epoch_us(pt)) / 1000000.0::DOUBLE / 3600.0 AS h
  FROM chord),
travel AS (
  SELECT *, CASE WHEN h = 0 THEN CASE WHEN km > 0.1 THEN 999999.0 ELSE 0.0 END ELSE km / h END AS v FROM dist)"""
TRAVEL_OUT = """SELECT tenant_id, employee_id, punch_id, km > 5 AND v > 850 AS is_anomaly, round(v, 2) AS speed_kmh,
  round(km, 2) AS distance_km, round(h, 2) AS time_delta_hours,
  strftime(pt, '%Y-%m-%d %H:%M:%S.%f') AS first_punch_time, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS second_punch_time
FROM travel"""


@query("impossible_travel", with_views(["punches"], TRAVEL_OUT, TRAVEL))
def impossible_travel(spark, sf_dir):
    """Speed between successive punches of every employee."""
    return attendance.impossible_travel(ad.punches(spark, sf_dir)).drop("explanation")


@query(
    "wps_audit",
    f"""WITH staff AS (
      SELECT 'T' || n_regionkey AS tenant_id, CASE WHEN n_regionkey % 2 = 0 THEN 'AE' ELSE 'IN' END AS jurisdiction,
        strftime(o_orderdate, '%Y-%m') AS batch_id, o_orderdate::DATE AS d, o_orderstatus <> 'O' AS paid
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    batch AS (
      SELECT tenant_id, jurisdiction, batch_id, count(*) AS total, count(*) FILTER (WHERE paid) AS n,
        date_diff('day', max(d), DATE '2001-07-20') AS delay FROM staff GROUP BY 1, 2, 3)
    SELECT tenant_id, batch_id AS entity_id, 'UAE_WPS_SUB_90_PERCENT_QUOTA' AS rule_key, 'CRITICAL' AS severity,
      'Only ' || n || ' of ' || total || ' employees are included in disbursement file.' AS detailed_findings
    FROM batch WHERE jurisdiction = 'AE' AND n * 10 < total * 9
    UNION ALL
    SELECT tenant_id, batch_id, 'UAE_WPS_PAYMENT_DELAYED', 'CRITICAL',
      'MoHRE requires wages to be transferred within 15 days from the period due date.'
    FROM batch WHERE jurisdiction = 'AE' AND delay > 15""",
)
def wps_audit(spark, sf_dir):
    """Monthly payroll batches per tenant: an order is a wage due, paid unless open."""
    nation = ad.table(spark, sf_dir, "nation")
    customer = ad.table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    due = (
        ad.table(spark, sf_dir, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.concat(F.lit("T"), F.col("n_regionkey").cast("string")).alias("tenant_id"),
            F.when(F.col("n_regionkey") % 2 == 0, "AE").otherwise("IN").alias("jurisdiction"),
            F.date_format("o_orderdate", "yyyy-MM").alias("batch_id"),
            F.col("o_orderkey").alias("employee_id"),
            F.to_date("o_orderdate").alias("period_end"),
            "o_orderstatus",
        )
    )
    paid = due.filter(F.col("o_orderstatus") != "O")
    batches = compliance.payroll_batches(due, paid, F.lit("2001-07-20").cast("date"))
    return compliance.audit_wps(batches).select("tenant_id", "entity_id", "rule_key", "severity", "detailed_findings")


LEAVE_TYPES = ["ANNUAL", "SICK", "CASUAL"]


@query(
    "leave_decisions",
    f"""WITH r AS (
      SELECT o_orderkey AS request_id, {pick(LEAVE_TYPES, 'o_orderkey % 3')} AS leave_type, (o_orderkey % 12)::DOUBLE AS days,
        ((o_custkey + 5 * (o_orderkey % 3)) % 20)::DOUBLE AS bal, o_custkey % 5 = 0 AS prob, o_orderkey % 4 = 0 AS neg
      FROM orders JOIN customer ON o_custkey = c_custkey),
    v AS (SELECT *, CASE WHEN days <= 0 THEN 1 WHEN prob AND leave_type IN ('ANNUAL', 'CASUAL') AND bal < days THEN 2
        WHEN bal >= days THEN 3 WHEN neg THEN 4 ELSE 5 END AS k FROM r)
    SELECT request_id, leave_type, k IN (3, 4) AS is_approved, CASE WHEN k IN (3, 4) THEN bal - days ELSE bal END AS remaining_balance,
      CASE k WHEN 1 THEN 'Requested leave days must be greater than 0.'
        WHEN 2 THEN 'Insufficient balance and employee is currently in probationary status.'
        WHEN 5 THEN 'Insufficient balance: requested ' || days || ' days but only ' || bal || ' days available.'
        ELSE '' END AS rejection_reason, k IN (2, 4) AS requires_manager_override
    FROM v""",
)
def leave_decisions(spark, sf_dir):
    """Decide every leave request against balance and probation, orders being the requests."""
    key = F.col("o_orderkey")
    requests = ad.table(spark, sf_dir, "orders").select(
        F.lit("T").alias("tenant_id"), F.col("o_custkey").alias("employee_id"), key.alias("request_id"),
        ad.pick(LEAVE_TYPES, key % 3).alias("leave_type"), (key % 12).cast("double").alias("requested_days"),
        (key % 4 == 0).alias("allow_negative"),
    )
    staff = ad.table(spark, sf_dir, "customer").select(
        F.lit("T").alias("tenant_id"), F.col("c_custkey").alias("employee_id"), (F.col("c_custkey") % 5 == 0).alias("on_probation")
    )
    balances = staff.select(
        "tenant_id", "employee_id", F.posexplode(F.array(*[F.lit(t) for t in LEAVE_TYPES])).alias("_at", "leave_type")
    ).select(
        "tenant_id", "employee_id", "leave_type", ((F.col("employee_id") + F.col("_at") * 5) % 20).cast("double").alias("current_balance")
    )
    decided = attendance.evaluate_leave(attendance.leave_requests_with_balance(requests, balances, staff))
    return decided.select(
        "request_id", "leave_type", "is_approved", "remaining_balance", "rejection_reason", "requires_manager_override"
    )


CAP = "CASE " + " ".join(
    f"WHEN currency = '{c}' AND tier = '{t}' THEN {int(float(v))}" for (c, t), v in refdata.PER_DIEM.items()
) + " ELSE 2000 END"
CLAIM_VIEWS = f"""j AS (
  SELECT l.*, c.currency, c.tier, {CAP} AS cap,
    CASE WHEN NOT approved AND category IN ('FLIGHT', 'HOTEL') THEN 'POLICY_BREACH'
      WHEN NOT has_receipt AND amount > 250 THEN 'MISSING_DOCUMENTATION' END AS v0
  FROM lines l JOIN claims c ON l.claim_id = c.claim_id),
n AS (
  SELECT *, CASE WHEN v0 IS NULL THEN row_number() OVER (
      PARTITION BY claim_id, d, amount, category, v0 IS NULL ORDER BY line_no) END AS rn FROM j),
judged AS (
  SELECT *, CASE WHEN v0 IS NOT NULL THEN v0 WHEN rn > 1 THEN 'SUSPECTED_DUPLICATE'
      WHEN category = 'MEAL' AND amount > cap THEN 'EXCEEDS_PER_DIEM' END AS severity FROM n),
cut AS (
  SELECT *, CASE WHEN severity IS NULL THEN 0 WHEN severity = 'EXCEEDS_PER_DIEM' THEN amount - cap ELSE amount END AS gone
  FROM judged)"""


@query(
    "claim_audit",
    with_views(
        ["lines", "claims"],
        """SELECT claim_id, currency, sum(amount)::DOUBLE AS total_claimed, sum(amount - gone)::DOUBLE AS total_approved,
          sum(gone)::DOUBLE AS total_disallowed, count(severity) AS violations_count, count(severity) = 0 AS is_fully_approved,
          CASE WHEN sum(amount - gone) > 0 THEN 'Next Payroll Cycle Disbursement' ELSE 'N/A' END AS reimbursement_schedule
        FROM cut GROUP BY claim_id, currency""",
        CLAIM_VIEWS,
    ),
)
def claim_audit(spark, sf_dir):
    """Totals and verdict of every expense claim."""
    return expenses.claim_report(ad.claim_lines(spark, sf_dir), ad.claims(spark, sf_dir))


@query(
    "claim_line_findings",
    with_views(
        ["lines", "claims"],
        """SELECT claim_id, line_no, severity, category, amount::DOUBLE AS claimed_amount, (amount - gone)::DOUBLE AS allowed_amount,
          gone::DOUBLE AS disallowed_amount FROM cut WHERE severity IS NOT NULL""",
        CLAIM_VIEWS,
    ),
)
def claim_line_findings(spark, sf_dir):
    """Every expense line that breaks a rule."""
    return expenses.claim_line_findings(ad.claim_lines(spark, sf_dir), ad.claims(spark, sf_dir)).drop(
        "explanation", "policy_reference"
    )


PERMISSION_SQL = "CASE role " + " ".join(
    f"WHEN {text(r)} THEN list_contains({listed(p)}, permission)" for r, p in refdata.ROLE_PERMISSIONS.items()
) + " ELSE false END"


@query(
    "authorized_actions",
    f"""SELECT *, role_allowed AND duty_separated AS allowed FROM (
      SELECT event_id, role, permission, {PERMISSION_SQL} AS role_allowed,
        NOT (permission IN ('APPROVE_LEAVE', 'MUTATE_SALARY') AND user_id = target) AS duty_separated
      FROM (SELECT event_id, user_id, event_id % 150 AS target, {pick(ROLES + ['GUEST'], 'user_id % 7')} AS role,
          {pick(refdata.PERMISSIONS, 'event_id % 10')} AS permission FROM events))""",
)
def authorized_actions(spark, sf_dir):
    """Authorise every event as a requested action."""
    key = F.col("event_id")
    actions = ad.table(spark, sf_dir, "events").select(
        "event_id", "user_id", ad.pick(ROLES + ["GUEST"], F.col("user_id") % 7).alias("role"),
        ad.pick(refdata.PERMISSIONS, key % 10).alias("permission"), (key % 150).alias("target_employee_id"),
    )
    return authorize_actions(actions).drop("user_id", "target_employee_id")
