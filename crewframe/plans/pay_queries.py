"""Pay, settlement and exit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewframe import refdata
from crewframe.operators import exits, pay
from crewframe.plans import adapters as ad
from crewframe.plans.registry import query
from crewframe.plans.sqlviews import amount, hu, text, with_views

KEY = F.col


def _with_annual(spark, sf_dir):
    """Staff with an annual cost of fifty times the monthly basic and varied shares."""
    key = F.col("employee_id")
    return ad.employees(spark, sf_dir).select(
        "employee_id",
        (F.col("basic_salary") * 50).cast("decimal(18,2)").alias("annual_ctc"),
        (F.lit(40) + key % 4 * 10).alias("basic_pct"),
        (F.lit(20) + key % 3 * 10).alias("hra_pct"),
        (key % 5 == 0).alias("cap_pf"),
    )


@query(
    "india_salary",
    with_views(
        ["employees"],
        f"""SELECT employee_id, {amount('ctc')} AS annual_ctc, {amount('month')} AS monthly_ctc,
          {amount('basic')} AS basic_salary, {amount('hra')} AS hra, {amount('greatest(special, 0)')} AS special_allowance,
          {amount('gross')} AS gross_salary, {amount('pf')} AS employee_pf, {amount('pf - eps')} AS employer_epf,
          {amount('eps')} AS employer_eps, {amount('grat')} AS gratuity_monthly_provision,
          {amount('esi')} AS employee_esi, {amount('esi_er')} AS employer_esi,
          {amount('gross - pf - esi - 20000')} AS net_take_home
        FROM (SELECT *, CASE WHEN gross <= 2100000 THEN {hu('gross * 75', 10000)} ELSE 0 END AS esi,
                CASE WHEN gross <= 2100000 THEN {hu('gross * 325', 10000)} ELSE 0 END AS esi_er FROM f)""",
        f"""a AS (SELECT employee_id, basic * 50 AS ctc, 40 + employee_id % 4 * 10 AS bp, 20 + employee_id % 3 * 10 AS hp,
              employee_id % 5 = 0 AS cap FROM employees),
        b AS (SELECT *, {hu('ctc', 12)} AS month FROM a),
        c AS (SELECT *, {hu('month * bp', 100)} AS basic, {hu('month * hp', 100)} AS hra FROM b),
        d AS (SELECT *, {hu('(CASE WHEN cap THEN least(basic, 1500000) ELSE basic END) * 12', 100)} AS pf,
              least({hu('least(basic, 1500000) * 833', 10000)}, 125000) AS eps, {hu('basic * 15', 312)} AS grat FROM c),
        e AS (SELECT *, month - pf - grat AS g0, month - pf - grat - basic - hra AS special FROM d),
        f AS (SELECT *, CASE WHEN special < 0 THEN basic + hra ELSE g0 END AS gross FROM e)""",
    ),
)
def india_salary(spark, sf_dir):
    """Indian salary structure of every employee."""
    df = pay.india_salary(
        _with_annual(spark, sf_dir), basic_pct=KEY("basic_pct"), hra_pct=KEY("hra_pct"), cap_pf=KEY("cap_pf")
    )
    return df.select(
        "employee_id", "annual_ctc", "monthly_ctc", "basic_salary", "hra", "special_allowance", "gross_salary",
        "employee_pf", "employer_epf", "employer_eps", "gratuity_monthly_provision", "employee_esi", "employer_esi",
        "net_take_home",
    )


@query(
    "uae_salary",
    with_views(
        ["employees"],
        f"""SELECT employee_id, {amount('gross')} AS monthly_gross, {amount('b')} AS basic_wage,
          {amount('h')} AS housing_allowance, {amount('t')} AS transport_allowance,
          {amount('greatest(gross - b - h - t, 0)')} AS other_allowances, true AS wps_compliant,
          {amount(hu(hu('b', 30) + ' * 21', 12))} AS estimated_monthly_eosb_accrual,
          {text('|'.join(refdata.UAE_PAY_CITATIONS))} AS statutory_citations
        FROM a""",
        f"""a AS (SELECT employee_id, basic * 2 + 1 AS gross, {hu('(basic * 2 + 1) * 60', 100)} AS b,
              {hu('(basic * 2 + 1) * 30', 100)} AS h, {hu('(basic * 2 + 1) * 10', 100)} AS t FROM employees)""",
    ),
)
def uae_salary(spark, sf_dir):
    """Emirati salary split of every employee."""
    df = ad.employees(spark, sf_dir).select(
        "employee_id", (F.col("basic_salary") * 2 + F.lit("0.01").cast("decimal(3,2)")).alias("monthly_gross")
    )
    return pay.uae_salary(df)


EOSB = f"""CASE WHEN tenths < 10 THEN 0 WHEN tenths <= 50 THEN {hu('basic * 21 * tenths', 300)}
  ELSE {hu('basic * 105', 30)} + {hu('basic * (tenths - 50)', 10)} END"""
GRATUITY = f"CASE WHEN tenths < 50 THEN 0 ELSE least({hu('15 * basic * tenths', 260)}, 200000000) END"
TENURE_TEXT = "printf('%d.%d0', tenths // 10, tenths % 10)"


@query(
    "uae_eosb",
    with_views(
        ["employees"],
        f"""SELECT employee_id, {amount('least(owed, basic * 24)')} AS total_eosb_gratuity,
          owed > basic * 24 AS is_capped, {text(refdata.UAE_EOSB_CITATION)} AS statutory_citation
        FROM (SELECT *, {EOSB} AS owed FROM employees)""",
    ),
)
def uae_eosb(spark, sf_dir):
    """End-of-service pay of every employee."""
    df = ad.employees(spark, sf_dir).select("employee_id", F.col("basic_salary").alias("basic_wage_monthly"), "tenure_years")
    return pay.uae_eosb(df).select(
        "employee_id", "total_eosb_gratuity", F.contains("formula_breakdown", F.lit("Capped at")).alias("is_capped"),
        "statutory_citation",
    )


@query(
    "india_gratuity",
    with_views(
        ["employees"],
        f"""SELECT employee_id, {amount(GRATUITY)} AS gratuity_amount,
          CASE WHEN tenths < 50 THEN 'Service tenure less than 5 years. No statutory gratuity entitled.'
            ELSE 'Tenure: ' || {TENURE_TEXT} || ' yrs. Calculation: (15 * '
              || printf('%d.%02d', basic // 100, basic % 100) || ' * ' || {TENURE_TEXT} || ') / 26 = INR '
              || printf('%d.%02d', ({hu('15 * basic * tenths', 260)})::BIGINT // 100, ({hu('15 * basic * tenths', 260)})::BIGINT % 100)
            END AS formula_breakdown
        FROM employees""",
    ),
)
def india_gratuity(spark, sf_dir):
    """Gratuity of every employee with the worked formula."""
    df = ad.employees(spark, sf_dir).select("employee_id", F.col("basic_salary").alias("last_drawn_basic"), "tenure_years")
    return pay.india_gratuity(df).select("employee_id", "gratuity_amount", "formula_breakdown")


@query(
    "salary_by_jurisdiction",
    with_views(
        ["employees"],
        f"""SELECT employee_id, jurisdiction,
          CASE WHEN jurisdiction = 'AE' THEN {amount(hu('monthly * 60', 100))} ELSE 0.0 END AS uae_basic,
          CASE WHEN jurisdiction = 'AE' THEN 0.0 ELSE {amount(hu(hu('ctc', 12) + ' * 40', 100))} END AS india_basic
        FROM a""",
        f"""a AS (SELECT employee_id, jurisdiction,
              CASE WHEN employee_id % 3 = 0 THEN {hu('basic * 12', 12)} ELSE basic END AS monthly,
              basic * 12 AS ctc FROM employees)""",
    ),
)
def salary_by_jurisdiction(spark, sf_dir):
    """Route every employee to the structure of the jurisdiction, from annual or monthly amounts."""
    annual = F.col("employee_id") % 3 == 0
    df = ad.employees(spark, sf_dir).select(
        "employee_id",
        "jurisdiction",
        F.when(annual, F.col("basic_salary") * 12).otherwise(F.col("basic_salary")).alias("amount"),
        F.when(annual, F.lit("ANNUAL")).otherwise(F.lit("MONTHLY")).alias("amount_period"),
    )
    zero = F.lit(0.0)
    return pay.salary_by_jurisdiction(df).select(
        "employee_id",
        "jurisdiction",
        F.coalesce(F.col("uae.basic_wage").cast("double"), zero).alias("uae_basic"),
        F.coalesce(F.col("india.basic_salary").cast("double"), zero).alias("india_basic"),
    )


@query(
    "final_settlement",
    with_views(
        ["employees"],
        f"""SELECT employee_id, jurisdiction, {amount('dg * (employee_id % 31)')} AS unpaid_salary_amount,
          {amount('enc')} AS leave_encashment_amount, {amount('grat')} AS gratuity_amount,
          {amount('dg * (employee_id % 10 - employee_id % 7)')} AS notice_adjustment,
          {amount('dg * (employee_id % 7)')} AS deductions_total,
          {amount('dg * (employee_id % 31) + enc + grat + dg * (employee_id % 10 - employee_id % 7)')} AS total_net_payable
        FROM b""",
        f"""a AS (SELECT *, {hu('basic * 2', 30)} AS dg, {hu('basic', 30)} AS db FROM employees),
        b AS (SELECT *, {hu('db * (employee_id % 200)', 10)} AS enc,
              CASE WHEN jurisdiction = 'AE' THEN least({EOSB}, basic * 24) ELSE {GRATUITY} END AS grat FROM a)""",
    ),
)
def final_settlement(spark, sf_dir):
    """Final settlement of every employee."""
    key = F.col("employee_id")
    df = ad.employees(spark, sf_dir).select(
        "employee_id",
        "jurisdiction",
        F.col("basic_salary").alias("basic_wage_monthly"),
        (F.col("basic_salary") * 2).alias("gross_wage_monthly"),
        "tenure_years",
        ((key % 200).cast("decimal(6,0)") / 10).alias("unused_leave_days"),
        (key % 31).cast("int").alias("unpaid_work_days"),
        (key % 10).cast("int").alias("notice_days_to_pay"),
        (key % 7).cast("int").alias("notice_days_to_deduct"),
    )
    return exits.final_settlement(df).select(
        "employee_id", "jurisdiction", "unpaid_salary_amount", "leave_encashment_amount", "gratuity_amount",
        "notice_adjustment", "deductions_total", "total_net_payable",
    )


@query(
    "settlement_deadline",
    """SELECT o_orderkey AS exit_id, e AS days_elapsed, greatest(14 - e, 0) AS days_remaining,
      CASE WHEN e > 14 THEN 'STATUTORY_BREACH' WHEN e >= 11 THEN 'APPROACHING_DEADLINE' ELSE 'ON_TRACK' END AS status,
      CASE WHEN e > 14 THEN 'Settlement is overdue by ' || (e - 14) || ' days. Risk of MOHRE labor grievance, '
            || 'financial penalty, and company work permit blocking.'
        WHEN e >= 11 THEN 'Critical settlement deadline in ' || (14 - e) || ' days. Urgent payroll release required.'
        ELSE '' END AS penalty_risk
    FROM (SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-06-15') AS e FROM orders)""",
)
def settlement_deadline(spark, sf_dir):
    """Settlement deadline of every exit, an exit being an order date."""
    df = ad.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("exit_id"), F.to_date("o_orderdate").alias("last_working_day")
    )
    return exits.settlement_deadline(df, F.lit("1998-06-15").cast("date")).select(
        "exit_id", "days_elapsed", "days_remaining", "status", "penalty_risk"
    )


def _exits(spark, sf_dir):
    staff = ad.employees(spark, sf_dir).select(
        F.lit("T").alias("tenant_id"), "employee_id", F.col("last_name").alias("employee_name"),
        F.col("first_name").alias("department"), (F.col("employee_id") % 4 != 0).alias("finance_cleared"),
    )
    assets = ad.table(spark, sf_dir, "orders").select(
        F.lit("T").alias("tenant_id"), F.col("o_custkey").alias("employee_id"),
        F.concat(F.lit("ASSET-"), F.col("o_orderkey").cast("string")).alias("asset"),
        (F.col("o_orderstatus") != "P").alias("returned"),
    )
    return staff, assets


@query(
    "exit_clearance",
    with_views(
        ["employees"],
        """SELECT employee_id, coalesce(p, 0) + CASE WHEN fin THEN 0 ELSE 1 END AS pending_count,
          coalesce(r, 0) + CASE WHEN fin THEN 1 ELSE 0 END AS completed_count,
          coalesce(p, 0) = 0 AND fin AS is_fully_cleared,
          CASE WHEN coalesce(p, 0) = 0 AND fin THEN md5('EXPERIENCE & RELIEVING CERTIFICATE' || chr(10) || chr(10)
            || 'To Whom It May Concern,' || chr(10) || chr(10) || 'This is to certify that ' || last_name
            || ' (Employee ID: ' || employee_id || ') was employed with us in the ' || first_name
            || ' department. All organizational dues and property have been satisfactorily cleared. '
            || 'We wish them success in their future endeavors.' || chr(10) || chr(10)
            || 'Authorized Signatory, HR Operations.') ELSE '' END AS letter_md5
        FROM (SELECT *, employee_id % 4 <> 0 AS fin FROM employees) LEFT JOIN a ON employee_id = o_custkey""",
        """a AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'P') AS p,
              count(*) FILTER (WHERE o_orderstatus <> 'P') AS r FROM orders GROUP BY 1)""",
    ),
)
def exit_clearance(spark, sf_dir):
    """Clearance verdict of every employee, orders being their assets."""
    return exits.exit_clearance(*_exits(spark, sf_dir)).select(
        "employee_id", "pending_count", "completed_count", "is_fully_cleared",
        F.md5("relieving_letter_draft").alias("letter_md5"),
    )


@query(
    "clearance_items",
    with_views(
        ["employees"],
        f"""SELECT o_custkey AS employee_id, 'ASSET-' || o_orderkey AS item, o_orderstatus = 'P' AS is_pending
        FROM orders JOIN employees ON o_custkey = employee_id
        UNION ALL SELECT employee_id, CASE WHEN employee_id % 4 <> 0 THEN {text(refdata.FINANCE_DONE)}
          ELSE {text(refdata.FINANCE_PENDING)} END, employee_id % 4 = 0 FROM employees""",
    ),
)
def clearance_items(spark, sf_dir):
    """Checklist items of every leaver."""
    return exits.clearance_items(*_exits(spark, sf_dir)).drop("tenant_id")
