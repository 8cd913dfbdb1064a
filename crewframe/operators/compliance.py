"""Labour-rule audits of employees, working hours and payroll batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewframe.operators.findings import emit, finding, text

# Rule keys, violation ids, sentences, penalties and advice of the findings below must read exactly so.


def _pick(df: DataFrame, names: list[str], kind: str) -> Column:
    """First of several optional columns that is neither null nor empty nor zero."""
    present = [F.col(n).try_cast(kind) for n in names if n in df.columns]
    if not present:
        return F.lit(None).cast(kind)
    if kind == "string":
        present = [F.when(c != "", c) for c in present]
    else:
        present = [F.when(c != 0, c) for c in present]
    return F.coalesce(*present)


def _name(df: DataFrame, column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) if column in df.columns else F.lit("")


def audit_employees(df: DataFrame) -> DataFrame:
    """Probation longer than 180 days (AE) and missing provident fund cover (IN)."""
    employee = F.coalesce(_pick(df, ["id", "employee_id"], "string"), F.lit("UNKNOWN"))
    shown = next((F.col(c).cast("string") for c in ("probation_days", "probation_period_days") if c in df.columns), None)
    probation = _pick(df, ["probation_days", "probation_period_days"], "double")
    if "probation_days" in df.columns and "probation_period_days" in df.columns:
        shown = F.when(F.col("probation_days").try_cast("double") != 0, F.col("probation_days").cast("string")).otherwise(
            F.col("probation_period_days").cast("string")
        )
    shown = F.lit(None).cast("string") if shown is None else shown
    basic = _pick(df, ["basic_salary", "basic"], "decimal(18,2)")
    flags = [F.col(c).try_cast("boolean") for c in ("is_pf_enrolled", "pf_applicable") if c in df.columns]
    enrolled = F.coalesce(*flags, F.lit(True))
    rules = [
        (
            (F.col("jurisdiction") == "AE") & (probation > 180),
            finding(
                "UAE_MAX_PROBATION_EXCEEDED", "HIGH", "EMPLOYEE",
                text("VIO-PROB-", employee), employee,
                text("Probation period of ", shown, " days exceeds statutory maximum of 6 months (180 days)."),
                text(
                    "Employee ", _name(df, "first_name"), " ", _name(df, "last_name"), " has probation set to ",
                    shown, " days. UAE Labor Law strictly caps probation at 180 days.",
                ),
                "Administrative fines from MoHRE up to AED 10,000.",
                "Reduce probation period to statutory limit of 180 days.",
                '{"probation_days":180}',
            ),
        ),
        (
            (F.col("jurisdiction") == "IN") & (basic > 0) & (basic <= 15000) & ~enrolled,
            finding(
                "INDIA_MANDATORY_PF_MISSING", "CRITICAL", "EMPLOYEE",
                text("VIO-PF-", employee), employee,
                text("Employee earning <= INR 15,000 basic is not enrolled in statutory Provident Fund."),
                text(
                    "Employee has monthly basic wage INR ", basic,
                    " (< 15,000 threshold) but PF coverage is disabled.",
                ),
                "Penal damages under Section 14B up to 25% + IPC 406 liability.",
                "Enable statutory EPF contribution (12% employee + 12% employer).",
                '{"is_pf_enrolled":true,"pf_applicable":true}',
            ),
        ),
    ]
    return emit(df, rules, ["tenant_id", "jurisdiction"])


def audit_daily_hours(df: DataFrame) -> DataFrame:
    """Days with more than ten hours of work (AE)."""
    employee = F.coalesce(_pick(df, ["employee_id", "emp_id"], "string"), F.lit("UNKNOWN"))
    hours = F.coalesce(_pick(df, ["total_hours", "hours_worked"], "double"), F.lit(0.0))
    day = F.coalesce(_pick(df, ["work_date", "date"], "string"), F.lit("UNKNOWN_DATE"))
    rule = (
        (F.col("jurisdiction") == "AE") & (hours > 10),
        finding(
            "UAE_MAX_DAILY_HOURS_EXCEEDED", "HIGH", "PUNCH_LOG",
            text("VIO-OT-", employee, "-", day), employee,
            text("Daily working hours of ", hours, "h exceeds statutory cap of 10 hours (8h standard + 2h max overtime)."),
            text(
                "Employee logged ", hours, " hours on ", day,
                ". UAE Article 17 prohibits daily working time exceeding 10 hours including overtime.",
            ),
            "MoHRE labor inspector citation and company fine.",
            "Cap payable regular + overtime hours at 10 hours and issue alert.",
            '{"total_hours":10.0,"excess_overtime_flag":true}',
        ),
    )
    return emit(df, [rule], ["tenant_id", "jurisdiction"])


def payroll_batches(employees: DataFrame, payslips: DataFrame, as_of: Column) -> DataFrame:
    """Headcount and paid headcount per tenant, jurisdiction and batch.

    ``employees``: tenant_id, jurisdiction, batch_id, employee_id, period_end - who is due.
    ``payslips``: tenant_id, batch_id, employee_id - who was paid.
    """
    keys = ["tenant_id", "batch_id", "employee_id"]
    paid = payslips.select(*keys).distinct().withColumn("_paid", F.lit(1))
    return (
        employees.join(paid, keys, "left")
        .groupBy("tenant_id", "jurisdiction", "batch_id")
        .agg(
            F.count("*").alias("total_headcount"),
            F.count("_paid").alias("paid_headcount"),
            F.date_diff(as_of, F.max("period_end")).alias("days_since_period_end"),
        )
    )


def audit_wps(df: DataFrame) -> DataFrame:
    """Wage transfers that reach under 90 % of staff or come later than 15 days (AE).

    ``df``: one row per batch with total_headcount, paid_headcount, days_since_period_end.
    A null paid count means everybody was paid; zero means nobody was.
    """
    total = F.coalesce(F.when(F.col("total_headcount") != 0, F.col("total_headcount")), F.lit(1))
    paid = F.coalesce(F.col("paid_headcount"), total)
    share = paid / total * 100.0
    delay = F.coalesce(F.col("days_since_period_end"), F.lit(0))
    is_uae = F.col("jurisdiction") == "AE"
    batch = F.coalesce(F.col("batch_id").cast("string"), F.lit("BATCH-01"))
    rules = [
        (
            is_uae & (share < 90.0),
            finding(
                "UAE_WPS_SUB_90_PERCENT_QUOTA", "CRITICAL", "PAYROLL",
                text("VIO-WPS-QUOTA-", F.col("tenant_id")), batch,
                text(
                    "WPS payment coverage is ", F.format_string("%.1f", share),
                    "%, failing the statutory 90% minimum threshold.",
                ),
                text("Only ", paid, " of ", total, " employees are included in disbursement file."),
                "Immediate block on MoHRE portal for issuing new work permits & company fines.",
                "Include missing active employees in the SIF (Salary Information File) generation.",
                '{"include_all_active_employees":true}',
            ),
        ),
        (
            is_uae & (delay > 15),
            finding(
                "UAE_WPS_PAYMENT_DELAYED", "CRITICAL", "PAYROLL",
                text("VIO-WPS-DELAY-", F.col("tenant_id")), batch,
                text("Payroll disbursement is delayed by ", delay, " days (> 15-day limit)."),
                text("MoHRE requires wages to be transferred within 15 days from the period due date."),
                "Administrative fine of AED 1,000 per delayed worker and corporate rating downgrade.",
                "Execute SIF bank transfer immediately to avoid automated sanctions.",
                None,
            ),
        ),
    ]
    return emit(df, rules, ["tenant_id", "jurisdiction"])
