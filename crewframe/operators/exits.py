"""Final settlement, settlement deadline and exit clearance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewframe import refdata
from crewframe.functions.money import TENURE, at_least, dec, half_up, money
from crewframe.operators.pay import _texts, india_gratuity_amount, uae_eosb_amount

# The texts of certificates and deadlines below must read exactly so.


def final_settlement(df: DataFrame) -> DataFrame:
    """Net amount owed at exit: unpaid days, leave encashment, gratuity and notice."""
    is_uae = F.col("jurisdiction") == "AE"
    days = {
        name: F.coalesce(F.col(name).try_cast("decimal(10,0)"), F.lit(0).cast("decimal(10,0)"))
        for name in ("unpaid_work_days", "notice_days_to_pay", "notice_days_to_deduct")
    }
    basic, gross = F.col("basic_wage_monthly"), F.col("gross_wage_monthly")
    daily = F.col("_daily_gross")
    return (
        df.withColumns(
            {
                "basic_wage_monthly": money("basic_wage_monthly"),
                "gross_wage_monthly": money("gross_wage_monthly"),
                "tenure_years": F.col("tenure_years").try_cast(TENURE),
                "unused_leave_days": F.coalesce(F.col("unused_leave_days").try_cast(TENURE), dec("0", TENURE)),
            }
        )
        .withColumns({"_daily_gross": half_up(gross / F.lit(30)), "_daily_basic": half_up(basic / F.lit(30))})
        .withColumns(
            {
                "unpaid_salary_amount": half_up(daily * days["unpaid_work_days"]),
                "leave_encashment_amount": half_up(F.col("_daily_basic") * F.col("unused_leave_days")),
                "gratuity_amount": F.when(is_uae, uae_eosb_amount(basic, F.col("tenure_years"))).otherwise(
                    india_gratuity_amount(basic, F.col("tenure_years"))
                ),
                "deductions_total": half_up(daily * days["notice_days_to_deduct"]),
                "notice_adjustment": half_up(daily * (days["notice_days_to_pay"] - days["notice_days_to_deduct"])),
                "statutory_citations": F.when(is_uae, _texts(refdata.SETTLEMENT_CITATIONS["AE"])).otherwise(
                    _texts(refdata.SETTLEMENT_CITATIONS["OTHER"])
                ),
            }
        )
        .withColumn(
            "total_net_payable",
            half_up(
                F.col("unpaid_salary_amount")
                + F.col("leave_encashment_amount")
                + F.col("gratuity_amount")
                + F.col("notice_adjustment")
            ),
        )
        .drop("_daily_gross", "_daily_basic")
    )


def settlement_deadline(df: DataFrame, as_of: Column, last_day: str = "last_working_day") -> DataFrame:
    """Days left of the 14-day settlement window as seen on ``as_of``."""
    left = F.lit(14) - F.col("days_elapsed")
    breach, close = left < 0, left <= 3
    return df.withColumn("days_elapsed", F.date_diff(as_of, F.col(last_day))).withColumns(
        {
            "days_remaining": at_least(left, F.lit(0)),
            "status": F.when(breach, F.lit("STATUTORY_BREACH"))
            .when(close, F.lit("APPROACHING_DEADLINE"))
            .when(left.isNotNull(), F.lit("ON_TRACK")),
            "penalty_risk": F.when(
                breach,
                F.concat(
                    F.lit("Settlement is overdue by "), F.abs(left).cast("string"),
                    F.lit(" days. Risk of MOHRE labor grievance, financial penalty, and company work permit blocking."),
                ),
            ).when(
                close,
                F.concat(
                    F.lit("Critical settlement deadline in "), left.cast("string"),
                    F.lit(" days. Urgent payroll release required."),
                ),
            ),
            "statutory_citation": F.lit(refdata.UAE_DEADLINE_CITATION),
        }
    )


def clearance_items(exits: DataFrame, assets: DataFrame) -> DataFrame:
    """One row per checklist item of a leaver: (tenant_id, employee_id, item, is_pending).

    Long form, so a leaver with any number of assets never becomes one big row.
    """
    keys = ["tenant_id", "employee_id"]
    asset_rows = exits.select(*keys).join(
        assets.select(*keys, F.col("asset").alias("item"), (~F.col("returned")).alias("is_pending")), keys
    )
    finance_rows = exits.select(
        *keys,
        F.when(F.col("finance_cleared"), F.lit(refdata.FINANCE_DONE))
        .otherwise(F.lit(refdata.FINANCE_PENDING))
        .alias("item"),
        (~F.col("finance_cleared")).alias("is_pending"),
    )
    return asset_rows.unionByName(finance_rows)


def exit_clearance(exits: DataFrame, assets: DataFrame) -> DataFrame:
    """Clearance verdict per leaver; the items themselves are in :func:`clearance_items`."""
    keys = ["tenant_id", "employee_id"]
    # combined before the join: one row per leaver reaches the shuffle
    counts = assets.groupBy(*keys).agg(
        F.count_if(~F.col("returned")).alias("_open"), F.count_if(F.col("returned")).alias("_back")
    )
    finance = F.coalesce(F.col("finance_cleared"), F.lit(True))
    joined = exits.join(counts, keys, "left").withColumns(
        {
            "pending_count": F.coalesce("_open", F.lit(0)) + F.when(finance, 0).otherwise(1),
            "completed_count": F.coalesce("_back", F.lit(0)) + F.when(finance, 1).otherwise(0),
        }
    )
    employee = F.col("employee_id").cast("string")
    letter = F.concat(
        F.lit("EXPERIENCE & RELIEVING CERTIFICATE\n\nTo Whom It May Concern,\n\nThis is to certify that "),
        F.col("employee_name"), F.lit(" (Employee ID: "), employee, F.lit(") was employed with us in the "),
        F.col("department"),
        F.lit(
            " department. All organizational dues and property have been satisfactorily cleared. "
            "We wish them success in their future endeavors.\n\nAuthorized Signatory, HR Operations."
        ),
    )
    first, *others = refdata.EXIT_REVOCATIONS
    head, tail = first.split("{employee}")
    plan = F.array(F.concat(F.lit(head), employee, F.lit(tail)), *[F.lit(o) for o in others])
    return joined.withColumns(
        {
            "is_fully_cleared": F.col("pending_count") == 0,
            "access_revocation_plan": plan,
            "relieving_letter_draft": F.when(F.col("pending_count") == 0, letter),
        }
    ).drop("_open", "_back")
