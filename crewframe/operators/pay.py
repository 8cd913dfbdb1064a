"""Salary structures, end-of-service pay and gratuity, exact to the cent.

Every function adds columns in one projection chain: no shuffle, no join, whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewframe import refdata
from crewframe.functions.money import TENURE, at_least, at_most, dec, half_up, money, percent_of, plain, thousands


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _rate(value: float | str | Column) -> Column:
    column = value if isinstance(value, Column) else F.lit(str(value))
    return F.round(column.cast("decimal(12,6)"), 2).cast("decimal(5,2)")


def india_salary(
    df: DataFrame,
    annual_ctc: str | Column = "annual_ctc",
    basic_pct: float | Column = 40,
    hra_pct: float | Column = 20,
    cap_pf: bool | Column = False,
    professional_tax: float | Column = 200,
) -> DataFrame:

# The formula texts and citations below must read exactly so.
    """Monthly Indian salary structure from an annual cost to company."""
    capped = cap_pf if isinstance(cap_pf, Column) else F.lit(cap_pf)
    tax = professional_tax if isinstance(professional_tax, Column) else F.lit(str(professional_tax))
    ceiling = dec("15000.00")
    month, basic, hra = F.col("monthly_ctc"), F.col("basic_salary"), F.col("hra")
    gross = F.col("gross_salary")
    return (
        df.withColumn("annual_ctc", money(annual_ctc))
        .withColumn("monthly_ctc", half_up(F.col("annual_ctc") / F.lit(12)))
        .withColumns({"basic_salary": percent_of(month, _rate(basic_pct)), "hra": percent_of(month, _rate(hra_pct))})
        .withColumn("_pf_base", F.when(capped, at_most(basic, ceiling)).otherwise(basic))
        .withColumns(
            {
                "employee_pf": percent_of(F.col("_pf_base"), "12.00"),
                "employer_pf_total": percent_of(F.col("_pf_base"), "12.00"),
                "employer_eps": at_most(percent_of(at_most(F.col("_pf_base"), ceiling), "8.33"), dec("1250.00")),
                "gratuity_monthly_provision": half_up(basic * F.lit(15) / F.lit(312)),
            }
        )
        .withColumns(
            {
                "employer_epf": half_up(F.col("employer_pf_total") - F.col("employer_eps")),
                "_gross": half_up(month - F.col("employer_pf_total") - F.col("gratuity_monthly_provision")),
            }
        )
        .withColumn("_special", half_up(F.col("_gross") - basic - hra))
        .withColumns(
            {
                "special_allowance": at_least(F.col("_special"), dec("0.00")),
                "gross_salary": F.when(F.col("_special") < 0, half_up(basic + hra)).otherwise(F.col("_gross")),
            }
        )
        .withColumns(
            {
                "employee_esi": F.when(gross <= 21000, percent_of(gross, "0.75")).otherwise(dec("0.00")),
                "employer_esi": F.when(gross <= 21000, percent_of(gross, "3.25")).otherwise(dec("0.00")),
                "professional_tax": money(tax),
            }
        )
        .withColumn(
            "net_take_home",
            half_up(gross - F.col("employee_pf") - F.col("employee_esi") - F.col("professional_tax")),
        )
        .withColumn("statutory_citations", _texts(refdata.INDIA_PAY_CITATIONS))
        .drop("_pf_base", "_gross", "_special")
    )


def uae_salary(
    df: DataFrame,
    monthly_gross: str | Column = "monthly_gross",
    basic_pct: float | Column = 60,
    housing_pct: float | Column = 30,
    transport_pct: float | Column = 10,
) -> DataFrame:
    """Monthly Emirati salary split and the end-of-service accrual."""
    gross, basic = F.col("monthly_gross"), F.col("basic_wage")
    return (
        df.withColumn("monthly_gross", money(monthly_gross))
        .withColumns(
            {
                "basic_wage": percent_of(gross, _rate(basic_pct)),
                "housing_allowance": percent_of(gross, _rate(housing_pct)),
                "transport_allowance": percent_of(gross, _rate(transport_pct)),
            }
        )
        .withColumns(
            {
                "other_allowances": at_least(
                    half_up(gross - basic - F.col("housing_allowance") - F.col("transport_allowance")), dec("0.00")
                ),
                "wps_compliant": F.lit(True),
                "_daily_basic": half_up(basic / F.lit(30)),
            }
        )
        .withColumn("estimated_monthly_eosb_accrual", half_up(F.col("_daily_basic") * F.lit(21) / F.lit(12)))
        .withColumn("statutory_citations", _texts(refdata.UAE_PAY_CITATIONS))
        .drop("_daily_basic")
    )


def uae_eosb_amount(basic: Column, years: Column) -> Column:
    """End-of-service amount: 21 days a year for five years, then a month a year, at most 24 months."""
    first = half_up(basic * F.lit(21) * at_most(years, F.lit(5).cast(TENURE)) / F.lit(30))
    later = half_up(basic * (years - F.lit(5)))
    owed = F.when(years < 1, dec("0.00")).when(years <= 5, first).otherwise(half_up(first + later))
    return at_most(owed, half_up(basic * F.lit(24)))


def india_gratuity_amount(basic: Column, years: Column) -> Column:
    """15/26 of a month per year of service from five years on, at most two million."""
    owed = half_up(F.lit(15) * basic * years / F.lit(26))
    return F.when(years < 5, dec("0.00")).otherwise(at_most(owed, dec("2000000.00")))


def uae_eosb(df: DataFrame, basic: str = "basic_wage_monthly", years: str = "tenure_years") -> DataFrame:
    """End-of-service gratuity with the worked formula and its citation."""
    wage, tenure = F.col(basic), F.col(years)
    first = half_up(wage * F.lit(21) * F.lit(5) / F.lit(30))
    later = half_up(wage * (tenure - F.lit(5)))
    upto5 = half_up(wage * F.lit(21) * tenure / F.lit(30))
    cap = half_up(wage * F.lit(24))
    uncapped = F.when(tenure < 1, dec("0.00")).when(tenure <= 5, upto5).otherwise(half_up(first + later))
    text = (
        F.when(tenure < 1, F.lit("Service tenure less than 1 year. No statutory gratuity entitled."))
        .when(
            tenure <= 5,
            F.concat(
                F.lit("Tenure: "), plain(tenure), F.lit(" yrs. Calculation: ("), plain(wage), F.lit(" * 21 * "),
                plain(tenure), F.lit(") / 30 = AED "), plain(upto5),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("First 5 yrs (21 days/yr): AED "), plain(first), F.lit(" + Next "),
                plain(tenure - F.lit(5)), F.lit(" yrs (30 days/yr): AED "), plain(later),
                F.lit(" = Total AED "), plain(first + later),
            )
        )
    )
    capped = F.when(
        uncapped > cap,
        F.concat(F.lit(" (Capped at 2 years' basic wage statutory limit of AED "), plain(cap), F.lit(")")),
    ).otherwise(F.lit(""))
    return (
        df.withColumns({basic: money(basic), years: F.col(years).try_cast(TENURE)})
        .withColumns(
            {
                "total_eosb_gratuity": uae_eosb_amount(wage, tenure),
                "formula_breakdown": F.concat(text, capped),
                "statutory_citation": F.lit(refdata.UAE_EOSB_CITATION),
            }
        )
    )


def india_gratuity(df: DataFrame, basic: str = "last_drawn_basic", years: str = "tenure_years") -> DataFrame:
    """Gratuity with the worked formula and its citation."""
    wage, tenure = F.col(basic), F.col(years)
    uncapped = half_up(F.lit(15) * wage * tenure / F.lit(26))
    ceiling = dec("2000000.00")
    text = F.when(
        tenure < 5, F.lit("Service tenure less than 5 years. No statutory gratuity entitled.")
    ).otherwise(
        F.concat(
            F.lit("Tenure: "), plain(tenure), F.lit(" yrs. Calculation: (15 * "), plain(wage), F.lit(" * "),
            plain(tenure), F.lit(") / 26 = INR "), plain(uncapped),
            F.when(
                uncapped > ceiling,
                F.concat(F.lit(" (Capped at statutory ceiling of INR "), thousands(ceiling), F.lit(")")),
            ).otherwise(F.lit("")),
        )
    )
    return (
        df.withColumns({basic: money(basic), years: F.col(years).try_cast(TENURE)})
        .withColumns(
            {
                "gratuity_amount": india_gratuity_amount(wage, tenure),
                "formula_breakdown": text,
                "statutory_citation": F.lit(refdata.INDIA_GRATUITY_CITATION),
            }
        )
    )


def salary_by_jurisdiction(
    df: DataFrame, amount: str = "amount", period: str = "amount_period", jurisdiction: str = "jurisdiction"
) -> DataFrame:
    """Route each row to its jurisdiction's structure; ``period`` says ANNUAL or MONTHLY.

    Emirati rows fill ``uae``, all others ``india``; the other struct stays null.
    """
    keep = df.columns
    is_uae = F.col(jurisdiction) == "AE"
    annual = F.upper(F.col(period)) == "ANNUAL"
    base = money(amount)
    both = df.withColumns(
        {
            "_ctc": F.when(annual, base).otherwise(half_up(base * F.lit(12))),
            "_monthly": F.when(annual, half_up(base / F.lit(12))).otherwise(base),
        }
    )
    india_fields = [
        "annual_ctc", "monthly_ctc", "basic_salary", "hra", "special_allowance", "gross_salary", "employee_pf",
        "employer_epf", "employer_eps", "employer_pf_total", "employee_esi", "employer_esi", "professional_tax",
        "gratuity_monthly_provision", "net_take_home", "statutory_citations",
    ]
    uae_fields = [
        "monthly_gross", "basic_wage", "housing_allowance", "transport_allowance", "other_allowances",
        "wps_compliant", "estimated_monthly_eosb_accrual", "statutory_citations",
    ]
    with_india = india_salary(both, "_ctc").select(
        *keep, "_monthly", F.when(~is_uae, F.struct(*india_fields)).alias("india")
    )
    return uae_salary(with_india, "_monthly").select(
        *keep, "india", F.when(is_uae, F.struct(*uae_fields)).alias("uae")
    )
