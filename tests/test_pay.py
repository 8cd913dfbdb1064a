from decimal import Decimal as D

import pytest

from crewframe.operators import exits, pay


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize("ctc", [1200000, "1200000.00", 1200000.0])
def test_india_salary(spark, ctc):
    row = one(pay.india_salary(spark.createDataFrame([(ctc,)], ["annual_ctc"])))
    expected = {
        "monthly_ctc": "100000.00", "basic_salary": "40000.00", "hra": "20000.00", "employee_pf": "4800.00",
        "employer_eps": "1249.50", "employer_epf": "3550.50", "employer_pf_total": "4800.00",
        "gratuity_monthly_provision": "1923.08", "gross_salary": "93276.92", "special_allowance": "33276.92",
        "net_take_home": "88276.92", "employee_esi": "0.00",
    }
    assert {k: str(row[k]) for k in expected} == expected
    assert len(row["statutory_citations"]) == 3


def test_india_salary_with_esi_and_floor(spark):
    row = one(pay.india_salary(spark.createDataFrame([(240000,)], ["annual_ctc"]), basic_pct=50, hra_pct=25))
    assert row["gross_salary"] <= 21000
    assert row["employee_esi"] == round(row["gross_salary"] * D("0.0075"), 2)
    # shares that add up to more than the gross: special allowance is zero and gross is raised
    row = one(pay.india_salary(spark.createDataFrame([(240000,)], ["annual_ctc"]), basic_pct=70, hra_pct=35))
    assert row["special_allowance"] == 0
    assert row["gross_salary"] == row["basic_salary"] + row["hra"]


def test_capped_pf_and_nulls(spark):
    df = spark.createDataFrame([(1200000,), (None,)], "annual_ctc long")
    rows = pay.india_salary(df, cap_pf=True).collect()
    assert str(rows[0]["employee_pf"]) == "1800.00"
    assert str(rows[0]["employer_eps"]) == "1249.50"
    assert rows[1]["net_take_home"] is None and rows[1]["special_allowance"] is None
    assert rows[1]["employer_eps"] is None


def test_uae_salary(spark):
    row = one(pay.uae_salary(spark.createDataFrame([(25000,)], ["monthly_gross"])))
    assert [str(row[k]) for k in ("basic_wage", "housing_allowance", "transport_allowance", "other_allowances")] == [
        "15000.00", "7500.00", "2500.00", "0.00",
    ]
    assert str(row["estimated_monthly_eosb_accrual"]) == "875.00"
    assert row["wps_compliant"] and len(row["statutory_citations"]) == 3


def test_uae_eosb(spark):
    cases = [(12000, 0.8, 0), (12000, 3.0, 25200), (12000, 5.0, 42000), (12000, 7.0, 66000), (12000, 30.0, 288000)]
    df = spark.createDataFrame([c[:2] for c in cases], ["basic_wage_monthly", "tenure_years"])
    rows = {float(r["tenure_years"]): r for r in pay.uae_eosb(df).collect()}
    for _, years, expected in cases:
        assert rows[years]["total_eosb_gratuity"] == expected
    assert "Capped at 2 years" in rows[30.0]["formula_breakdown"]
    assert rows[3.0]["formula_breakdown"] == "Tenure: 3.00 yrs. Calculation: (12000.00 * 21 * 3.00) / 30 = AED 25200.00"
    assert "Article 51" in rows[3.0]["statutory_citation"]


def test_india_gratuity(spark):
    df = spark.createDataFrame([(50000, 6.0), (50000, 4.9), (900000, 10.0)], ["last_drawn_basic", "tenure_years"])
    rows = [(str(r["gratuity_amount"]), r["formula_breakdown"]) for r in pay.india_gratuity(df).collect()]
    assert rows[0][0] == "173076.92"
    assert rows[1] == ("0.00", "Service tenure less than 5 years. No statutory gratuity entitled.")
    assert rows[2][0] == "2000000.00" and rows[2][1].endswith("(Capped at statutory ceiling of INR 2,000,000.00)")


def test_rounding_on_ties(spark):
    # 10.01 * 50 % = 5.005, half up
    df = spark.createDataFrame([(D("120.12"),)], "annual_ctc decimal(18,2)")
    assert str(one(pay.india_salary(df, basic_pct=50))["basic_salary"]) == "5.01"


def test_salary_router(spark):
    df = spark.createDataFrame(
        [("AE", 25000, "MONTHLY"), ("AE", 300000, "ANNUAL"), ("IN", 1200000, "ANNUAL"), ("SA", 100000, "MONTHLY")],
        ["jurisdiction", "amount", "amount_period"],
    )
    rows = pay.salary_by_jurisdiction(df).collect()
    assert [str(r["uae"]["basic_wage"]) for r in rows[:2]] == ["15000.00", "15000.00"]
    assert rows[0]["india"] is None and rows[2]["uae"] is None
    assert [str(r["india"]["net_take_home"]) for r in rows[2:]] == ["88276.92", "88276.92"]


def test_final_settlement(spark):
    df = spark.createDataFrame(
        [
            ("E1", 15000, 25000, 3.0, 10.0, 6, 0, 0, "AE"),
            ("E2", 50000, 100000, 6.0, 15.0, 10, 0, 5, "IN"),
        ],
        "employee_id string, basic_wage_monthly int, gross_wage_monthly int, tenure_years double, "
        "unused_leave_days double, unpaid_work_days int, notice_days_to_pay int, notice_days_to_deduct int, "
        "jurisdiction string",
    )
    uae, india = exits.final_settlement(df).orderBy("employee_id").collect()
    assert str(uae["gratuity_amount"]) == "31500.00"
    assert str(uae["leave_encashment_amount"]) == "5000.00"
    assert str(uae["total_net_payable"]) == "41499.98"
    assert str(india["gratuity_amount"]) == "173076.92"
    assert str(india["deductions_total"]) == "16666.65"
    assert str(india["total_net_payable"]) == "214743.62"
    assert len(uae["statutory_citations"]) == 2 and len(india["statutory_citations"]) == 1


def test_settlement_deadline(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("2026-09-20",), ("2026-09-01",), ("2026-09-12",)], ["last_working_day"])
    rows = exits.settlement_deadline(df, F.lit("2026-09-25").cast("date")).collect()
    assert [(r["days_elapsed"], r["days_remaining"], r["status"]) for r in rows] == [
        (5, 9, "ON_TRACK"), (24, 0, "STATUTORY_BREACH"), (13, 1, "APPROACHING_DEADLINE"),
    ]
    assert rows[0]["penalty_risk"] is None
    assert rows[1]["penalty_risk"].startswith("Settlement is overdue by 10 days.")


def test_exit_clearance(spark):
    people = spark.createDataFrame(
        [("T", "E1", "Ann", "Sales", True), ("T", "E2", "Bob", "IT", True), ("T", "E3", "Cy", "IT", False)],
        "tenant_id string, employee_id string, employee_name string, department string, finance_cleared boolean",
    )
    assets = spark.createDataFrame(
        [("T", "E1", "Laptop", True), ("T", "E2", "Badge", False), ("T", "E2", "Laptop", True)],
        "tenant_id string, employee_id string, asset string, returned boolean",
    )
    rows = {r["employee_id"]: r for r in exits.exit_clearance(people, assets).collect()}
    assert rows["E1"]["is_fully_cleared"]
    assert rows["E1"]["relieving_letter_draft"].startswith("EXPERIENCE & RELIEVING CERTIFICATE")
    assert rows["E1"]["access_revocation_plan"][0] == "Disable Active Directory / Okta SSO Account (E1)"
    assert (rows["E2"]["pending_count"], rows["E2"]["completed_count"]) == (1, 2)
    assert rows["E2"]["relieving_letter_draft"] is None
    assert rows["E3"]["pending_count"] == 1
    items = exits.clearance_items(people, assets).filter("is_pending").collect()
    assert {(r["employee_id"], r["item"]) for r in items} == {
        ("E2", "Badge"), ("E3", "Outstanding corporate expense or travel advance reconciliation"),
    }
