"""Canonical tables: column, type and default per entity."""

from __future__ import annotations

MONEY = "decimal(18,2)"
AMOUNT = "decimal(10,4)"

# Canonical columns in order as name, type and default.
CANONICAL = {
    "CANDIDATE": [
        ("full_name", "string", None), ("email", "string", None), ("phone", "string", None),
        ("resume_text", "string", None), ("resume_uri", "string", None), ("skills", "array<string>", None),
        ("years_experience", AMOUNT, None), ("current_title", "string", None), ("education", "array<string>", None),
        ("stage", "string", None), ("requisition_external_id", "string", None), ("applied_at", "timestamp", None),
    ],
    "REQUISITION": [
        ("title", "string", None), ("department", "string", None), ("location", "string", None),
        ("headcount", "int", "1"), ("status", "string", None), ("description", "string", None),
        ("must_have_skills", "array<string>", None), ("nice_to_have_skills", "array<string>", None),
        ("min_years_experience", AMOUNT, None), ("max_years_experience", AMOUNT, None),
        ("hiring_manager_ref", "string", None),
    ],
    "EMPLOYEE": [
        ("full_name", "string", None), ("first_name", "string", None), ("last_name", "string", None),
        ("work_email", "string", None), ("personal_email", "string", None), ("phone", "string", None),
        ("joining_date", "date", None), ("department", "string", None), ("designation", "string", None),
        ("employment_status", "string", None), ("manager_ref", "string", None), ("salary", MONEY, None),
        ("currency", "string", "USD"),
    ],
    "LEAVE_REQUEST": [
        ("employee_ref", "string", None), ("leave_type", "string", None), ("start_date", "date", None),
        ("end_date", "date", None), ("total_days", AMOUNT, None), ("reason", "string", None),
        ("status", "string", "PENDING"), ("approved_by", "string", None),
    ],
    "LEAVE_BALANCE": [
        ("employee_ref", "string", None), ("leave_type", "string", None), ("allocated_days", AMOUNT, None),
        ("used_days", AMOUNT, None), ("remaining_days", AMOUNT, None), ("fiscal_year", "string", None),
    ],
    "PUNCH": [
        ("employee_ref", "string", None), ("punch_time", "timestamp", None), ("punch_type", "string", "IN"),
        ("device_id", "string", None), ("location", "string", None), ("latitude", "double", None),
        ("longitude", "double", None),
    ],
    "ASSET": [
        ("asset_tag", "string", None), ("asset_type", "string", "LAPTOP"), ("model", "string", None),
        ("serial_number", "string", None), ("assigned_to", "string", None), ("status", "string", "IN_USE"),
        ("issued_on", "date", None),
    ],
    "PAYSLIP": [
        ("employee_ref", "string", None), ("month", "int", None), ("year", "int", None),
        ("basic_salary", MONEY, None), ("gross_salary", MONEY, None), ("net_pay", MONEY, None),
        ("total_deductions", MONEY, "0.00"), ("total_allowances", MONEY, "0.00"), ("currency", "string", "USD"),
        ("payslip_url", "string", None), ("status", "string", "PAID"),
    ],
    "EXPENSE_CLAIM": [
        ("employee_ref", "string", None), ("claim_type", "string", None), ("amount", MONEY, None),
        ("currency", "string", "USD"), ("claim_date", "date", None), ("description", "string", None),
        ("receipt_urls", "array<string>", None), ("status", "string", "PENDING"), ("approved_by", "string", None),
    ],
    "ATTENDANCE_REQUEST": [
        ("employee_ref", "string", None), ("request_date", "date", None), ("reason", "string", None),
        ("status", "string", "PENDING"), ("approved_by", "string", None),
    ],
}

# A mapping target whose canonical column has another name.
TARGET_COLUMN = {("EMPLOYEE", "status"): "employment_status"}
