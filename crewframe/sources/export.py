"""Canonical rows in the shape a vendor's API expects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewframe import refdata

# Vendor field names, constants and default texts below must read exactly so.

UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def title_case(text: Column) -> Column:
    """Every letter after a non-letter is upper case, all others lower case."""
    return F.array_join(F.transform(F.split(F.lower(text), r"(?<=[^a-z])"), lambda part: F.initcap(part)), "")


def first_word(name: Column) -> Column:
    word = F.regexp_extract(name, r"^\s*(\S+)", 1)
    return F.when(word != "", word)


def other_words(name: Column) -> Column:
    rest = F.regexp_extract(name, r"(?s)^\s*\S+\s+(.*)$", 1)
    return F.when(rest != "", rest)


def _has(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _filled(df: DataFrame, *names: str) -> Column:
    """First of several columns that is neither null nor empty nor zero, as text."""
    values = [_has(df, n).cast("string") for n in names]
    return F.coalesce(*[F.when(~v.isin("", "0", "0.0", "0.00"), v) for v in values])


def _frappe(df: DataFrame, entity: str, company: str) -> dict[str, Column]:
    if entity == "EMPLOYEE":
        name, first = _has(df, "full_name"), _has(df, "first_name")
        return {
            "first_name": F.coalesce(first, first_word(name)),
            "last_name": F.when(first.isNull(), F.coalesce(other_words(name), _has(df, "last_name"))).otherwise(
                _has(df, "last_name")
            ),
            "company": F.coalesce(_has(df, "company"), F.lit(company)),
        }
    if entity == "LEAVE_REQUEST":
        out = {"leave_type": title_case(_has(df, "leave_type"))}
        out |= {c: F.col(c).cast("string") for c in ("from_date", "to_date") if c in df.columns}
        return out
    if entity == "REQUISITION":
        return {
            "designation": F.coalesce(_has(df, "designation"), _has(df, "title")),
            "company": F.coalesce(_has(df, "company"), F.lit(company)),
        }
    return {}


def _bamboohr(df: DataFrame, entity: str) -> dict[str, Column]:
    if entity == "EMPLOYEE":
        name, given = _has(df, "full_name"), _has(df, "firstName")
        split_here = name.isNotNull() & given.isNull()
        return {
            "firstName": F.when(split_here, first_word(name)).otherwise(given),
            "lastName": F.when(split_here, F.coalesce(other_words(name), F.lit(""))).otherwise(_has(df, "lastName")),
        }
    if entity == "LEAVE_REQUEST":
        return {
            "start": F.coalesce(_has(df, "start"), _has(df, "start_date").cast("string")),
            "end": F.coalesce(_has(df, "end"), _has(df, "end_date").cast("string")),
        }
    return {}


def _zoho(df: DataFrame, entity: str, department: str) -> dict[str, Column]:
    if entity == "EMPLOYEE":
        name = _has(df, "full_name")
        return {
            "FirstName": F.coalesce(_has(df, "first_name"), first_word(name)),
            "LastName": F.coalesce(_has(df, "last_name"), other_words(name), first_word(name)),
            "EmailID": _has(df, "work_email"),
            "Mobile": _has(df, "phone"),
            "Department": F.coalesce(_has(df, "department"), F.lit(department)),
            "Designation": _has(df, "designation"),
            "Dateofjoining": _has(df, "joining_date").cast("string"),
        }
    if entity == "LEAVE_REQUEST":
        return {
            "LeaveType": title_case(_has(df, "leave_type")),
            "From": _has(df, "start_date").cast("string"),
            "To": _has(df, "end_date").cast("string"),
            "Reasonforleave": _has(df, "reason"),
            "Employee_ID": _has(df, "employee_ref"),
        }
    if entity == "REQUISITION":
        return {
            "JobTitle": _has(df, "title"),
            "Department": F.coalesce(_has(df, "department"), F.lit(department)),
            "JobDescription": _has(df, "description"),
        }
    if entity == "PUNCH":
        return {"empId": _has(df, "employee_ref"), "punchTime": _has(df, "punch_time").cast("string")}
    return {}


def _labelled(value: Column, table: dict[str, str], default: str) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, F.lower(value)), F.lit(default))


def _iceipts_requisition(df: DataFrame, user: str) -> dict[str, Column]:
    owner = F.coalesce(_filled(df, "recruiter_id", "hiring_manager_id"), F.lit(user))
    title = F.coalesce(_filled(df, "title"), F.lit("Unspecified Role"))
    department = F.coalesce(_filled(df, "department"), F.lit("Engineering"))
    low, high = _filled(df, "min_salary", "salary_min"), _filled(df, "max_salary", "salary_max")
    lists = [
        F.when(F.size(F.col(c)) > 0, F.col(c)) for c in ("skills", "required_skills") if c in df.columns
    ]
    skills = F.coalesce(*lists, F.array().cast("array<string>")) if lists else F.array().cast("array<string>")
    benefits = (
        F.coalesce(F.col("benefits"), F.array().cast("array<string>"))
        if "benefits" in df.columns
        else F.array().cast("array<string>")
    )
    skill_text = F.array_join(F.filter(skills, lambda s: s != ""), ", ")
    about = F.coalesce(
        _filled(df, "description", "job_description"), F.concat(title, F.lit(" role in "), department, F.lit("."))
    )
    whole = lambda v: F.coalesce(v.try_cast("decimal(28,4)").try_cast("bigint"), F.lit(0))
    openings = F.coalesce(_filled(df, "headcount", "position"), F.lit("1"))
    department_id = _has(df, "department_id").cast("string")
    job = F.struct(
        owner.alias("employeeId"),
        title.alias("title"),
        department.alias("department"),
        F.coalesce(_filled(df, "location"), F.lit("Remote")).alias("location"),
        _labelled(
            F.coalesce(_filled(df, "employment_type"), F.lit("full_time")), refdata.EMPLOYMENT_TYPES, "Full-time"
        ).alias("type"),
        _labelled(
            F.coalesce(_filled(df, "work_model", "job_mode"), F.lit("remote")), refdata.JOB_MODES, "WorkFromHome"
        ).alias("jobMode"),
        F.lit("Morning").alias("shifts"),
        about.alias("description"),
        F.lit("Any").alias("education"),
        F.when(low.isNull() & high.isNull(), F.lit("Negotiable"))
        .otherwise(F.concat(F.coalesce(low, F.lit("0")), F.lit("-"), F.coalesce(high, F.lit("0")), F.lit(" LPA")))
        .alias("salary"),
        whole(low).alias("minSalary"),
        whole(high).alias("maxSalary"),
        F.coalesce(F.when(openings.rlike(r"^\s*[+-]?\d+\s*$"), openings.try_cast("bigint")), F.lit(1)).alias("position"),
        F.lit(70).alias("minthreshold"),
        F.lit(85).alias("matchthreshold"),
        about.alias("jobDescription"),
        F.coalesce(
            _filled(df, "requirements"), F.when(skill_text != "", skill_text),
            F.lit("To be discussed during screening."),
        ).alias("requirements"),
        F.coalesce(_filled(df, "responsibilities"), about).alias("responsibilities"),
        owner.alias("recuiterId"),  # spelled as the host expects it
        owner.alias("managerId"),
        F.when(department_id.rlike(UUID), department_id).alias("departmentId"),
    )
    return {
        "employeeId": owner,
        "jobData": job,
        "skills": F.filter(skills, lambda s: s.rlike(UUID)),
        "benefits": F.filter(benefits, lambda s: s.rlike(UUID)),
    }


def export_vendor_payload(
    df: DataFrame,
    vendor: str,
    entity: str,
    action: str = "create",
    company: str = "Standard Company",
    department: str = "General",
    user: str = "00000000-0000-0000-0000-000000000000",
) -> DataFrame:
    """Add or rename columns as the vendor expects; null columns are left out of the JSON."""
    vendor, entity = refdata.vendor_name(vendor), entity.upper()
    if vendor == "iceipts":
        if entity != "REQUISITION" or action.lower() not in ("create", "post"):
            return df
        shaped = _iceipts_requisition(df, user)
        return df.select(*[value.alias(name) for name, value in shaped.items()])
    if vendor == "frappe":
        return df.withColumns(_frappe(df, entity, company))
    if vendor == "bamboohr":
        return df.withColumns(_bamboohr(df, entity))
    if vendor == "zoho":
        # Spark resolves names case-insensitively: the vendor's spelling replaces the column
        shaped = _zoho(df, entity, department)
        kept = [c for c in df.columns if c.lower() not in {name.lower() for name in shaped}]
        return df.select(*kept, *[value.alias(name) for name, value in shaped.items()])
    return df


def as_json(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rows as JSON text in column ``payload``."""
    keep = keep or []
    return df.select(*keep, F.to_json(F.struct(*[c for c in df.columns if c not in keep])).alias("payload"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)
