"""Offers, identity documents, joiner tasks, biased wording, candidate scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewframe import refdata
from crewframe.functions.money import money, thousands
from crewframe.operators.findings import text

# The texts of letters, checks and score explanations below must read exactly so.


# ------------------------------------------------------------------------------- offers
def offers_with_bands(offers: DataFrame, bands: DataFrame) -> DataFrame:
    """Bring band_min and band_max of (tenant_id, job_title).  Spark broadcasts the bands only
    while their measured size is under its threshold."""
    return offers.join(
        bands.select("tenant_id", "job_title", "band_min", "band_max"), ["tenant_id", "job_title"], "left"
    )


def evaluate_offers(df: DataFrame) -> DataFrame:
    """Check annual_salary against band and wage floor and draft the letter."""
    salary = F.col("annual_salary")
    low, high = F.col("band_min"), F.col("band_max")
    above = F.coalesce((high != 0) & (salary > high), F.lit(False))
    below = F.coalesce(~above & (low != 0) & (salary < low), F.lit(False))
    floor = (F.col("jurisdiction") == "AE") & (salary < 60000)
    cur = F.col("currency")
    return (
        df.withColumns({c: money(c) for c in ("annual_salary", "band_min", "band_max")})
        .withColumns(
            {
                "status": F.when(floor, F.lit("BELOW_MINIMUM_WAGE"))
                .when(above | below, F.lit("BAND_VIOLATION"))
                .otherwise(F.lit("DRAFTED")),
                "within_band": ~(above | below),
                "requires_executive_approval": above,
                "explanation": F.when(
                    floor, text("Salary of AED ", thousands(salary), "/yr is below recommended statutory baseline.")
                )
                .when(
                    above,
                    text(
                        "Proposed salary of ", cur, " ", thousands(salary), " exceeds department band ceiling of ",
                        cur, " ", thousands(high), " by ", cur, " ", thousands(salary - high),
                        ". Executive approval required.",
                    ),
                )
                .when(
                    below,
                    text(
                        "Proposed salary of ", cur, " ", thousands(salary), " falls below department band minimum of ",
                        cur, " ", thousands(low), ".",
                    ),
                )
                .otherwise(text("Offer of ", cur, " ", thousands(salary), " is compliant with standard salary bands.")),
                "statutory_citation": F.when(floor, F.lit(refdata.OFFER_CITATIONS["AE"])).when(
                    F.col("jurisdiction") == "IN", F.lit(refdata.OFFER_CITATIONS["IN"])
                ),
                "draft_letter": text(
                    "OFFER OF EMPLOYMENT\n\nDear ", F.col("candidate_name"),
                    ",\n\nWe are pleased to offer you the position of ", F.col("job_title"), ".\nCompensation: ",
                    cur, " ", thousands(salary),
                    " per annum.\nSubject to background verification and statutory document verification.\n\n"
                    "Status: PROPOSED DRAFT (Requires HR Director sign-off).",
                ),
            }
        )
    )


# ---------------------------------------------------------------------------- documents
# Document keys the checks read.
DOCUMENT_KEYS = ["pan", "aadhaar", "bank_account", "ifsc", "emirates_id", "passport", "iloe_certificate"]


def verify_documents(documents: DataFrame) -> DataFrame:
    """Identity document checklist per candidate from rows (candidate_id, jurisdiction, doc_key, doc_value).

    Only the seven known keys are read, each by a combining ``max``: a candidate with any
    number of rows stays one small aggregation buffer.
    """
    value = F.coalesce(F.col("doc_value"), F.lit(""))
    wide = documents.groupBy("candidate_id", "jurisdiction").agg(
        *[F.max(F.when(F.col("doc_key") == key, value)).alias(key) for key in DOCUMENT_KEYS]
    )

    def check(label: str, column: str, valid: Column | None, reason: str = "") -> tuple[Column, Column, Column]:
        missing = F.coalesce(F.col(column) == "", F.lit(True))
        bad = F.lit(False) if valid is None else ~missing & ~valid
        return (
            F.when(~missing & ~bad, F.lit(label)),
            F.when(missing, F.lit(label)),
            F.when(bad, F.struct(F.lit(label).alias("document"), F.lit(reason).alias("reason"))),
        )

    eid = F.col("emirates_id")
    no_bad = F.lit(None).cast("struct<document:string,reason:string>")
    bank_given = F.col("bank_account").isNotNull() & F.col("ifsc").isNotNull()
    india = [
        check(
            "PAN Card", "pan", F.upper(F.trim("pan")).rlike("^[A-Z]{5}[0-9]{4}[A-Z]$"),
            "Invalid format (expected 5 letters, 4 digits, 1 letter)",
        ),
        check(
            "Aadhaar Card", "aadhaar", F.regexp_replace("aadhaar", r"(?U)[\s-]", "").rlike(r"(?U)^\d{12}$"),
            "Aadhaar must contain exactly 12 digits",
        ),
        (
            F.when(bank_given, F.lit("Bank Account & IFSC")),
            F.when(~bank_given, F.lit("Bank Account Details with IFSC")),
            no_bad,
        ),
    ]
    uae = [
        check(
            "Emirates ID", "emirates_id",
            F.trim(eid).rlike(r"(?U)^784-\d{4}-\d{7}-\d{1}$")
            | F.regexp_replace(eid, "-", "").rlike(r"(?U)^784\d{12}$"),
            "Invalid Emirates ID format (expected 784-YYYY-XXXXXXX-Z)",
        ),
        check("Passport Copy", "passport", None),
        check("ILOE Unemployment Insurance Certificate", "iloe_certificate", None),
    ]

    def gather(part: int, empty: str) -> Column:
        rows = lambda checks: F.array_compact(F.array(*[c[part] for c in checks]))
        return (
            F.when(F.col("jurisdiction") == "IN", rows(india))
            .when(F.col("jurisdiction") == "AE", rows(uae))
            .otherwise(F.array().cast(empty))
        )

    invalid_type = "array<struct<document:string,reason:string>>"
    citations = F.array().cast("array<string>")
    for jurisdiction, texts in refdata.DOCUMENT_CITATIONS.items():
        citations = F.when(F.col("jurisdiction") == jurisdiction, F.array(*[F.lit(t) for t in texts])).otherwise(
            citations
        )
    complete = (F.size("missing_documents") == 0) & (F.size("invalid_documents") == 0)
    return (
        wide.withColumns(
            {
                "verified_documents": gather(0, "array<string>"),
                "missing_documents": gather(1, "array<string>"),
                "invalid_documents": gather(2, invalid_type),
                "statutory_citations": citations,
            }
        )
        .withColumns(
            {
                "is_complete": complete,
                "status": F.when(complete, F.lit("VERIFIED"))
                .when(F.size("invalid_documents") > 0, F.lit("INVALID_FORMAT"))
                .otherwise(F.lit("MISSING_DOCUMENTS")),
            }
        )
        .select(
            "candidate_id", "jurisdiction", "status", "is_complete", "verified_documents", "missing_documents",
            "invalid_documents", "statutory_citations",
        )
    )


# ------------------------------------------------------------------------------ joiners
def provisioning_tasks(joiners: DataFrame) -> DataFrame:
    """One row per asset, account and first-day slot of a joiner, from a constant template."""
    role = F.lower(F.col("role"))
    engineer = role.contains("engineer") | role.contains("developer")
    login = F.lower(F.col("employee_id").cast("string"))
    buddy = F.when(F.col("buddy_name") != "", F.col("buddy_name"))

    def row(kind: str, item: Column, slot: str | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(slot).cast("string").alias("slot"), item.alias("item"))

    def fill(template: str, name: str, value: Column) -> Column:
        if "{" + name + "}" not in template:
            return F.lit(template)
        head, tail = template.split("{" + name + "}")
        return F.concat(F.lit(head), value, F.lit(tail))

    lunch = F.coalesce(buddy, F.lit("Team Lead"))
    rows = (
        [row("ASSET", F.lit(a)) for a in refdata.JOINER_ASSETS]
        + [F.when(engineer, row("ASSET", F.lit(refdata.JOINER_ENGINEER_ASSET)))]
        + [row("ACCOUNT", fill(a, "employee", login)) for a in refdata.JOINER_ACCOUNTS]
        + [row("SCHEDULE", fill(a, "buddy", lunch), at) for at, a in refdata.JOINER_SCHEDULE]
        + [row("BUDDY", F.coalesce(buddy, F.lit("Assigned Senior Peer")))]
    )
    return joiners.select("tenant_id", "employee_id", F.inline(F.array_compact(F.array(*rows))))


# --------------------------------------------------------------------------------- bias
def audit_bias(df: DataFrame, column: str = "jd_text") -> DataFrame:
    """Biased terms found in a text and the text with each replaced by ``[replacement]``."""
    body = F.col(column)
    flags, better = {}, {}
    for n, (term, replacement) in enumerate(refdata.BIAS_TERMS):
        # the plain substring test spares the pattern on texts without the word
        flags[f"_b{n}"] = F.contains(F.col("_lowered"), F.lit(term)) & body.rlike(rf"(?iU)\b{term}\b")
        better[f"_b{n}"] = (term, replacement)

    def replace_in(name: str):
        term, replacement = better[name]
        return lambda one: F.when(F.col(name), F.regexp_replace(one, rf"(?iU)\b{term}\b", f"[{replacement}]")).otherwise(one)

    rewritten = body
    for name in flags:  # no replacement holds another term, so the flags of the first text stay true
        rewritten = F.get(F.transform(F.array(rewritten), replace_in(name)), F.lit(0))
    hits = [
        F.when(F.col(name), F.struct(F.lit(t).alias("flagged_term"), F.lit(r).alias("replacement_recommendation")))
        for name, (t, r) in better.items()
    ]
    return (
        df.withColumn("_lowered", F.lower(body))
        .withColumns(flags)
        .withColumns({"detected_terms": F.array_compact(F.array(*hits))})
        .withColumn("has_bias", F.size("detected_terms") > 0)
        .withColumn("suggested_rewrite", F.when(F.col("has_bias"), rewritten).otherwise(body))
        .drop("_lowered", *flags)
    )


# ------------------------------------------------------------------------------- scores
def candidates_with_requisition(candidates: DataFrame, requisitions: DataFrame) -> DataFrame:
    """Bring required skills and years; a requisition with very many candidates is an adaptive
    skew split, because nothing after the join needs its partitioning.  An application without a known
    opening stays, with nothing required."""
    return candidates.join(
        requisitions.select("tenant_id", "requisition_id", "required_skills", "required_years"),
        ["tenant_id", "requisition_id"],
        "left",
    )


def score_candidates(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted skills, experience and education score of resume_text."""
    weights = {**refdata.SCORE_WEIGHTS, **(weights or {})}
    wanted = F.coalesce(F.col("required_skills"), F.array().cast("array<string>"))
    matched, total = F.size("matched_skills"), F.size(wanted)
    years, needed = F.col("candidate_years"), F.col("required_years")
    composite = (
        F.col("_skills") * weights["skills"]
        + F.col("_experience") * weights["experience"]
        + F.col("_education") * weights["education"]
    )
    one = lambda c: F.format_string("%.1f", c)

    def looked_up(resume: Column) -> Column:
        """Everything that is read from a resume, in one pass over the wanted skills."""
        degree = F.lit(False)
        for word in refdata.DEGREE_WORDS:
            degree = degree | F.contains(resume, F.lit(word))
        # each skill once, however often the opening names it
        held = F.filter(F.array_distinct(F.transform(wanted, F.lower)), lambda skill: F.contains(resume, skill))
        return F.struct(held.alias("held"), degree.alias("degree"))

    # bound to lambda variables: the text is lower-cased once and every skill is looked up once, wherever filters move
    bound = F.transform(F.array(F.lower(F.coalesce(F.col("resume_text"), F.lit("")))), looked_up)
    listed = F.transform(
        bound,
        lambda found: F.struct(
            F.filter(wanted, lambda skill: F.array_contains(found["held"], F.lower(skill))).alias("matched"),
            F.filter(wanted, lambda skill: ~F.array_contains(found["held"], F.lower(skill))).alias("missing"),
            found["degree"].alias("degree"),
        ),
    )
    degree = F.col("_found.degree")
    return (
        df.withColumn("_found", F.get(listed, F.lit(0)))
        .withColumns({"matched_skills": F.col("_found.matched"), "missing_skills": F.col("_found.missing")})
        .withColumns(
            {
                "_skills": F.when(total > 0, matched / total * 100.0).otherwise(F.lit(100.0)),
                "_experience": F.when(F.coalesce(needed <= 0, F.lit(True)), F.lit(100.0)).otherwise(
                    F.least(F.lit(100.0), F.coalesce(years, F.lit(0.0)) / needed * 100.0)
                ),
                "_education": F.when(degree, F.lit(90.0)).otherwise(F.lit(70.0)),
            }
        )
        .withColumns(
            {
                "skills_score": F.round("_skills", 2),
                "experience_score": F.round("_experience", 2),
                "education_score": F.col("_education"),
                "composite_score": F.round(composite, 2),
            }
        )
        .withColumns(
            {
                "recommendation": F.when(F.col("composite_score") >= 75, F.lit("SHORTLIST"))
                .when(F.col("composite_score") >= 55, F.lit("REVIEW_BAND"))
                .otherwise(F.lit("REJECT")),
                "explanation": text(
                    "Candidate scored ", one(F.col("composite_score")), "/100. Skills match: ", matched, "/", total,
                    " (", one(F.col("_skills")), "%). Experience: ", years, " yrs vs ", needed, " yrs required (",
                    one(F.col("_experience")), "%).",
                ),
            }
        )
        .drop("_found", "_skills", "_experience", "_education")
    )
