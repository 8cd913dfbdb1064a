import random
import re

import pytest
from pyspark.sql import functions as F

from crewframe import refdata
from crewframe.operators import dedupe, hiring, search, sequences


def test_offers(spark):
    df = spark.createDataFrame(
        [
            (1, "Ann", "Dev", 1800000, "INR", 1400000, 2200000, "IN"),
            (2, "Bob", "Ops", 450000, "AED", 200000, 350000, "AE"),
            (3, "Cy", "Ops", 50000, "AED", 60000, 0, "AE"),
            (4, "Di", "Ops", 10, "USD", 20, None, "US"),
            (5, "Ed", "Ops", 10, "USD", 0, 0, "US"),
        ],
        "id int, candidate_name string, job_title string, annual_salary int, currency string, band_min int, "
        "band_max int, jurisdiction string",
    )
    rows = {r["id"]: r for r in hiring.evaluate_offers(df).collect()}
    assert rows[1]["status"] == "DRAFTED" and "Code on Wages" in rows[1]["statutory_citation"]
    assert "Compensation: INR 1,800,000.00 per annum." in rows[1]["draft_letter"]
    assert rows[2]["status"] == "BAND_VIOLATION" and rows[2]["requires_executive_approval"]
    assert rows[2]["explanation"].endswith("by AED 100,000.00. Executive approval required.")
    assert rows[2]["statutory_citation"] is None
    assert rows[3]["status"] == "BELOW_MINIMUM_WAGE" and not rows[3]["within_band"]
    assert rows[4]["status"] == "BAND_VIOLATION" and not rows[4]["requires_executive_approval"]
    assert rows[5]["status"] == "DRAFTED"


def test_documents(spark):
    rows = [
        ("A", "IN", "pan", " abcde1234f "), ("A", "IN", "aadhaar", "1234 5678 9012"), ("A", "IN", "bank_account", "1"),
        ("A", "IN", "ifsc", ""),
        ("B", "IN", "pan", "INVALID_PAN_123"),
        ("C", "AE", "emirates_id", "784-1990-1234567-1"), ("C", "AE", "passport", "P"), ("C", "AE", "iloe_certificate", "x"),
        ("D", "AE", "passport", "P"),
        ("E", "SA", "passport", None),
    ]
    df = spark.createDataFrame(rows, ["candidate_id", "jurisdiction", "doc_key", "doc_value"])
    got = {r["candidate_id"]: r for r in hiring.verify_documents(df).collect()}
    assert got["A"]["status"] == "VERIFIED" and got["A"]["is_complete"] and len(got["A"]["verified_documents"]) == 3
    assert got["B"]["status"] == "INVALID_FORMAT" and "Aadhaar Card" in got["B"]["missing_documents"]
    assert got["B"]["invalid_documents"][0]["document"] == "PAN Card"
    assert got["C"]["status"] == "VERIFIED"
    assert got["D"]["status"] == "MISSING_DOCUMENTS" and len(got["D"]["missing_documents"]) == 2
    assert got["E"]["status"] == "VERIFIED" and got["E"]["statutory_citations"] == []


def test_provisioning(spark):
    df = spark.createDataFrame(
        [("T", "EMP-1", "Senior Lead Developer", "Maya"), ("T", "EMP-2", "Accountant", None)],
        "tenant_id string, employee_id string, role string, buddy_name string",
    )
    rows = hiring.provisioning_tasks(df).collect()
    first = [r["item"] for r in rows if r["employee_id"] == "EMP-1"]
    second = [r["item"] for r in rows if r["employee_id"] == "EMP-2"]
    assert any("YubiKey" in i for i in first) and not any("YubiKey" in i for i in second)
    assert "emp-1@company.internal (Google Workspace / M365)" in first
    assert "Welcome Lunch with Onboarding Buddy (Maya)" in first and "Maya" in first
    assert "Welcome Lunch with Onboarding Buddy (Team Lead)" in second and "Assigned Senior Peer" in second
    assert (len(first), len(second)) == (13, 12)


def test_bias(spark):
    text = "We want a Rockstar NINJA who is aggressive. Work hard play hard! No ninjas, no gurus."
    row = hiring.audit_bias(spark.createDataFrame([(text,), ("calm text",)], ["jd_text"])).collect()
    assert [t["flagged_term"] for t in row[0]["detected_terms"]] == ["rockstar", "ninja", "aggressive", "work hard play hard"]
    assert "[exceptional contributor / skilled specialist]" in row[0]["suggested_rewrite"]
    assert "ninjas" in row[0]["suggested_rewrite"]
    assert not row[1]["has_bias"] and row[1]["suggested_rewrite"] == "calm text"


def test_scores(spark):
    df = spark.createDataFrame(
        [
            (1, "Bachelor degree. Python, SQL and Spark.", ["python", "SQL", "Spark", "Go", "Rust"], 4.0, 5.0),
            (2, "nothing here", ["python"], 10.0, 1.0),
            (3, "nothing", [], 0.0, 0.0),
        ],
        "id int, resume_text string, required_skills array<string>, required_years double, candidate_years double",
    )
    rows = {r["id"]: r for r in hiring.score_candidates(df).collect()}
    one = rows[1]
    assert (one["skills_score"], one["experience_score"], one["education_score"], one["composite_score"]) == (60, 100, 90, 75)
    assert one["recommendation"] == "SHORTLIST" and one["missing_skills"] == ["Go", "Rust"]
    assert one["explanation"] == (
        "Candidate scored 75.0/100. Skills match: 3/5 (60.0%). Experience: 5.0 yrs vs 4.0 yrs required (100.0%)."
    )
    assert rows[2]["recommendation"] == "REJECT" and rows[2]["composite_score"] == 10.0
    assert rows[3]["composite_score"] == 97.0


def test_intents(spark):
    cases = {
        "Calculate my EOSB please": "PAYROLL_EOSB", "show the CTC breakdown": "PAYROLL_STRUCTURE",
        "run a WPS audit": "COMPLIANCE_AUDIT", "what is my leave balance": "LEAVE_APPLY",
        "there was a ghost punch": "ATTENDANCE_ANOMALY", "score resume for me": "RECRUITMENT_ATS",
        "is this gender neutral": "RECRUITMENT_BIAS", "verify KYC documents": "ONBOARDING",
        "relieving letter and exit clearance": "OFFBOARDING_FNF", "hotel claim": "TRAVEL_EXPENSE",
        "which article applies": "LEGAL_QNA", "hello there": "GENERAL_HR",
    }
    df = spark.createDataFrame([(t,) for t in cases], ["text"])
    rows = {r["text"]: r for r in search.label_intent(df).collect()}
    assert {t: r["intent"] for t, r in rows.items()} == cases
    assert rows["hello there"]["confidence"] == 0.70
    assert rows["verify KYC documents"]["sub_route"] == "documents"
    assert rows["relieving letter and exit clearance"]["sub_route"] == "clearance"
    volumes = search.intent_volumes(search.label_intent(df)).collect()
    assert len(volumes) == 12 and all(r["messages"] == 1 for r in volumes)


def _search(query, jurisdiction, limit):
    rows = [s for s in refdata.STATUTES if not jurisdiction or s["jurisdiction"] == jurisdiction]
    tokens = [t.lower() for t in re.findall(r"\w+", query) if len(t) > 2]
    if not tokens:
        return [(refdata.STATUTES.index(s), 0.0) for s in rows[:limit]]
    scored = []
    for s in rows:
        everything = " ".join([s["act_name"], s["title"], s["summary"], s["section"], s["chapter"]]).lower()
        score = sum(
            1 + 3 * (t in s["act_name"].lower()) + 2 * (t in s["title"].lower()) + 2.5 * (t in s["section"].lower())
            for t in tokens if t in everything
        )
        if score:
            scored.append((refdata.STATUTES.index(s), score))
    return sorted(scored, key=lambda x: -x[1])[:limit]


def test_statute_search(spark):
    queries = [
        (1, "provident fund statutory ceiling", "IN"), (2, "wages protection system deadline", "AE"),
        (3, "a b", None), (4, "zzz qqq", None), (5, "wages wages section 6 of the act hours hours", None), (6, "", "US"),
    ]
    df = spark.createDataFrame(queries, "id int, query string, jurisdiction string")
    got = {}
    for r in search.search_statutes(df, limit=5, jurisdiction="jurisdiction").orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["statute_ord"], r["score"]))
    for ident, query, where in queries:
        assert got.get(ident, []) == _search(query, where, 5), query
    assert "Provident Funds" in refdata.STATUTES[got[1][0][0]]["act_name"]
    assert search.statutes(spark).count() == 10


# ------------------------------------------------------------------------------ dedupe
def _greedy(rows):
    """The merge rule record by record, written from its description."""
    owner, profiles, bare = {}, {}, {}
    for arrival, ident, email, phone, link, source in sorted(rows):
        keys = [k for k in (email, phone, link) if k]
        hit = next((owner[k] for k in keys if k in owner), None)
        if hit is not None:
            p = profiles[hit]
            p["n"] += 1
            p["ids"] += [ident] if ident not in p["ids"] else []
            p["src"] += [source] if source not in p["src"] else []
            p["phone"] = p["phone"] or phone
            p["link"] = p["link"] or link
            continue
        profile = {"id": ident, "n": 1, "ids": [ident], "src": [source], "phone": phone, "link": link, "email": email}
        if not keys:
            bare[ident] = (arrival, profile)
            continue
        profiles[arrival] = profile
        for k in keys:
            owner.setdefault(k, arrival)
    profiles.update({a: p for a, p in bare.values()})
    return {
        a: (p["id"], p["email"], p["phone"], p["link"], tuple(p["src"]), p["n"], tuple(p["ids"])) for a, p in profiles.items()
    }


SCHEMA = "arrival long, id string, email string, phone string, linkedin_url string, source string"


def _run(df):
    members = dedupe.dedupe_members(dedupe.normalise_candidates(df))
    ids = {}
    for r in dedupe.merged_ids(members).orderBy("first_arrival").collect():
        ids.setdefault(r["profile"], []).append(r["candidate_id"])
    return {
        r["arrival"]: (
            r["primary_id"], r["email"], r["phone"] or "", r["linkedin_url"] or "",
            tuple(r["merged_source_channels"]), r["application_count"], tuple(ids[r["arrival"]]),
        )
        for r in dedupe.merged_profiles(members).collect()
    }


@pytest.mark.parametrize("peeled", [2, 0])
def test_dedupe_random(spark, monkeypatch, peeled):
    monkeypatch.setattr(dedupe, "PEELED", peeled)
    rng = random.Random(5)
    rows = []
    for n in range(400):
        hot = rng.random() < 0.33  # a third of all rows share one phone
        rows.append(
            (
                n, f"C{rng.randrange(300)}", rng.choice(["", f"m{rng.randrange(150)}@x.io"]),
                "555" if hot else rng.choice(["", str(rng.randrange(1000, 1120))]),
                rng.choice(["", "", f"in/{rng.randrange(90)}"]), rng.choice(["A", "B", "C"]),
            )
        )
    want = _greedy(rows)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert _run(df.repartition(7)) == want


def test_dedupe_chain_does_not_merge_through_filled_keys(spark):
    rows = [
        (1, "A", "a@x.io", "", "", "WEB"), (2, "B", "a@x.io", "111", "", "REF"), (3, "C", "", "111", "", "WEB"),
        (4, "D", "", "", "", "WEB"), (5, "D", "", "", "", "REF"),
    ]
    got = _run(spark.createDataFrame(rows, SCHEMA))
    assert got == _greedy(rows)
    assert got[1] == ("A", "a@x.io", "111", "", ("WEB", "REF"), 2, ("A", "B"))
    assert set(got) == {1, 3, 5}


def test_dedupe_cleaning(spark):
    df = spark.createDataFrame(
        [
            (1, "1", " Ana@X.io ", "+91 98765 43210", "HTTPS://LinkedIn.com/in/ana/", "LINKEDIN", "Ana P", None, None),
            (2, "2", "ana@x.io", "9876543210", None, None, None, "Ana", "P"),
            (3, None, None, None, "https://linkedin.com/in/ana", "REF", None, "A", "P"),
        ],
        "arrival int, id string, email string, phone string, linkedin_url string, source string, full_name string, "
        "first_name string, last_name string",
    )
    rows = dedupe.dedupe_candidates(df).collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row["primary_id"], row["full_name"], row["email"], row["phone"]) == ("1", "Ana P", "ana@x.io", "919876543210")
    assert row["merged_source_channels"] == ["LINKEDIN", "DIRECT_PORTAL", "REF"] and row["application_count"] == 3


def test_dedupe_long_chain(spark):
    # record n shares one key with record n+1 only: the slowest case, still exact
    rows = [(n, f"C{n}", f"k{n}", f"k{n + 1}", "", "S") for n in range(24)]
    assert _run(spark.createDataFrame(rows, SCHEMA).withColumn("phone", F.regexp_replace("phone", "k", "")).withColumn(
        "email", F.regexp_replace("email", "k", ""))).keys() == {n for n in range(0, 24, 2)}


def test_dedupe_chain_of_ten_thousand(spark, monkeypatch):
    """A row of records that wait for each other takes the logarithm of its length in stored tables."""
    stored = []
    for module in (dedupe, sequences):
        real = module.cut
        monkeypatch.setattr(module, "cut", lambda df, *by, real=real: stored.append(1) or real(df, *by))
    n = 10_000
    df = spark.range(n).selectExpr(
        "id as arrival", "concat('C', id) as id", "concat('k', id, '@x.io') as email", "'' as phone",
        "concat('k', id + 1, '@x.io') as linkedin_url", "'S' as source",
    )
    starters = dedupe.dedupe_members(dedupe.normalise_candidates(df.repartition(3))).select("starter.arrival").distinct()
    assert sorted(r[0] for r in starters.collect()) == list(range(0, n, 2))
    assert len(stored) <= 30


def test_dedupe_braided_chains(spark):
    """Records with three keys that bind several chains: gates with two open inputs wait for each other."""
    rng = random.Random(3)
    rows = [
        (n, f"C{n}", f"e{n // 2}", f"{1000 + (n + 1) // 3}", f"in/{rng.randrange(max(0, n // 4 - 2), n // 4 + 2)}", "S") for n in range(160)
    ]
    assert _run(spark.createDataFrame(rows, SCHEMA)) == _greedy(rows)


def test_gates(spark):
    """All small gates against their truth tables."""
    inputs = [dedupe.TRUE, -dedupe.TRUE, 1, -1, 2, -2]
    rows = [(p, a, b) for p in inputs for a in [*inputs, None] for b in [*inputs, None]]
    df = spark.createDataFrame(rows, "p long, a long, b long")
    for r in df.withColumn("v", dedupe._settled(F.col("p"), F.col("a"), F.col("b"))).collect():
        of = lambda x, truth: True if x in (None, dedupe.TRUE) else x != -dedupe.TRUE and truth[abs(x)] == (x > 0)
        table = [{1: i, 2: j} for i in (True, False) for j in (True, False)]
        want = [of(r.p, t) and not (of(r.a, t) and of(r.b, t)) for t in table]
        if r.v is not None:
            assert [of(r.v, t) for t in table] == want, r
        else:
            assert len({abs(x) for x in (r.p, r.a, r.b) if x is not None and abs(x) < dedupe.TRUE}) == 2, r


def test_dedupe_equal_arrivals(spark):
    rows = [
        (7, "A", "a@x.io", "111", "", "WEB"), (7, "B", "b@x.io", "222", "", "REF"), (7, "C", "b@x.io", "", "", "WEB"),
        (7, "C", "b@x.io", "", "", "WEB"), (7, None, "", "333", "", "WEB"), (7, None, "", "333", "in/z", "WEB"),
    ]
    members = dedupe.dedupe_members(dedupe.normalise_candidates(spark.createDataFrame(rows, SCHEMA)))
    got = sorted((r["primary_id"], r["application_count"]) for r in dedupe.merged_profiles(members).collect())
    assert got == [("A", 1), ("B", 3), ("CAND-0", 2)]


def test_dedupe_runs_no_python(spark, monkeypatch):
    from pyspark.sql import DataFrame

    for name in ("mapInPandas", "mapInArrow", "toPandas"):
        monkeypatch.setattr(DataFrame, name, None)
    rows = [(n, f"C{n}", f"m{n % 5}@x.io", "", "", "S") for n in range(20)]
    assert dedupe.dedupe_candidates(spark.createDataFrame(rows, SCHEMA)).count() == 5


# ------------------------------------------------------------------------------ corpus search
CORPUS = "statute_ord long, jurisdiction string, act_name string, title string, section string, summary string, chapter string"


def _ranked(corpus, text, scope, limit):
    """The ranking text by text, written from its description."""
    tokens = [t for t in re.findall(r"\w+", (text or "").lower()) if len(t) > 2]
    out = []
    for row in corpus:
        if scope and row[1] not in (scope, "GLOBAL"):
            continue
        act, title, section, summary, chapter = ((x or "").lower() for x in row[2:])
        score = 0.0
        for token in tokens:
            if any(token in part for part in (act, title, section, summary, chapter)):
                score += 1 + 3 * (token in act) + 2 * (token in title) + 2.5 * (token in section)
        if score or not tokens:
            out.append((-score, row[0], row[2]))
    return [(n, -s, o, a) for n, (s, o, a) in enumerate(sorted(out)[:limit], 1)]


def test_corpus_search_against_search_text_by_text(spark):
    rng = random.Random(6)
    words = ["leave", "wage", "wages", "Gratuity", "pay", "Überstunden", "x1_y", "probation", "employ", "employer", "act", "of"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    corpus = [(i, rng.choice(["IN", "AE", "GLOBAL"]), some(4), some(5) or None, some(3), some(12), some(3)) for i in range(80)]
    asked = [(i, rng.choice(["in", "AE", None]), some(6)) for i in range(60)]
    asked += [(100, None, None), (101, "AE", "of an"), (102, "XX", ""), (103, None, "employ employ wag zzz loy"), (104, "IN", "zzzz")]
    index = search.index_corpus(spark.createDataFrame(corpus, CORPUS).repartition(3))
    df = spark.createDataFrame(asked, "q long, where string, query string")
    got = {}
    for r in search.search_corpus(df, index, ["q"], limit=4, jurisdiction="where").orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append((r["rank"], r["score"], r["ord"], r["act_name"]))
    want = {q: _ranked(corpus, text, scope and scope.upper(), 4) for q, scope, text in asked}
    assert got == {q: rows for q, rows in want.items() if rows}


def test_corpus_of_a_hundred_thousand_texts(spark):
    corpus = spark.range(100_000).selectExpr(
        "id as statute_ord", "if(id % 3 = 0, 'IN', 'AE') as jurisdiction", "concat('act', id % 1000) as act_name",
        "concat('rule ', id) as title", "'s' as section", "concat('about topic', id % 77, ' common words') as summary", "'' as chapter",
    )
    index = search.index_corpus(corpus)
    df = spark.createDataFrame([(1, "act999 topic5 common"), (2, "rule 99999")], "q long, query string")
    got = [tuple(r) for r in search.search_corpus(df, index, ["q"], limit=2).orderBy("q", "rank").collect()]
    # act999 stands where the id ends in 999; topic5 also in topic50 to topic59
    five = [i for i in range(999, 100_000, 1000) if str(i % 77).startswith("5")]
    assert got[:2] == [(1, n + 1, 6.0, i, "act999") for n, i in enumerate(five[:2])]
    assert got[2:] == [(2, 1, 6.0, 99_999, "act999"), (2, 2, 3.0, 0, "act0")]
