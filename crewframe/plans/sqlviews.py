"""The views of :mod:`crewframe.plans.adapters` as SQL text for the comparison engine.

Money is integer cents there: ``hu(n, d)`` is n/d rounded half up for n >= 0.
"""

from __future__ import annotations

from crewframe import refdata
from crewframe.plans import adapters


def hu(numerator: str, divisor: int) -> str:
    return f"((2*({numerator})::HUGEINT + {divisor}) // (2*{divisor}))"


def amount(cents: str) -> str:
    return f"(({cents})::DOUBLE / 100)"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def pick(values, index: str) -> str:
    return f"({listed(values)})[(({index}) + 1)::INT]"


def with_views(names: list[str], query: str, extra: str = "") -> str:
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in names]
    return "WITH " + ",\n".join(parts) + (f",\n{extra}" if extra else "") + "\n" + query


VIEWS = {
    "employees": """
        SELECT 'T' || n_regionkey AS tenant_id, CASE WHEN c_custkey % 2 = 0 THEN 'AE' ELSE 'IN' END AS jurisdiction,
          c_custkey AS employee_id, 'EMP-' || c_custkey AS id,
          upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS first_name, c_name AS last_name,
          round(abs(c_acctbal) * 100)::BIGINT * 3 AS basic, ((c_custkey * 7) % 300)::INT AS probation_days,
          c_custkey % 3 <> 0 AS is_pf_enrolled, (c_custkey % 400)::BIGINT AS tenths, c_custkey % 5 = 0 AS on_probation
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "lines": f"""
        SELECT l_orderkey AS claim_id,
          lpad(l_linenumber::VARCHAR, 3, '0') || lpad(l_partkey::VARCHAR, 12, '0') || lpad(l_suppkey::VARCHAR, 12, '0')
            || lpad(l_quantity::BIGINT::VARCHAR, 6, '0')
            || lpad(round(l_extendedprice * 100)::BIGINT::VARCHAR, 14, '0') AS line_no,
          {pick(["MEAL", "HOTEL", "FLIGHT", "LOCAL_CONVEYANCE"], "l_partkey % 4")} AS category,
          (500 * (l_partkey % 12 + 1))::BIGINT AS amount, date_trunc('quarter', l_shipdate)::DATE AS d,
          l_returnflag <> 'N' AS has_receipt
        FROM lineitem""",
    "claims": f"""
        SELECT o_orderkey AS claim_id, {pick(["INR", "AED", "USD"], "o_orderkey % 3")} AS currency,
          CASE WHEN o_custkey % 2 = 0 THEN 'METRO' ELSE 'NON_METRO' END AS tier, o_orderstatus <> 'P' AS approved
        FROM orders""",
    "punches": """
        SELECT 'T' || (user_id % 5) AS tenant_id, user_id AS employee_id, event_id AS punch_id, ts,
          CASE WHEN event_id % 2 = 0 THEN 'IN' ELSE 'OUT' END AS punch_type,
          ((event_id * 7919) % 12000) / 100.0::DOUBLE - 60.0 AS lat,
          ((event_id * 104729) % 36000) / 100.0::DOUBLE - 180.0 AS lng
        FROM events""",
    "messages": f"""
        SELECT conv_id, turn, text || ' ' || {pick(adapters.MESSAGE_PHRASES, "(conv_id + turn) % 12")} AS text
        FROM conversations""",
    "job_texts": f"""
        SELECT doc_id, text || ' ' || {pick(adapters.BIAS_PHRASES, "doc_id % 9")} AS jd_text FROM documents""",
    "private_texts": f"""
        SELECT doc_id, source AS tenant_id,
          text || replace({pick(adapters.PII_FRAGMENTS, "doc_id % 6")}, '{{n}}',
            lpad((doc_id % 9000 + 1000)::VARCHAR, 4, '0')) AS text
        FROM documents""",
    "statutes": "SELECT * FROM (VALUES "
    + ", ".join(
        f"({i}, {text(s['jurisdiction'])}, {text(s['act_name'].lower())}, {text(s['title'].lower())}, "
        f"{text(s['section'].lower())}, "
        f"{text(' '.join([s['act_name'], s['title'], s['summary'], s['section'], s['chapter']]).lower())}, "
        f"{text(s['act_name'])})"
        for i, s in enumerate(refdata.STATUTES)
    )
    + ") AS s(statute_ord, jurisdiction, act_l, title_l, section_l, everything, act_name)",
    "staff": """
        SELECT 'T' || n_regionkey AS tenant_id, c_custkey AS k,
          upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS first_name, c_name AS last_name,
          CASE WHEN c_custkey % 11 <> 0 THEN ' u' || c_custkey || '@host.io ' END AS email,
          CASE WHEN c_custkey % 2 = 0 THEN '1' WHEN c_custkey % 3 = 0 THEN '2' ELSE 'notice' END AS status_code,
          round(c_acctbal * 100)::BIGINT AS base_cents,
          strftime(DATE '2015-01-01' + (c_custkey % 3000)::INT, '%Y-%m-%d') AS doj,
          c_custkey % 4 = 0 AS is_manager, CASE WHEN c_custkey % 13 = 0 THEN 'B' || c_custkey END AS badge_no
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
}
VIEWS["all_punches"] = VIEWS["punches"]
