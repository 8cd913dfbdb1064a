"""Hiring, dedupe, intent, search, privacy and governance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewframe import refdata
from crewframe.operators import dedupe, governance, hiring, privacy, search
from crewframe.plans import adapters as ad
from crewframe.plans.registry import query
from crewframe.session import cut
from crewframe.plans.sqlviews import hu, pick, text, with_views

SECRET = "comparison-run-key"  # only for the comparison; a deployment passes its own

# -------------------------------------------------------------------------------- offers
OFFERS = f"""WITH o AS (
  SELECT o_orderkey AS offer_id, 'T' || (o_orderkey % 5) AS tenant_id, o_orderpriority AS job_title,
    round(o_totalprice * 100)::BIGINT AS cents, CASE WHEN o_orderkey % 2 = 0 THEN 'AE' ELSE 'IN' END AS jurisdiction
  FROM orders),
b AS (
  SELECT tenant_id, job_title, {hu('max(cents) * 2', 10)} AS low, {hu('max(cents) * 8', 10)} AS high FROM o GROUP BY 1, 2),
j AS (SELECT o.*, low, high FROM o JOIN b ON o.tenant_id = b.tenant_id AND o.job_title = b.job_title)"""


def _thousands(cents: str) -> str:
    return f"format('{{:,}}', (({cents})::BIGINT // 100)) || '.' || lpad((({cents})::BIGINT % 100)::VARCHAR, 2, '0')"


@query(
    "offer_evaluation",
    f"""{OFFERS}
    SELECT offer_id, CASE WHEN jurisdiction = 'AE' AND cents < 6000000 THEN 'BELOW_MINIMUM_WAGE'
        WHEN cents > high OR cents < low THEN 'BAND_VIOLATION' ELSE 'DRAFTED' END AS status,
      NOT (cents > high OR cents < low) AS within_band, cents > high AS requires_executive_approval,
      CASE WHEN jurisdiction = 'IN' THEN {text(refdata.OFFER_CITATIONS['IN'])}
        WHEN cents < 6000000 THEN {text(refdata.OFFER_CITATIONS['AE'])} ELSE '' END AS statutory_citation,
      CASE WHEN jurisdiction = 'AE' AND cents < 6000000
          THEN 'Salary of AED ' || {_thousands('cents')} || '/yr is below recommended statutory baseline.'
        WHEN cents > high THEN 'Proposed salary of INR ' || {_thousands('cents')} || ' exceeds department band ceiling of INR '
          || {_thousands('high')} || ' by INR ' || {_thousands('cents - high')} || '. Executive approval required.'
        WHEN cents < low THEN 'Proposed salary of INR ' || {_thousands('cents')} || ' falls below department band minimum of INR '
          || {_thousands('low')} || '.'
        ELSE 'Offer of INR ' || {_thousands('cents')} || ' is compliant with standard salary bands.' END AS explanation
    FROM j""",
)
def offer_evaluation(spark, sf_dir):
    """Check every order as an offer against bands derived per tenant and title."""
    key = F.col("o_orderkey")
    offers = ad.table(spark, sf_dir, "orders").select(
        key.alias("offer_id"),
        F.concat(F.lit("T"), (key % 5).cast("string")).alias("tenant_id"),
        F.concat(F.lit("Candidate "), key.cast("string")).alias("candidate_name"),
        F.col("o_orderpriority").alias("job_title"),
        ad.cents("o_totalprice").alias("_cents"),
        ad.from_cents(ad.cents("o_totalprice")).alias("annual_salary"),
        F.lit("INR").alias("currency"),
        F.when(key % 2 == 0, "AE").otherwise("IN").alias("jurisdiction"),
    )
    tenth = lambda n: F.round(F.max("_cents").cast("decimal(18,0)") * n / 10, 0)
    bands = offers.groupBy("tenant_id", "job_title").agg(
        ad.from_cents(tenth(2)).alias("band_min"), ad.from_cents(tenth(8)).alias("band_max")
    )
    return hiring.evaluate_offers(hiring.offers_with_bands(offers, bands)).select(
        "offer_id", "status", "within_band", "requires_executive_approval", "statutory_citation", "explanation"
    )


DOC_KEYS = ["pan", "aadhaar", "bank_account", "ifsc", "emirates_id", "passport", "iloe_certificate"]


@query(
    "document_checks",
    f"""WITH d AS (
      SELECT o_custkey AS candidate_id, CASE WHEN o_custkey % 2 = 0 THEN 'AE' ELSE 'IN' END AS jurisdiction,
        {pick(DOC_KEYS, 'o_orderkey % 7')} AS k, lpad((o_orderkey % 10000)::VARCHAR, 4, '0') AS n, o_orderkey % 3 AS kind
      FROM orders),
    v AS (
      SELECT candidate_id, jurisdiction, k, CASE WHEN kind = 0 THEN 'bad-' || n WHEN k = 'pan' THEN ' abcde' || n || 'f '
        WHEN k = 'aadhaar' THEN '1234-5678 ' || n WHEN k = 'emirates_id' THEN '784-' || n || '-1234567-1' ELSE n END AS val FROM d),
    w AS (
      SELECT candidate_id, jurisdiction, {', '.join(f"max(val) FILTER (WHERE k = '{k}') AS {k}" for k in DOC_KEYS)}
      FROM v GROUP BY 1, 2),
    s AS (
      SELECT candidate_id, jurisdiction,
        CASE WHEN jurisdiction = 'IN' THEN
          [CASE WHEN pan IS NULL THEN 'M' WHEN regexp_matches(upper(trim(pan)), '^[A-Z]{{5}}[0-9]{{4}}[A-Z]$') THEN 'V' ELSE 'X' END,
           CASE WHEN aadhaar IS NULL THEN 'M' WHEN regexp_matches(regexp_replace(aadhaar, '[\\s-]', '', 'g'), '^\\d{{12}}$') THEN 'V' ELSE 'X' END,
           CASE WHEN bank_account IS NOT NULL AND ifsc IS NOT NULL THEN 'V' ELSE 'M' END]
        ELSE
          [CASE WHEN emirates_id IS NULL THEN 'M' WHEN regexp_matches(trim(emirates_id), '^784-\\d{{4}}-\\d{{7}}-\\d$')
             OR regexp_matches(replace(emirates_id, '-', ''), '^784\\d{{12}}$') THEN 'V' ELSE 'X' END,
           CASE WHEN passport IS NULL THEN 'M' ELSE 'V' END, CASE WHEN iloe_certificate IS NULL THEN 'M' ELSE 'V' END] END AS c
      FROM w)
    SELECT candidate_id, jurisdiction, CASE WHEN list_contains(c, 'X') THEN 'INVALID_FORMAT' WHEN list_contains(c, 'M')
        THEN 'MISSING_DOCUMENTS' ELSE 'VERIFIED' END AS status,
      NOT list_contains(c, 'X') AND NOT list_contains(c, 'M') AS is_complete,
      len(list_filter(c, lambda x: x = 'V')) AS verified, len(list_filter(c, lambda x: x = 'M')) AS missing,
      len(list_filter(c, lambda x: x = 'X')) AS invalid
    FROM s""",
)
def document_checks(spark, sf_dir):
    """Identity document checklist per customer, orders being the submitted documents."""
    key = F.col("o_orderkey")
    number = F.lpad((key % 10000).cast("string"), 4, "0")
    kind = ad.pick(DOC_KEYS, key % 7)
    value = (
        F.when(key % 3 == 0, F.concat(F.lit("bad-"), number))
        .when(kind == "pan", F.concat(F.lit(" abcde"), number, F.lit("f ")))
        .when(kind == "aadhaar", F.concat(F.lit("1234-5678 "), number))
        .when(kind == "emirates_id", F.concat(F.lit("784-"), number, F.lit("-1234567-1")))
        .otherwise(number)
    )
    documents = ad.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("candidate_id"),
        F.when(F.col("o_custkey") % 2 == 0, "AE").otherwise("IN").alias("jurisdiction"),
        kind.alias("doc_key"),
        value.alias("doc_value"),
    )
    return hiring.verify_documents(documents).select(
        "candidate_id", "jurisdiction", "status", "is_complete", F.size("verified_documents").alias("verified"),
        F.size("missing_documents").alias("missing"), F.size("invalid_documents").alias("invalid"),
    )


@query(
    "provisioning_tasks",
    with_views(
        ["employees"],
        f"""SELECT employee_id, t.kind AS kind, t.slot AS slot, replace(replace(t.item, '{{employee}}', lower(id)), '{{buddy}}',
            CASE WHEN employee_id % 3 = 0 THEN 'Team Lead' ELSE last_name END) AS item
        FROM (SELECT *, first_name = 'Machinery' AS eng FROM employees), (VALUES
          {', '.join(f"('ASSET', '', {text(a)}, false)" for a in refdata.JOINER_ASSETS)},
          ('ASSET', '', {text(refdata.JOINER_ENGINEER_ASSET)}, true),
          {', '.join(f"('ACCOUNT', '', {text(a)}, false)" for a in refdata.JOINER_ACCOUNTS)},
          {', '.join(f"('SCHEDULE', {text(at)}, {text(a)}, false)" for at, a in refdata.JOINER_SCHEDULE)}) t(kind, slot, item, only_eng)
        WHERE eng OR NOT only_eng
        UNION ALL SELECT employee_id, 'BUDDY', '', CASE WHEN employee_id % 3 = 0 THEN 'Assigned Senior Peer' ELSE last_name END
        FROM employees""",
    ),
)
def provisioning_tasks(spark, sf_dir):
    """First-day tasks of every employee."""
    key = F.col("employee_id")
    joiners = ad.employees(spark, sf_dir).select(
        "tenant_id", "id", key.alias("_key"),
        F.when(F.col("first_name") == "Machinery", "Machinery Engineer").otherwise(F.col("first_name")).alias("role"),
        F.when(key % 3 != 0, F.col("last_name")).alias("buddy_name"),
    ).withColumnRenamed("id", "employee_id")
    return hiring.provisioning_tasks(joiners).select(
        F.substring_index("employee_id", "-", -1).cast("bigint").alias("employee_id"), "kind", "slot", "item"
    )


# ---------------------------------------------------------------------------------- text
def _bias_sql() -> str:
    rewritten = "jd_text"
    for term, better in refdata.BIAS_TERMS:
        rewritten = f"regexp_replace({rewritten}, '(?i)\\b{term}\\b', {text('[' + better + ']')}, 'g')"
    terms = ", ".join(
        f"CASE WHEN regexp_matches(jd_text, '(?i)\\b{term}\\b') THEN {text(term)} END" for term, _ in refdata.BIAS_TERMS
    )
    return f"""SELECT doc_id, terms <> '' AS has_bias, terms AS flagged_terms, md5(r) AS rewrite_md5 FROM (
      SELECT doc_id, array_to_string(list_filter([{terms}], lambda x: x IS NOT NULL), '|') AS terms, {rewritten} AS r FROM job_texts)"""


@query("bias_audit", with_views(["job_texts"], _bias_sql()))
def bias_audit(spark, sf_dir):
    """Biased terms in every document and its rewrite."""
    return hiring.audit_bias(ad.job_texts(spark, sf_dir)).select(
        "doc_id", "has_bias", F.col("detected_terms")["flagged_term"].alias("flagged_terms"),
        F.md5("suggested_rewrite").alias("rewrite_md5"),
    )


@query(
    "candidate_scores",
    f"""WITH r AS (SELECT item_id, string_split(text, ' ') AS skills, (item_id % 8)::DOUBLE AS need FROM benchmark),
    c AS (SELECT doc_id, doc_id % (SELECT max(item_id) + 1 FROM benchmark) AS req, lower(text) AS t, (doc_id % 10)::DOUBLE AS years FROM documents),
    j AS (
      SELECT doc_id, need, years, len(skills) AS n, list_filter(skills, lambda s: contains(t, lower(s))) AS hit,
        list_filter(skills, lambda s: NOT contains(t, lower(s))) AS miss,
        {' OR '.join(f"contains(t, {text(w)})" for w in refdata.DEGREE_WORDS)} AS degree
      FROM c JOIN r ON req = item_id),
    s AS (
      SELECT *, CASE WHEN n > 0 THEN len(hit)::DOUBLE / n * 100 ELSE 100.0 END AS sk,
        CASE WHEN need <= 0 THEN 100.0 ELSE least(100.0, years / need * 100) END AS ex, CASE WHEN degree THEN 90.0 ELSE 70.0 END AS ed FROM j),
    k AS (SELECT *, round(sk * 0.6::DOUBLE + ex * 0.3::DOUBLE + ed * 0.1::DOUBLE, 2) AS comp FROM s)
    SELECT doc_id AS candidate_id, round(sk, 2) AS skills_score, round(ex, 2) AS experience_score, ed::DOUBLE AS education_score,
      comp AS composite_score, CASE WHEN comp >= 75 THEN 'SHORTLIST' WHEN comp >= 55 THEN 'REVIEW_BAND' ELSE 'REJECT' END AS recommendation,
      array_to_string(hit, '|') AS matched_skills, array_to_string(miss, '|') AS missing_skills
    FROM k""",
)
def candidate_scores(spark, sf_dir):
    """Score every document as an application to its opening."""
    joined = hiring.candidates_with_requisition(ad.applications(spark, sf_dir), ad.requisitions(spark, sf_dir))
    return hiring.score_candidates(joined).select(
        "candidate_id", "skills_score", "experience_score", "education_score", "composite_score", "recommendation",
        "matched_skills", "missing_skills",
    )


INTENT = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(t, {text(w)})" for w in words) + f" THEN {text(name)}"
    for name, _, _, words in refdata.INTENTS
) + " ELSE 'GENERAL_HR' END"
ROWS = refdata.INTENTS + [(*refdata.DEFAULT_INTENT, [])]
CONFIDENCE = "CASE intent " + " ".join(f"WHEN {text(r[0])} THEN {r[1]}::DOUBLE" for r in ROWS) + " END"
SPECIALIST = "CASE intent " + " ".join(f"WHEN {text(r[0])} THEN {text(r[2])}" for r in ROWS) + " END"
ROUTE = "CASE " + " ".join(
    f"WHEN intent = {text(i)} AND (" + " OR ".join(f"contains(t, {text(w)})" for w in words) + f") THEN {text(r)}"
    for i, r, words in refdata.SUB_ROUTES
) + " " + " ".join(f"WHEN intent = {text(i)} THEN {text(r)}" for i, r in refdata.SUB_ROUTE_DEFAULTS.items()) + " ELSE '' END"
LABELLED = f"""labelled AS (SELECT conv_id, turn, intent, {CONFIDENCE} AS confidence, {SPECIALIST} AS specialist, {ROUTE} AS sub_route
  FROM (SELECT *, {INTENT} AS intent FROM (SELECT *, lower(text) AS t FROM messages)))"""


@query("intent_labels", with_views(["messages"], "SELECT * FROM labelled", LABELLED))
def intent_labels(spark, sf_dir):
    """Intent, specialist and sub-route of every message."""
    return search.label_intent(ad.messages(spark, sf_dir)).drop("text")


@query(
    "intent_volumes",
    with_views(["messages"], "SELECT intent, specialist, count(*) AS messages FROM labelled GROUP BY 1, 2", LABELLED),
)
def intent_volumes(spark, sf_dir):
    """Messages per intent."""
    return search.intent_volumes(search.label_intent(ad.messages(spark, sf_dir)))


STATUTE_SEARCH = with_views(
    ["messages", "statutes"],
    """SELECT conv_id, turn, rn AS rank, score, statute_ord::BIGINT AS statute_ord, act_name FROM (
      SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, statute_ord) AS rn FROM (
        SELECT conv_id, turn, statute_ord, act_name, sum(1 + CASE WHEN contains(act_l, tok) THEN 3 ELSE 0 END
            + CASE WHEN contains(title_l, tok) THEN 2 ELSE 0 END
            + CASE WHEN contains(section_l, tok) THEN 2.5 ELSE 0 END)::DOUBLE AS score
        FROM toks JOIN statutes ON contains(everything, tok) AND (want = '' OR jurisdiction = want)
        GROUP BY 1, 2, 3, 4)) WHERE rn <= 5""",
    r"""toks AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'IN' WHEN conv_id % 3 = 1 THEN 'AE' ELSE '' END AS want,
          tok FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Pc}]+')) AS tok FROM messages)
          WHERE len(tok) > 2)""",
)


@query("statute_search", STATUTE_SEARCH)
def statute_search(spark, sf_dir):
    """Top five statutes for every message."""
    wanted = F.when(F.col("conv_id") % 3 == 0, "IN").when(F.col("conv_id") % 3 == 1, "AE")
    asked = ad.messages(spark, sf_dir).select("conv_id", "turn", wanted.alias("where"), F.col("text").alias("query"))
    return search.search_statutes(asked, limit=5, jurisdiction="where").select(
        "conv_id", "turn", "rank", "score", "statute_ord", "act_name"
    )


@query("statute_search_table", STATUTE_SEARCH)
def statute_search_table(spark, sf_dir):
    """The same with the statutes as an indexed table."""
    wanted = F.when(F.col("conv_id") % 3 == 0, "IN").when(F.col("conv_id") % 3 == 1, "AE")
    asked = ad.messages(spark, sf_dir).select("conv_id", "turn", wanted.alias("where"), F.col("text").alias("query"))
    found = search.search_corpus(asked, search.index_corpus(search.statutes(spark)), ["conv_id", "turn"], limit=5, jurisdiction="where")
    return found.select("conv_id", "turn", "rank", "score", F.col("ord").cast("bigint").alias("statute_ord"), "act_name")


@query(
    "document_search",
    r"""WITH toks AS (
      SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Pc}]+')) AS tok FROM benchmark),
    d AS (SELECT doc_id, source, lower(lang) AS title_l, lower(text) AS text_l, lower(source) AS act_l FROM documents),
    t AS (SELECT item_id, tok, count(*) AS times FROM toks WHERE len(tok) > 2 GROUP BY ALL),
    s AS (SELECT item_id, doc_id, any_value(source) AS source, sum(times * (1 + CASE WHEN contains(act_l, tok) THEN 3 ELSE 0 END
        + CASE WHEN contains(title_l, tok) THEN 2 ELSE 0 END))::DOUBLE AS score
      FROM t JOIN d ON contains(text_l, tok) OR contains(act_l, tok) OR contains(title_l, tok) GROUP BY item_id, doc_id)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, score, doc_id, source
    FROM s QUALIFY rank <= 10""",
)
def document_search(spark, sf_dir):
    """The ten documents that hold most words of each benchmark item."""
    corpus = ad.table(spark, sf_dir, "documents").select(
        "doc_id", F.lit("GLOBAL").alias("jurisdiction"), F.col("source").alias("act_name"), F.col("lang").alias("title"),
        F.lit("").alias("section"), F.col("text").alias("summary"), F.lit("").alias("chapter"),
    )
    asked = ad.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    found = search.search_corpus(asked, search.index_corpus(corpus, "doc_id"), ["item_id"], limit=10)
    return found.select("item_id", "rank", "score", F.col("ord").alias("doc_id"), F.col("act_name").alias("source"))


# -------------------------------------------------------------------------------- dedupe
CANDIDATES = """WITH RECURSIVE c AS (
  SELECT c_custkey AS arrival, 'CAND-' || (c_custkey // 2) AS id, c_name AS full_name,
    CASE WHEN c_custkey % 4 <> 0 THEN 'u' || (c_custkey // 6) || '@mail.io' ELSE '' END AS email,
    CASE WHEN c_custkey % 3 = 0 THEN '14155550000' WHEN c_custkey % 5 = 0 THEN '' ELSE '4420' || (c_custkey // 4 + 1000000) END AS phone,
    CASE WHEN c_custkey % 7 = 0 THEN 'https://in.io/p/' || (c_custkey // 21) ELSE '' END AS link, c_mktsegment AS source
  FROM customer),
keyed AS (SELECT arrival, list_filter([email, phone, link], lambda x: x <> '') AS ks FROM c),
edges AS (SELECT arrival, len(ks) AS n, unnest(ks) AS key, generate_subscripts(ks, 1) AS prio FROM keyed),
r(kind, arrival, n, key) AS (
  SELECT 'left', arrival, n, key FROM edges
  UNION ALL
  SELECT * FROM (
    WITH cur AS (SELECT * FROM r WHERE kind = 'left'),
    firsts AS (SELECT key, min(arrival) AS a, arg_min(n, arrival) AS n FROM cur GROUP BY key),
    starters AS (SELECT a FROM firsts GROUP BY a HAVING count(*) = any_value(n)),
    owned AS (SELECT key, a FROM firsts WHERE a IN (SELECT a FROM starters)),
    decided AS (SELECT DISTINCT cur.arrival FROM cur JOIN owned ON cur.key = owned.key)
    SELECT 'own', a, 0, key FROM owned
    UNION ALL SELECT 'left', arrival, n, key FROM cur WHERE arrival NOT IN (SELECT arrival FROM decided))),
owners AS (SELECT key, arrival AS starter FROM r WHERE kind = 'own'),
joined AS (
  SELECT e.arrival, arg_min(starter, prio) AS starter FROM edges e JOIN owners o ON e.key = o.key AND o.starter <= e.arrival
  GROUP BY e.arrival),
bare AS (SELECT max(arrival) AS arrival FROM c WHERE email = '' AND phone = '' AND link = '' GROUP BY id),
members AS (
  SELECT c.*, starter FROM c JOIN joined ON c.arrival = joined.arrival
  UNION ALL SELECT c.*, c.arrival FROM c JOIN bare ON c.arrival = bare.arrival)"""


@query(
    "candidate_profiles",
    f"""{CANDIDATES}
    SELECT m.starter AS arrival, arg_min(id, arrival) AS primary_id, arg_min(full_name, arrival) AS full_name,
      arg_min(email, arrival) AS email, coalesce(arg_min(phone, arrival) FILTER (WHERE phone <> ''), '') AS phone,
      coalesce(arg_min(link, arrival) FILTER (WHERE link <> ''), '') AS linkedin_url,
      any_value(chan) AS merged_source_channels, count(*) AS application_count
    FROM members m JOIN (
      SELECT starter, array_to_string(list(source ORDER BY a), '|') AS chan
      FROM (SELECT starter, source, min(arrival) AS a FROM members GROUP BY 1, 2) GROUP BY 1) s ON m.starter = s.starter
    GROUP BY m.starter""",
)
def candidate_profiles(spark, sf_dir):
    """Merged candidate profiles of all customers as candidates."""
    return dedupe.dedupe_candidates(ad.candidates(spark, sf_dir))


@query(
    "candidate_members",
    f"""{CANDIDATES}
    SELECT starter AS profile, id AS candidate_id, min(arrival) AS first_arrival FROM members GROUP BY 1, 2""",
)
def candidate_members(spark, sf_dir):
    """Which record joined which profile."""
    members = dedupe.dedupe_members(dedupe.normalise_candidates(ad.candidates(spark, sf_dir)))
    return dedupe.merged_ids(members)


# ------------------------------------------------------------------------------- privacy
def _token_sql(kind: str, value: str, tenant: str) -> str:
    digest = f"sha256('{SECRET}|' || sha256('{SECRET}|' || {tenant} || '|' || {value}))"
    return f"'[VAULT_' || {kind} || '_' || translate({digest}[1:20], '0123456789abcdef', 'ABCDEFGHIJKLMNOP') || ']'"


def _mask_steps() -> str:
    """One CTE per pattern: pieces and matches, zipped back together."""
    steps, before = [], "private_texts"
    for i, (name, pattern) in enumerate(p for p in refdata.PII_PATTERNS if p[0] != "EMAIL"):
        quoted = text(pattern)
        kind = text(name)
        if name == "PHONE":
            kind = f"CASE WHEN regexp_full_match(m, {text(dict(refdata.PII_PATTERNS)['AADHAAR'])}) THEN 'AADHAAR' ELSE 'PHONE' END"
        found = "hits" if i else "[]::STRUCT(entity_type VARCHAR, original_value VARCHAR)[]"
        steps.append(
            f"""s{i} AS (SELECT doc_id, tenant_id, text, {found} AS before, regexp_extract_all(text, {quoted}) AS ms,
                  regexp_split_to_array(text, {quoted}) AS ps FROM {before}),
            t{i} AS (SELECT doc_id, tenant_id,
              list_concat(before, list_transform(ms, lambda m: {{'entity_type': {kind}, 'original_value': m}})) AS hits,
              CASE WHEN len(ms) = 0 THEN text ELSE array_to_string(list_transform(range(1, len(ps) + 1), lambda i: ps[i] ||
                CASE WHEN i > len(ms) THEN '' ELSE list_transform(ms, lambda m: {_token_sql(kind, 'm', 'tenant_id')})[i] END), '') END AS text
              FROM s{i})"""
        )
        before = f"t{i}"
    return ",\n".join(steps) + f",\nmasked AS (SELECT * FROM {before})"


@query("masked_text", with_views(["private_texts"], "SELECT doc_id, tenant_id, md5(text) AS text_md5, len(text) AS chars FROM masked", _mask_steps()))
def masked_text(spark, sf_dir):
    """Every document with its personal data replaced by tokens."""
    masked = privacy.mask_text(ad.private_texts(spark, sf_dir), "text", SECRET)
    return masked.select("doc_id", "tenant_id", F.md5("text").alias("text_md5"), F.length("text").alias("chars"))


PII_VAULT = with_views(
    ["private_texts"],
    f"""SELECT DISTINCT tenant_id, {_token_sql('h.entity_type', 'h.original_value', 'tenant_id')} AS token,
      h.original_value AS original_value, h.entity_type AS entity_type
    FROM (SELECT tenant_id, unnest(hits) AS h FROM masked)""",
    _mask_steps(),
)


@query("pii_vault", PII_VAULT)
def pii_vault(spark, sf_dir):
    """The vault of all documents."""
    return privacy.vault(ad.private_texts(spark, sf_dir), "text", SECRET)


@query("unmasked_text", with_views(["private_texts"], "SELECT doc_id, md5(text) AS text_md5 FROM private_texts"))
def unmasked_text(spark, sf_dir):
    """Mask every document, store that, and put the values back: the original text again."""
    texts = ad.private_texts(spark, sf_dir)
    masked = cut(privacy.mask_text(texts, "text", SECRET, found="found"))
    back = privacy.unmask_text(masked.drop("found"), privacy.vault_of(masked, "found"), "text", "doc_id")
    return back.select("doc_id", F.md5("text").alias("text_md5"))


@query(
    "masked_records",
    with_views(
        ["employees"],
        f"""SELECT employee_id, tenant_id, first_name, {_token_sql("'SALARY'", 'basic::VARCHAR', 'tenant_id')} AS salary,
          {_token_sql("'IBAN'", "'AE' || employee_id", 'tenant_id')} AS iban,
          'card ' || {_token_sql("'PAN'", "'ABCDE' || lpad((employee_id % 10000)::VARCHAR, 4, '0') || 'F'", 'tenant_id')} AS note
        FROM employees""",
    ),
)
def masked_records(spark, sf_dir):
    """Every employee record with sensitive fields and nested values as tokens."""
    key = F.col("employee_id")
    number = F.lpad((key % 10000).cast("string"), 4, "0")
    records = ad.employees(spark, sf_dir).select(
        "employee_id", "tenant_id", "first_name",
        (F.col("basic_salary") * 100).cast("bigint").alias("salary"),
        F.struct(
            F.concat(F.lit("AE"), key.cast("string")).alias("iban"),
            F.concat(F.lit("card ABCDE"), number, F.lit("F")).alias("note"),
        ).alias("bank"),
    )
    return privacy.mask_record(records, SECRET).select(
        "employee_id", "tenant_id", "first_name", "salary", F.col("bank.iban").alias("iban"), F.col("bank.note").alias("note")
    )


RECORD_TEXT = """basic::VARCHAR || '|AE' || employee_id || '|card ABCDE' || lpad((employee_id % 10000)::VARCHAR, 4, '0')
  || 'F|call +1 415-555-' || lpad((employee_id % 10000)::VARCHAR, 4, '0')"""


def _nested_records(spark, sf_dir):
    key = F.col("employee_id")
    number = F.lpad((key % 10000).cast("string"), 4, "0")
    return ad.employees(spark, sf_dir).select(
        "employee_id", "tenant_id", (F.col("basic_salary") * 100).cast("bigint").alias("salary"),
        F.struct(
            F.concat(F.lit("AE"), key.cast("string")).alias("iban"), F.concat(F.lit("card ABCDE"), number, F.lit("F")).alias("note")
        ).alias("bank"),
        F.concat(F.lit("call +1 415-555-"), number).alias("memo"),
    )


@query(
    "record_vault",
    with_views(
        ["employees"],
        f"""SELECT DISTINCT tenant_id, {_token_sql('e.entity_type', 'e.original_value', 'tenant_id')} AS token, e.original_value AS original_value,
          e.entity_type AS entity_type
        FROM (SELECT tenant_id, unnest([{{'entity_type': 'SALARY', 'original_value': basic::VARCHAR}},
            {{'entity_type': 'IBAN', 'original_value': 'AE' || employee_id}},
            {{'entity_type': 'PAN', 'original_value': 'ABCDE' || lpad((employee_id % 10000)::VARCHAR, 4, '0') || 'F'}},
            {{'entity_type': 'PHONE', 'original_value': '+1 415-555-' || lpad((employee_id % 10000)::VARCHAR, 4, '0')}}]) AS e
          FROM employees)""",
    ),
)
def record_vault(spark, sf_dir):
    """Every token of the masked employee records: sensitive fields, nested ones, and identifiers inside texts."""
    return privacy.record_vault(_nested_records(spark, sf_dir), SECRET)


@query("unmasked_records", with_views(["employees"], f"SELECT employee_id, {RECORD_TEXT} AS record FROM employees"))
def unmasked_records(spark, sf_dir):
    """Mask nested records, store that, and put all values back from the vault."""
    records = _nested_records(spark, sf_dir)
    masked = cut(privacy.mask_record(records, SECRET))
    flat = masked.select("employee_id", "tenant_id", F.concat_ws("|", "salary", "bank.iban", "bank.note", "memo").alias("record"))
    return privacy.unmask_text(flat, privacy.record_vault(records, SECRET), "record", "employee_id").drop("tenant_id")


@query(
    "pii_literal_leaks",
    with_views(
        ["employees"],
        """SELECT employee_id, unnest([first_name, last_name, 'u' || employee_id || '@host.io']) AS literal FROM employees""",
    ),
)
def pii_literal_leaks(spark, sf_dir):
    """Literals a masked profile text still holds: names and address stay, the phone is gone."""
    key = F.col("employee_id")
    people = ad.employees(spark, sf_dir).select(
        "employee_id", "tenant_id", F.concat_ws(" ", "first_name", "last_name").alias("full_name"),
        F.concat(F.lit("u"), key.cast("string"), F.lit("@host.io")).alias("work_email"),
        F.concat(F.lit("+1 415-555-"), F.lpad((key % 10000).cast("string"), 4, "0")).alias("phone"),
    )
    texts = people.select(
        "employee_id", "tenant_id", F.concat_ws(" ", F.lit("Reach"), "full_name", F.lit("at"), "phone", F.lit("or"), "work_email").alias("text")
    )
    masked = privacy.mask_text(texts, "text", SECRET)
    return privacy.leaked_literals(privacy.pii_literals(people, "employee_id"), masked, "employee_id", "text")


# ---------------------------------------------------------------------------- governance
PAYLOAD = """'{"cents":' || round(o_totalprice * 100)::BIGINT || ',"ref":{"cust":' || o_custkey || ',"prio":"' || o_orderpriority
  || '"},"status":"' || o_orderstatus || '"}'"""


def _mutations(spark, sf_dir):
    key = F.col("o_orderkey")
    return ad.table(spark, sf_dir, "orders").select(
        key.alias("order_id"),
        F.when(key % 5 != 0, F.concat(F.lit("T"), (key % 5).cast("string"))).alias("tenant_id"),
        F.lit("EXPENSE_CLAIM").alias("entity_type"),
        F.when(key % 2 == 0, "CREATE").otherwise("update").alias("action"),
        F.when(key % 7 != 0, F.concat(F.lit("U"), F.col("o_custkey").cast("string"))).alias("actor_id"),
        F.struct(
            F.col("o_orderstatus").alias("status"),
            F.struct(F.col("o_orderpriority").alias("prio"), F.col("o_custkey").alias("cust")).alias("ref"),
            ad.cents("o_totalprice").alias("cents"),
        ).alias("payload"),
        F.col("o_custkey").alias("customer"),
        F.col("o_orderdate").cast("timestamp").alias("written_at"),
    )


@query(
    "idempotency_keys",
    f"""SELECT o_orderkey AS order_id, sha256(CASE WHEN o_orderkey % 5 <> 0 THEN 'T' || (o_orderkey % 5) ELSE 'default' END
      || ':EXPENSE_CLAIM:' || CASE WHEN o_orderkey % 2 = 0 THEN 'create' ELSE 'update' END || ':'
      || CASE WHEN o_orderkey % 7 <> 0 THEN 'U' || o_custkey ELSE 'anonymous' END || ':' || {PAYLOAD}) AS idempotency_key
    FROM orders""",
)
def idempotency_keys(spark, sf_dir):
    """Deterministic key of every order as a write."""
    return governance.idempotency_key(_mutations(spark, sf_dir)).select("order_id", "idempotency_key")


@query(
    "write_attribution",
    f"""SELECT order_id, agent_name, hitl_approver_id, reasoning_hash,
      'inv_' || sha256(tenant || ':' || agent_name || ':' || hitl_approver_id || ':' || h)[1:12] AS agent_invocation_id, timestamp_utc
    FROM (SELECT o_orderkey AS order_id, 'T' || (o_orderkey % 5) AS tenant, 'PayrollAgent' AS agent_name,
        'U' || o_custkey AS hitl_approver_id, sha256({PAYLOAD}) AS h, 'sha256:' || sha256({PAYLOAD}) AS reasoning_hash,
        strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS timestamp_utc FROM orders)""",
)
def write_attribution(spark, sf_dir):
    """Audit columns of every order as a write."""
    writes = _mutations(spark, sf_dir).withColumn(
        "tenant_id", F.concat(F.lit("T"), (F.col("order_id") % 5).cast("string"))
    )
    return governance.attribution_columns(
        writes, agent=F.lit("PayrollAgent"), approver=F.concat(F.lit("U"), F.col("customer").cast("string")),
        reasoning=F.to_json("payload"), at=F.col("written_at"),
    ).select("order_id", "agent_name", "hitl_approver_id", "reasoning_hash", "agent_invocation_id", "timestamp_utc")


@query(
    "version_conflicts",
    """SELECT entity_id, e IS NOT NULL AND e IS DISTINCT FROM c AS is_conflict, CASE WHEN e IS NOT NULL AND e IS DISTINCT FROM c THEN
        'Optimistic concurrency conflict on EMPLOYEE ''' || entity_id || ''': expected version ''' || e || ''' but remote is '''
        || coalesce(c, 'None') || '''.' ELSE '' END AS conflict_message
    FROM (SELECT o_orderkey AS entity_id, CASE WHEN o_orderkey % 4 <> 0 THEN 'v' || (o_orderkey % 3) END AS e,
        CASE WHEN o_custkey % 5 <> 0 THEN 'v' || (o_custkey % 3) END AS c FROM orders)""",
)
def version_conflicts(spark, sf_dir):
    """Expected against stored versions of every order."""
    key, other = F.col("o_orderkey"), F.col("o_custkey")
    rows = ad.table(spark, sf_dir, "orders").select(
        F.lit("EMPLOYEE").alias("entity_type"), key.alias("entity_id"),
        F.when(key % 4 != 0, F.concat(F.lit("v"), (key % 3).cast("string"))).alias("expected_version"),
        F.when(other % 5 != 0, F.concat(F.lit("v"), (other % 3).cast("string"))).alias("current_version"),
    )
    return governance.version_conflicts(
        rows.drop("current_version"), rows.drop("expected_version")
    ).select("entity_id", "is_conflict", "conflict_message")


BATCH_CONFLICTS = """WITH RECURSIVE u AS (
  SELECT o_custkey AS entity_id, o_orderkey AS update_id, CASE WHEN o_orderkey % 11 <> 0 THEN 'v' || (o_orderkey % 3) END AS e,
    'v' || ((o_orderkey // 4) % 3) AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
held AS (SELECT DISTINCT entity_id, CASE WHEN entity_id % 5 <> 0 THEN 'v0' END AS version FROM u),
done AS (
  SELECT entity_id, 0::BIGINT AS n, version FROM held
  UNION ALL
  SELECT d.entity_id, min(u.n), arg_min(u.v, u.n) FROM done d JOIN u ON u.entity_id = d.entity_id AND u.n > d.n
    AND (u.e IS NULL OR u.e = d.version) GROUP BY d.entity_id),
met AS (SELECT u.*, d.version AS remote FROM u ASOF JOIN done d ON u.entity_id = d.entity_id AND u.n > d.n)
SELECT entity_id, update_id, coalesce(remote, '') AS remote_version, e IS NOT NULL AND e IS DISTINCT FROM remote AS is_conflict,
  CASE WHEN e IS NOT NULL AND e IS DISTINCT FROM remote THEN 'Optimistic concurrency conflict on EMPLOYEE ''' || entity_id
    || ''': expected version ''' || e || ''' but remote is ''' || coalesce(remote, 'None') || '''.' ELSE '' END AS conflict_message
FROM met"""


@query("batch_version_conflicts", BATCH_CONFLICTS)
def batch_version_conflicts(spark, sf_dir):
    """Orders as writes of their customer's record, applied one after the other: the second writer of a version conflicts."""
    key = F.col("o_orderkey")
    updates = ad.table(spark, sf_dir, "orders").select(
        F.lit("EMPLOYEE").alias("entity_type"), F.col("o_custkey").alias("entity_id"), key.alias("update_id"),
        F.when(key % 11 != 0, F.concat(F.lit("v"), (key % 3).cast("string"))).alias("expected_version"),
        F.concat(F.lit("v"), (F.floor(key / 4) % 3).cast("string")).alias("new_version"), F.col("o_orderdate").alias("written_at"),
    )
    current = updates.select("entity_type", "entity_id").distinct().filter(F.col("entity_id") % 5 != 0).withColumn("current_version", F.lit("v0"))
    return governance.applied_in_order(updates, current, "written_at", "update_id").select(
        "entity_id", "update_id", "remote_version", "is_conflict", "conflict_message"
    )
