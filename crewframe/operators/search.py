"""Message intent and statute search."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewframe import refdata
from crewframe.session import cut


def _any_of(lowered: Column, words: list[str]) -> Column:
    hit = F.contains(lowered, F.lit(words[0]))
    for word in words[1:]:
        hit = hit | F.contains(lowered, F.lit(word))
    return hit


def label_intent(df: DataFrame, column: str = "text") -> DataFrame:
    """Add intent, confidence, specialist and sub-route; the first keyword group that hits wins.

    The group index is found once and the labels are looked up from it.
    """
    lowered = F.lower(F.coalesce(F.col(column), F.lit("")))
    group = None
    for index, (_, _, _, words) in enumerate(refdata.INTENTS):
        hit = _any_of(lowered, words)
        group = F.when(hit, F.lit(index)) if group is None else group.when(hit, F.lit(index))
    rows = refdata.INTENTS + [(*refdata.DEFAULT_INTENT, [])]
    pick = lambda part: F.get(F.array(*[F.lit(r[part]) for r in rows]), F.col("_group"))
    route = None
    for intent, name, words in refdata.SUB_ROUTES:
        hit = (F.col("intent") == intent) & _any_of(lowered, words)
        route = F.when(hit, F.lit(name)) if route is None else route.when(hit, F.lit(name))
    for intent, name in refdata.SUB_ROUTE_DEFAULTS.items():
        route = route.when(F.col("intent") == intent, F.lit(name))
    return (
        df.withColumn("_group", group.otherwise(F.lit(len(refdata.INTENTS))))
        .withColumns({"intent": pick(0), "confidence": pick(1), "specialist": pick(2)})
        .withColumn("sub_route", route)
        .drop("_group")
    )


def intent_volumes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("intent", "specialist").agg(F.count("*").alias("messages"))


def _token_weight(statute: dict, token: Column) -> Column:
    """What one query token adds for one statute."""
    lowered = {k: statute[k].lower() for k in ("act_name", "title", "summary", "section", "chapter")}
    everything = F.lit(
        f"{lowered['act_name']} {lowered['title']} {lowered['summary']} {lowered['section']} {lowered['chapter']}"
    )
    part = lambda name, weight: F.when(F.contains(F.lit(lowered[name]), token), weight).otherwise(0.0)
    return F.when(
        F.contains(everything, token), part("act_name", 3.0) + part("title", 2.0) + part("section", 2.5) + 1.0
    ).otherwise(0.0)


def _tokens(query: Column) -> Column:
    """Words of a query longer than two characters, repeats included."""
    found = F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1))
    return F.filter(found, lambda token: F.length(token) > 2)


def search_statutes(df: DataFrame, query: str = "query", limit: int = 5, jurisdiction: str | None = None) -> DataFrame:
    """Rank the constant corpus for every query row; one output row per hit.

    The corpus is ten constant records, so the scores are computed inside the row from its own
    tokens: no join, no shuffle, and a long query never leaves its task.  ``jurisdiction`` names
    an optional column; null searches everything.
    """
    tokens = _tokens(F.col(query))
    wanted = F.upper(F.col(jurisdiction)) if jurisdiction else F.lit(None).cast("string")

    def scored(position: int, statute: dict) -> Column:
        weigh = lambda token: _token_weight(statute, token)
        total = F.aggregate(F.col("_tokens"), F.lit(0.0), lambda acc, token: acc + weigh(token))
        in_scope = F.lit(True) if statute["jurisdiction"] == "GLOBAL" else wanted == statute["jurisdiction"]
        return F.when(
            F.coalesce(in_scope, F.lit(True)),
            F.struct((-total).alias("_rank"), F.lit(position).alias("statute_ord")),
        )

    hits = F.array_compact(F.array(*[scored(i, s) for i, s in enumerate(refdata.STATUTES)]))
    # an empty query lists the corpus in order; otherwise only statutes with a score count
    kept = F.when(F.size("_tokens") == 0, hits).otherwise(F.filter(hits, lambda hit: hit["_rank"] < 0))
    lookup = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("_hit")["statute_ord"])
    return (
        df.withColumn("_tokens", tokens)
        .select(*df.columns, F.posexplode(F.slice(F.array_sort(kept), 1, limit)).alias("_pos", "_hit"))
        .select(
            *df.columns,
            (F.col("_pos") + 1).alias("rank"),
            (-F.col("_hit")["_rank"]).alias("score"),
            F.col("_hit")["statute_ord"].alias("statute_ord"),
            lookup([s["act_name"] for s in refdata.STATUTES]).alias("act_name"),
            lookup([refdata.cite(s) for s in refdata.STATUTES]).alias("citation"),
        )
    )


def format_citation(jurisdiction: Column, act: Column, section: Column, chapter: Column, ref: Column, title: Column) -> Column:
    """Footnote text from statute columns."""
    return F.concat(
        F.lit("["), jurisdiction, F.lit("] "), act, F.lit(", "), section, F.lit(" ("), chapter, F.lit("). Ref: "), ref,
        F.lit(". Title: '"), title, F.lit("'"),
    )


def statutes(spark) -> DataFrame:
    """The corpus as a relation: nine text columns and the rule map."""
    rows = [
        (
            position, s["jurisdiction"], s["act_name"], s["chapter"], s["section"], s["gazette_ref"], s["title"],
            s["summary"], s["penalty"], s["rules"], refdata.cite(s),
        )
        for position, s in enumerate(refdata.STATUTES)
    ]
    return spark.createDataFrame(
        rows,
        "statute_ord int, jurisdiction string, act_name string, chapter string, section string, gazette_ref string, "
        "title string, summary string, penalty string, rules map<string,double>, citation string",
    )


# ------------------------------------------------------------------------- a corpus as a table
GRAM = 3
#: parts of a text that weigh more where a token is found in them, and the bit of each in a posting
PARTS = {"act_name": (1, 3.0), "title": (2, 2.0), "section": (4, 2.5), "summary": (8, 0.0), "chapter": (8, 0.0)}


class CorpusIndex(NamedTuple):
    """Stored tables: ``texts`` (ord, jurisdiction, act_name), ``postings`` (word, ord, jurisdiction, parts) and
    ``grams`` (gram, words, word)."""

    texts: DataFrame
    postings: DataFrame
    grams: DataFrame


def _grams(word: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(word) - (GRAM - 1))
    return F.array_distinct(F.transform(places, lambda at: F.substring(word, at, F.lit(GRAM))))


def index_corpus(corpus: DataFrame, ord_: str = "statute_ord") -> CorpusIndex:
    """Index texts (ord, jurisdiction, act_name, title, section, summary, chapter) for :func:`search_corpus`.

    A token counts where it is found anywhere in a text, so it is looked up among the words of the corpus by their runs of
    three characters; the postings of a word say in which parts of which texts it stands.
    """
    cell = lambda name: F.transform(
        F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(name), F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1))),
        lambda word: F.struct(word.alias("word"), F.lit(PARTS[name][0]).alias("part")),
    )
    words = corpus.select(F.col(ord_).alias("ord"), "jurisdiction", F.inline(F.concat(*[cell(name) for name in PARTS])))
    long_ = words.filter(F.length("word") >= GRAM)
    postings = cut(long_.groupBy("word", "ord", "jurisdiction").agg(F.bit_or("part").alias("parts")))
    grams = postings.select("word").distinct().select(F.explode(_grams(F.col("word"))).alias("gram"), "word")
    sizes = grams.groupBy("gram").agg(F.count("*").alias("words"))
    texts = cut(corpus.select(F.col(ord_).alias("ord"), "jurisdiction", "act_name"))
    return CorpusIndex(texts, postings, cut(grams.join(sizes, "gram")))


def search_corpus(
    df: DataFrame, index: CorpusIndex, keys: list[str], query: str = "query", limit: int = 5, jurisdiction: str | None = None
) -> DataFrame:
    """Rank an indexed corpus of any size for every query row, as :func:`search_statutes` ranks the constant one:
    (keys, rank, score, ord, act_name).

    Each distinct token of all queries is looked up once, by its rarest run of three characters; only texts that hold a
    token are scored, and the best ``limit`` of a query are kept before the last shuffle.  ``keys`` name a query row; a
    null query, or one without tokens, lists the texts in scope in their order.
    """
    scope = F.upper(F.col(jurisdiction)) if jurisdiction else F.lit(None).cast("string")
    asked = cut(df.select(*keys, scope.alias("scope"), _tokens(F.col(query)).alias("tokens")))
    counted = asked.select(*keys, "scope", F.explode("tokens").alias("token")).groupBy(*keys, "scope", "token").agg(
        F.count("*").alias("times")
    )
    counted = cut(counted)
    looked = counted.select("token").distinct().select("token", F.explode(_grams(F.col("token"))).alias("gram"))
    # a token with a run that no word has is in no text: the count of its runs tells
    held = looked.join(index.grams.select("gram", "words").distinct(), "gram").groupBy("token").agg(
        F.min_by("gram", F.struct("words", "gram")).alias("gram"), F.count("*").alias("known")
    )
    held = held.filter(F.col("known") == F.size(_grams(F.col("token")))).select("token", "gram")
    named = held.join(index.grams.select("gram", "word"), "gram").filter(F.contains("word", F.col("token")))
    # what a query finds in one text is added up where the text's postings lie, so query and text pairs are never shuffled
    found = named.select("token", "word").join(index.postings, "word").repartition("ord")
    found = found.groupBy("token", "ord", "jurisdiction").agg(F.bit_or("parts").alias("parts"))
    weight = F.lit(1.0)
    for bit, more in sorted({v for v in PARTS.values() if v[1]}):
        weight = weight + F.when(F.col("parts").bitwiseAND(F.lit(bit)) != 0, more).otherwise(0.0)
    in_scope = F.col("scope").isNull() | (F.col("jurisdiction") == "GLOBAL") | (F.col("jurisdiction") == F.col("scope"))
    scored = counted.join(found.withColumn("weight", weight), "token").filter(in_scope)
    scored = scored.groupBy(*keys, "ord").agg(F.sum(F.col("times") * F.col("weight")).alias("score"))

    # the first texts of each jurisdiction and of all; those of every scope are at most ``limit``
    order = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("ord"))
    first = index.texts.select("ord", F.explode(F.array("jurisdiction", F.lit("*"))).alias("of"))
    first = first.withColumn("n", order("of")).filter(F.col("n") <= limit).select("ord", "of")
    empty = asked.filter(F.size("tokens") == 0).select(
        *keys, F.explode(F.when(F.col("scope").isNull(), F.array(F.lit("*"))).otherwise(F.array_distinct(F.array("scope", F.lit("GLOBAL"))))).alias("of")
    )
    listed = empty.join(first, "of").select(*keys, "ord", F.lit(0.0).alias("score"))

    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "ord")
    ranked = scored.unionByName(listed).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)
    return ranked.join(index.texts.select("ord", "act_name"), "ord").select(*keys, "rank", "score", "ord", "act_name")
