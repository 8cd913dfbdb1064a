"""Benchmark passages inside documents: SimHash of item-sized windows, then exact shingle similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crewframe.llm.base import query, read, text_key, words
from crewframe.session import cut, discard

BITS = 64
#: an item's windows and a window's neighbours are compared by this many words
WIDTH = 5
#: benchmark shingles are broadcast up to this number (16 bytes each); beyond it the join is a shuffle
BROADCAST_ROWS = 1_000_000


def shingles(of: Column, width: int) -> Column:
    """Hash of every run of ``width`` words; empty if there are fewer."""
    size = F.size(of)
    places = F.sequence(F.lit(0), size - width)
    hashes = F.transform(places, lambda at: F.xxhash64(*[F.get(of, at + i) for i in range(width)]))
    return F.when(size >= width, hashes).otherwise(F.array().cast("array<long>"))


def simhash(hashes: Column) -> Column:
    """Bits set in more than half of the hashes."""
    size = F.size(hashes)

    def bit(at: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.call_function("shiftrightunsigned", h, at).bitwiseAND(F.lit(1)).cast("int"))
        return F.when(ones * 2 > size, F.call_function("shiftleft", F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long"))

    places = F.sequence(F.lit(0), F.lit(BITS - 1))
    return F.aggregate(F.transform(places, bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def blocks(radius: int) -> list[int]:
    """Masks of ``radius`` + 1 blocks of the fingerprint: codes within the radius are equal in one of them."""
    edges = [round(i * BITS / (radius + 1)) for i in range(radius + 2)]
    masks = [sum(1 << bit for bit in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def similarity(left: Column, right: Column) -> Column:
    """Weighted Jaccard of two lists of shingles, each shingle weighted by how often it stands in a list."""
    both = F.aggregate(
        F.array_distinct(left), F.lit(0),
        lambda n, s: n + F.least(F.size(F.filter(left, lambda x: x == s)), F.size(F.filter(right, lambda x: x == s))),
    )
    return both / (F.size(left) + F.size(right) - both)


def items_of(benchmark: DataFrame, item: str, text: str, width: int) -> DataFrame:
    """(item, n, width, hashes, code): items without words match nothing; short ones are one shingle."""
    listed = benchmark.select(F.col(item).alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    sized = listed.select("item", "w", F.size("w").alias("n"), F.least(F.size("w"), F.lit(width)).alias("width"))
    hashes = F.lit(None).cast("array<long>")
    for short in range(1, width + 1):
        hashes = F.when(F.col("width") == short, shingles(F.col("w"), short)).otherwise(hashes)
    listed = cut(sized.withColumn("hashes", hashes).drop("w"))
    return cut(listed.withColumn("code", simhash(F.col("hashes"))))


def leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    least: float = 0.8, radius: int = 24, width: int = WIDTH,
) -> DataFrame:
    """Best window of each text for each benchmark item it holds: (t1, t2, item, start, n_words, similarity).

    ``t1, t2`` name the text (see :func:`text_key`).  A window has as many words as the item and starts where a
    shingle that both share puts the item's first word (a window that shares no shingle has similarity zero).
    Its SimHash must be within ``radius`` bits of the item's, found by equality in one of ``radius`` + 1 blocks
    of the items that share the shingle (not of all items of that length);
    then the exact weighted similarity of the shingles of ``width`` words decides.  Items shorter than ``width``
    are one shingle.  Texts or items that are null or have no words match nothing.  Of windows that are alike to an item
    to the same degree, the first counts; equal texts are one; a repeated item row counts once if its
    id repeats with the same text, and by the better of both texts otherwise.
    """
    items = items_of(benchmark, item, item_text, width)
    wanted = cut(items.select("width", "n", F.posexplode("hashes").alias("offset", "shingle")).distinct())
    known = cut(wanted.select("width", "shingle").distinct())
    sizes = sorted(r[0] for r in known.select("width").distinct().collect())  # at most ``width`` numbers
    few = known.count() <= BROADCAST_ROWS
    near = F.broadcast if few and wanted.count() <= BROADCAST_ROWS else lambda df: df

    keyed = docs.select(*[k.alias(f"t{i}") for i, k in enumerate(text_key(F.col(text)), 1)], F.col(text).alias("text"))
    texts = keyed.select("t1", "t2", words(F.col("text")).alias("w"))
    hits = None
    for size in sizes:
        placed = texts.select("t1", "t2", F.size("w").alias("n_all"), F.posexplode(shingles(F.col("w"), size)).alias("pos", "shingle"))
        here = near(wanted.filter(F.col("width") == size).select("shingle", "n", "offset"))
        found = placed.join(here, "shingle")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = texts.select("t1", "t2").limit(0).selectExpr("t1", "t2", "0 n", "0 pos", "0 offset", "0 n_all", "0L shingle")
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("offset"), F.col("n_all") - F.col("n")))
    seeds = cut(hits.select("t1", "t2", "n", start.alias("start"), "shingle").distinct())
    windows = cut(seeds.select("t1", "t2", "n", "start").distinct())

    # only texts with a window are read for their words; each window carries at most the words of an item
    per_text = windows.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "n")).alias("windows"))
    small = windows.count() <= BROADCAST_ROWS // 4
    chosen = keyed.join(F.broadcast(per_text) if small else per_text, ["t1", "t2"]).dropDuplicates(["t1", "t2"])
    chosen = chosen.select("t1", "t2", words(F.col("text")).alias("w"), F.explode("windows").alias("at"))
    # words, hashes and codes are stored one after the other, as Catalyst would else put each into every use of the next
    chosen = cut(chosen.select("t1", "t2", "at.start", "at.n", F.slice("w", F.col("at.start") + 1, F.col("at.n")).alias("w")))
    hashes = F.array().cast("array<long>")
    for size in sizes:
        hashes = F.when(F.least("n", F.lit(width)) == size, shingles(F.col("w"), size)).otherwise(hashes)
    hashed = cut(chosen.select("t1", "t2", "start", "n", hashes.alias("hashes")))
    coded = cut(hashed.withColumn("code", simhash(F.col("hashes"))))

    masks = F.array(*[F.lit(m).cast("long") for m in blocks(radius)])
    probe = lambda df: df.select("*", F.posexplode(masks).alias("block", "mask")).withColumn(
        "value", F.col("code").bitwiseAND(F.col("mask"))
    )
    window = ["t1", "t2", "start", "n"]
    left = probe(seeds.join(coded.select(*window, "code"), window)).drop("mask")
    listed = items.select("item", "n", F.col("code"), F.explode(F.array_distinct("hashes")).alias("shingle"))
    right = probe(listed).select("n", "shingle", "block", "value", "item", F.col("code").alias("item_code"))
    met = left.join(right, ["n", "shingle", "block", "value"])
    apart = F.col("code").bitwiseXOR(F.col("item_code"))
    first = F.array_position(F.transform(masks, lambda m: m.bitwiseAND(apart) == 0), True) - 1
    met = cut(met.filter((first == F.col("block")) & (F.bit_count(apart) <= radius)).select(*window, "item").distinct())
    both = met.join(coded.drop("code"), window).join(items.select("item", "n", F.col("hashes").alias("item_hashes")), ["item", "n"])
    scored = both.withColumn("similarity", similarity(F.col("hashes"), F.col("item_hashes"))).filter(F.col("similarity") >= least)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"))).alias("best")
    found = cut(scored.groupBy("t1", "t2", "item", "n").agg(best))
    discard(docs.sparkSession, items, wanted, known, seeds, windows, chosen, hashed, coded, met)
    return found.select("t1", "t2", "item", (-F.col("best.start")).alias("start"), F.col("n").alias("n_words"), "best.similarity")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` less every row whose text holds a benchmark item; the other rows stay as they are, whatever their columns
    are called."""
    found = leaks(docs, benchmark, **options).select("t1", "t2").distinct()
    text = F.col(options.get("text", "text"))
    packed = docs.select(F.struct("*").alias("row"), *[k.alias(f"t{i}") for i, k in enumerate(text_key(text), 1)])
    return packed.join(found, ["t1", "t2"], "left_anti").select("row.*")


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), d AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS pos FROM w WHERE len(w) >= 5
), ds AS (SELECT doc_id, len(w) AS n_all, pos, array_to_string(w[pos:pos + 4], ' ') AS s FROM d
), iw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), i AS (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS off FROM iw WHERE len(w) >= 5
), ish AS (SELECT item_id, len(w) AS n, off, array_to_string(w[off:off + 4], ' ') AS s FROM i
), win AS (
  SELECT DISTINCT doc_id, item_id, n, greatest(0, least(pos - off, n_all - n)) AS start, least(n, n_all) - 4 AS m
  FROM ds JOIN ish USING (s)
), ws AS (
  SELECT win.doc_id, win.item_id, win.n, win.start, win.m, ds.s, count(*) AS c
  FROM win JOIN ds ON ds.doc_id = win.doc_id AND ds.pos > win.start AND ds.pos <= win.start + win.m GROUP BY ALL
), ic AS (SELECT item_id, s, count(*) AS c FROM ish GROUP BY ALL
), scored AS (
  SELECT doc_id, item_id, n, start, sum(least(ws.c, ic.c)) / (any_value(m) + n - 4 - sum(least(ws.c, ic.c))) AS similarity
  FROM ws JOIN ic USING (item_id, s) GROUP BY doc_id, item_id, n, start
)
SELECT doc_id, item_id, arg_max(start, (similarity, -start))::INT AS start, any_value(n)::INT AS n_words,
  round(max(similarity), 6) AS similarity
FROM scored WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""


@query("op6_decontaminate", SQL)
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold: the best window of each."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = cut(leaks(docs, read(spark, sf_dir, "benchmark").select("item_id", "text")))
    keyed = docs.select("doc_id", *[k.alias(f"t{i}") for i, k in enumerate(text_key(F.col("text")), 1)])
    return keyed.join(found, ["t1", "t2"]).select(
        "doc_id", F.col("item").alias("item_id"), "start", "n_words", F.round("similarity", 6).alias("similarity")
    )
