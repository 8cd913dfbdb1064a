"""Mixing sources to target weights: temperature by bisection, then budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crewframe.llm.base import query, read, row_key, words
from crewframe.session import cut, discard

#: Halvings done by one job, and jobs.  A job evaluates all 2^HALVINGS exponents these halvings could visit.
HALVINGS, JOBS = 6, 5
#: bits of a document's place in a pass
HASH_BITS = 52


@dataclass(frozen=True)
class Target:
    """``budget``: tokens to serve, in sizes of the corpus.  ``entropy``: of the weights, as a share of the largest possible,
    or None.  ``repeats``: passes over a source at most.  ``block_tokens``: tokens of a block of the result."""

    budget: float = 1.0
    entropy: float | None = 0.998
    repeats: float = 4.0
    block_tokens: int = 16_384
    seed: int = 7


def exponent(sizes: DataFrame, target: Target) -> float:
    """Smallest exponent in [0, 1] whose weights have at most the target entropy and break no repetition limit.

    Entropy and the largest number of passes both fall as the exponent grows, so halving finds it; 1, the token
    shares themselves, if nothing smaller will do.  ``sizes``: (source, tokens), no zero tokens.
    """
    total, n = sizes.agg(F.sum("tokens"), F.count("*")).first()
    if not n:
        return 1.0
    low, high, steps = 0.0, 1.0, 2**HALVINGS
    share = F.col("tokens") / F.lit(float(total))
    for _ in range(JOBS):
        tried = F.explode(F.array(*[F.lit(low + (high - low) * i / steps) for i in range(steps)])).alias("a")
        powers = sizes.select(share.alias("p"), tried).withColumn("q", F.pow("p", "a"))
        sums = powers.groupBy("a").agg(
            F.sum("q").alias("z"), F.sum(F.col("q") * F.ln("p")).alias("s"), F.max(F.pow(F.col("p"), F.col("a") - 1)).alias("most")
        )
        good = F.col("most") / F.col("z") * target.budget <= target.repeats
        if target.entropy is not None:
            good &= F.ln("z") - F.col("a") * F.col("s") / F.col("z") <= target.entropy * math.log(n)
        first = sums.filter(good).agg(F.min("a")).first()[0]
        if first == low and low == 0.0:
            return 0.0
        width = (high - low) / steps
        low, high = (high - width, high) if first is None else (first - width, first)
    return high


def weights(sizes: DataFrame, target: Target) -> DataFrame:
    """(source, tokens, weight, quota, passes), one stored row per source with tokens.  Weights sum to 1."""
    some = cut(sizes.filter("tokens > 0"))
    a = exponent(some, target)
    total, z = some.agg(F.sum("tokens"), F.sum(F.pow(F.col("tokens").cast("double"), F.lit(a)))).first()
    weight = F.pow(F.col("tokens").cast("double"), F.lit(a)) / F.lit(z or 1.0)
    quota = F.floor(weight * F.lit(target.budget * (total or 0))).cast("long")
    out = some.withColumn("weight", weight).withColumn("quota", quota)
    return cut(out.withColumn("passes", F.ceil(F.col("quota") / F.col("tokens")).cast("int")))


def place(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Where a document stands in a pass: 52 bits of a hash of seed, pass and document."""
    named = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def mixture(
    docs: DataFrame, target: Target = Target(), text: str = "text", source: str = "source", doc_id: str = "doc_id"
) -> DataFrame:
    """The documents to serve, in order: (doc_id, source, n_tokens, epoch, block, position).

    Each pass (``epoch``) over a source is a permutation of its documents by a keyed hash.  A source is served pass
    after pass until its quota, its weight of the budget, is used up: the last document may go beyond it.
    ``block`` cuts the whole into equal parts of about ``block_tokens``, each with every source in its weight, and
    ``position`` orders a block by the same hash.

    Running sums are two-level: places of a pass fall into blocks of hash ranges, about as many as the square
    root of the largest source's rows, so that neither the sums of a source nor the rows of a range pile up.
    A null source is the source ''; null and empty texts have no tokens and are served with their
    neighbours; sources without any token have no weight and are not served; repeated rows count each.
    """
    sized = cut(
        docs.select(
            F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(doc_id).alias("doc_id"),
            F.size(words(F.col(text))).cast("long").alias("n_tokens"), row_key(docs).alias("row"),
        )
    )
    sizes = cut(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")))
    quotas = weights(sizes.select("source", "tokens"), target)
    rows, total = sizes.agg(F.max("n"), F.sum("tokens")).first()
    bits = math.ceil(math.log2(max(2, rows or 0)) / 2)
    n_blocks = max(1, math.ceil(target.budget * (total or 0) / target.block_tokens))

    passes = sized.join(quotas.select("source", "quota", "passes"), "source").filter("quota > 0")
    passes = passes.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    placed = passes.withColumn("h", place(target.seed, F.col("epoch"), F.col("doc_id")))
    placed = cut(placed.withColumn("range", F.shiftright("h", HASH_BITS - bits)).drop("passes"))
    sums = placed.groupBy("source", "epoch", "range").agg(F.sum("n_tokens").alias("held"))
    up_to = Window.partitionBy("source").orderBy("epoch", "range").rowsBetween(Window.unboundedPreceding, -1)
    before = cut(sums.select("source", "epoch", "range", F.coalesce(F.sum("held").over(up_to), F.lit(0)).alias("before")))

    inside = Window.partitionBy("source", "epoch", "range").orderBy("h", "doc_id", "n_tokens", "row")
    ahead = F.coalesce(F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    served = placed.join(before, ["source", "epoch", "range"]).withColumn("start", F.col("before") + ahead)
    served = served.filter("start < quota").withColumn("block", F.floor(F.col("start") / F.col("quota") * n_blocks))
    order = Window.partitionBy("block").orderBy("h", "source", "epoch", "doc_id", "n_tokens", "row")
    out = served.withColumn("position", F.row_number().over(order))
    discard(docs.sparkSession, sizes)
    return out.select("doc_id", "source", "n_tokens", "epoch", "block", "position")


def _sql(target: Target) -> str:
    """The same in SQL; the rounds of the search are written out."""
    steps = 2**HALVINGS
    parts = [
        """t AS (SELECT coalesce(source, '') AS source, doc_id, len(list_filter(string_split_regex(coalesce(text, ''),
        '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents)""",
        """s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM t GROUP BY source HAVING sum(n_tokens) > 0)""",
        """c AS (SELECT sum(tokens)::BIGINT AS total, count(*) AS n FROM s)""",
        """r0 AS (SELECT 0.0::DOUBLE AS low, 1.0::DOUBLE AS high)""",
    ]
    for k in range(1, JOBS + 1):
        parts.append(f"""g{k} AS (
        SELECT low + (high - low) * i / {steps} AS a, any_value(low) AS low, any_value(high) AS high,
          sum(pow(tokens::DOUBLE / total, low + (high - low) * i / {steps})) AS z,
          sum(pow(tokens::DOUBLE / total, low + (high - low) * i / {steps}) * ln(tokens::DOUBLE / total)) AS s,
          max(pow(tokens::DOUBLE / total, low + (high - low) * i / {steps} - 1)) AS most, any_value(n) AS n
        FROM s, c, r{k - 1}, range({steps}) AS x(i) GROUP BY 1)""")
        parts.append(f"""f{k} AS (SELECT any_value(low) AS low, any_value(high) AS high, min(a) FILTER (
          WHERE most / z * {target.budget} <= {target.repeats} AND ln(z) - a * s / z <= {target.entropy} * ln(n)) AS first FROM g{k})""")
        parts.append(f"""r{k} AS (SELECT CASE WHEN first = 0 THEN 0 WHEN first IS NULL THEN high - (high - low) / {steps}
          ELSE first - (high - low) / {steps} END AS low, CASE WHEN first IS NULL THEN high ELSE first END AS high FROM f{k})""")
    parts.append(f"""q AS (
        SELECT source, tokens, total, floor(pow(tokens::DOUBLE, high) / (SELECT sum(pow(tokens::DOUBLE, high)) FROM s, r{JOBS})
          * ({target.budget} * total))::BIGINT AS quota FROM s, c, r{JOBS})""")
    parts.append("""p AS (
        SELECT t.*, quota, total, unnest(range(ceil(quota::DOUBLE / tokens)::BIGINT)) AS epoch FROM t JOIN q USING (source))""")
    parts.append(f"""h AS (
        SELECT *, ('0x' || substr(md5(concat_ws(':', '{target.seed}', epoch::VARCHAR, doc_id::VARCHAR)), 1, 13))::BIGINT AS h FROM p)""")
    parts.append("""o AS (
        SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY epoch, h, doc_id) - n_tokens AS start FROM h)""")
    parts.append(f"""b AS (
        SELECT *, floor(start::DOUBLE / quota * greatest(1, ceil({target.budget} * total / {target.block_tokens}.0)))::BIGINT AS block
        FROM o WHERE start < quota)""")
    return "WITH " + ",\n".join(parts) + """
    SELECT doc_id, source, n_tokens, epoch::INT AS epoch, block,
      row_number() OVER (PARTITION BY block ORDER BY h, source, epoch, doc_id)::INT AS position FROM b"""


@query("op2_mixing", _sql(Target()))
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents."""
    return mixture(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
