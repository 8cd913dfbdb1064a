"""Exact nearest neighbours of binary codes by incremental multi-index hashing."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crewframe.llm.base import query, read
from crewframe.session import cut, discard

BITS = 64
#: every row whose id is divisible by this is a query
EVERY = 50


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """Bit i is set where component i is above zero; a null vector, a short one or NaN components leave bits unset.

    A vector with more than ``bits`` components has no code of that size: the query ends with an error that says so.
    """
    def bit(i: int) -> Column:
        at = F.get(vector, F.lit(i))
        on = F.coalesce((at > 0) & ~F.isnan(at), F.lit(False))
        value = 1 << i if i < 63 else -(1 << 63)
        return F.when(on, F.lit(value).cast("long")).otherwise(F.lit(0).cast("long"))

    out = bit(0)
    for i in range(1, bits):
        out = out.bitwiseOR(bit(i))
    longer = F.raise_error(F.concat(F.size(vector).cast("string"), F.lit(f" components, a code holds {bits}")))
    return F.when(F.size(vector) > bits, longer.cast("long")).otherwise(out)


def segment_edges(segments: int) -> list[int]:
    return [round(i * BITS / segments) for i in range(segments + 1)]


def segment(code: Column, low: int, high: int) -> Column:
    mask = (1 << (high - low)) - 1
    return F.shiftrightunsigned(code, low).bitwiseAND(F.lit(mask).cast("long"))


def flips(width: int, ones: int) -> Column:
    """All values of ``width`` bits with ``ones`` of them set, as one constant that is folded into the plan."""
    listed = ",".join(str(sum(1 << b for b in chosen)) for chosen in combinations(range(width), ones))
    return F.split(F.lit(listed), ",").cast("array<long>")


#: Segments of a code: 16 bits each, about the logarithm of 10^4 to 10^6 codes; fewer segments suit larger tables.
SEGMENTS = 4


def top_k(rows: DataFrame, k: int = 10, every: int = EVERY, segments: int = SEGMENTS) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the ``k`` nearest other rows of each query by (distance, id).

    ``rows``: (id, code).  Queries are the rows whose id is divisible by ``every``; rows with a null id are neither.
    A row that repeats an id stands once.  Fewer than ``k`` other rows give fewer neighbours.

    Equal codes are one entry of the index with their ``k`` + 1 smallest ids, and equal queries ask once, so a
    common vector costs no more than a rare one.  Codes are cut into m ``segments``, each an index by value.
    Round s probes, for the queries still open, all segment values at exactly s flipped bits.  After it every
    code closer than m (s + 1) has been met, for at least one of its segments differs in s bits or fewer.  A query
    closes when its kth verified distance is below that, and at the latest when s has reached the segment's width.
    """
    spark = rows.sparkSession
    rows = cut(rows.filter(F.col("id").isNotNull()).distinct())
    smallest = Window.partitionBy("code").orderBy("id")
    ids = rows.withColumn("place", F.row_number().over(smallest)).filter(F.col("place") <= k + 1)
    codes = cut(ids.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = cut(rows.filter(F.col("id") % every == 0))
    m = segments
    edges = segment_edges(m)
    spans = list(zip(edges, edges[1:], strict=False))

    def parts(code: Column) -> Column:
        return F.array(*[F.struct(F.lit(j).alias("j"), segment(code, a, b).alias("value")) for j, (a, b) in enumerate(spans)])

    index = cut(
        codes.select("code", F.size("ids").alias("held"), F.get("ids", F.lit(0)).alias("first_id"), F.explode(parts(F.col("code"))).alias("at")).select(
            "code", "held", "first_id", "at.j", "at.value"
        )
    )
    open_queries = cut(asked.select(F.col("code").alias("q")).distinct())
    best, closed = None, []
    for s in range(max(b - a for a, b in spans) + 1):
        probes = None
        for j, (a, b) in enumerate(spans):
            if s > b - a:
                continue
            masks = F.explode(flips(b - a, s)).alias("flip")
            own = open_queries.select("q", F.lit(j).alias("j"), segment(F.col("q"), a, b).alias("home"), masks)
            own = own.select("q", "j", F.col("home").bitwiseXOR(F.col("flip")).alias("value"))
            probes = own if probes is None else probes.unionByName(own)
        # merged, as the planner can't see how many probes the flips make and would broadcast them
        met = probes.hint("merge").join(index, ["j", "value"]).select("q", "j", "code", "held", "first_id")
        apart = F.array(*[F.bit_count(segment(F.col("q").bitwiseXOR(F.col("code")), a, b)) for a, b in spans])
        # a code is met at its nearest segment, the first of them: each pair comes out once in all rounds
        met = met.withColumn("apart", apart).filter((F.array_min("apart") == s) & (F.array_position("apart", s) == F.col("j") + 1))
        met = met.select("q", "code", "held", "first_id", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).alias("distance"))
        if best is not None:
            met = met.unionByName(best.join(open_queries, "q", "left_semi"))
        # each code has an id, so later ones than the first k + 1 by (distance, smallest id) add nothing
        order = Window.partitionBy("q").orderBy("distance", "first_id")
        near = Window.partitionBy("q").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)
        kept = met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1).drop("place")
        kept = kept.withColumn("ahead", F.coalesce(F.sum("held").over(near), F.lit(0))).filter(F.col("ahead") <= k)
        kept = cut(kept.drop("ahead"))
        filled = kept.groupBy("q").agg(F.sum("held").alias("held"), F.max("distance").alias("kth"))
        sure = m * (s + 1) - 1 if s < max(b - a for a, b in spans) else BITS
        done = filled.filter((F.col("held") > k) & (F.col("kth") <= sure)) if sure < BITS else filled
        done = cut(done.select("q"))
        closed.append(cut(kept.join(done, "q", "left_semi")))
        still = cut(open_queries.join(done, "q", "left_anti"))
        discard(spark, open_queries, *([best] if best is not None else []))
        best, open_queries = kept, still
        if open_queries.isEmpty():
            break
    found = closed[0]
    for part in closed[1:]:
        found = found.unionByName(part)
    pairs = asked.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(found, "q").join(codes, "code")
    pairs = pairs.select("query_id", "distance", F.explode("ids").alias("neighbor_id")).filter("neighbor_id <> query_id")
    rank = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    ranked = pairs.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "neighbor_id", F.col("distance").cast("int").alias("distance"))


SQL = f"""
WITH c AS (
  SELECT vec_id AS id, list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0
    AND NOT isnan(embedding[i + 1]) THEN (1::UBIGINT << i::UBIGINT) ELSE 0::UBIGINT END))::UBIGINT AS code FROM embeddings
), p AS (
  SELECT q.id AS query_id, c.id AS neighbor_id, bit_count(xor(q.code, c.code)::BIT)::INT AS distance
  FROM c AS q JOIN c ON c.id <> q.id WHERE q.id % {EVERY} = 0
)
SELECT query_id, (row_number() OVER w)::INT AS rank, neighbor_id, distance FROM p
WINDOW w AS (PARTITION BY query_id ORDER BY distance, neighbor_id) QUALIFY rank <= 10
"""


@query("op5_hamming_search", SQL)
def op5_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors by sign code of every fiftieth vector."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    return top_k(rows)
