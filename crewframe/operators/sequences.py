"""Successive rows of one key, without ever sorting a whole key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crewframe.session import cut, discard


def successive_pairs(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """(keys, prev struct, cur struct) for each row and the row before it in (time, tie) order.

    A key, or one instant of it, may hold any share of the data, so rows are sorted over the whole cluster: each
    task has a range of (keys, time, tie), stored with the task's number.  Windows run per range; each range then
    hands its last row to the next, in a window that sees one row per task.
    """
    values = [c for c in df.columns if c not in keys]
    laid = df.filter(F.col(time).isNotNull()).select(
        *keys, F.struct(time, tie, *[v for v in values if v not in (time, tie)]).alias("cur")
    )
    order = [*keys, "cur"]
    ranges = cut(laid.repartitionByRange(*order).select(*order, F.spark_partition_id().alias("_range")))
    row = F.struct(*order)
    ends = ranges.groupBy("_range").agg(F.max(row).alias("_end"))
    prior = F.lag("_end").over(Window.orderBy("_range"))  # one row per task
    carried = F.broadcast(ends.select("_range", prior.alias("_prior")))
    before = F.lag(row).over(Window.partitionBy("_range").orderBy(*order))
    paired = ranges.withColumn("_before", before).join(carried, "_range")
    paired = paired.withColumn("_before", F.coalesce("_before", "_prior"))
    same = F.lit(True)
    for key in keys:
        same = same & F.col(f"_before.{key}").eqNullSafe(F.col(key))
    return paired.filter(F.col("_before").isNotNull() & same).select(*keys, F.col("_before.cur").alias("prev"), "cur")


def sessions(df: DataFrame, keys: list[str], time: str, tie: str, gap_seconds: float) -> DataFrame:
    """Rows that open a session: no row of the same key less than ``gap_seconds`` before."""
    pairs = successive_pairs(df, keys, time, tie)
    far = (F.unix_micros(F.col("cur")[time]) - F.unix_micros(F.col("prev")[time])) >= int(gap_seconds * 1_000_000)
    opened = pairs.filter(far).select(*keys, F.col("cur")[time].alias("opens_at"))
    first = df.groupBy(*keys).agg(F.min(time).alias("opens_at"))
    return opened.unionByName(first)


def nearest_marks(marks: DataFrame, asks: DataFrame, keys: list[str], at: str, before: bool = False) -> DataFrame:
    """``asks`` with ``mark``: the row of ``marks`` of the same key that is nearest at or after the ask's ``at``, or with
    ``before`` nearest before it, as struct of ``at`` and the other columns of ``marks``.

    Marks and asks are sorted together over the whole cluster, so a key, or a burst of it, spreads over tasks.  Windows run
    within a range; each range then hands its nearest mark to the ranges beyond, in a window that sees
    one row per task.  Asks that have no such mark are dropped.
    """
    asked = [c for c in asks.columns if c not in keys and c != at]
    told = [c for c in marks.columns if c not in keys and c != at]
    mark = F.struct(*keys, F.col(at).alias("_at"), *told)
    none = marks.select(mark.alias("_mark")).schema["_mark"].dataType
    given = F.struct(*asked) if asked else F.struct(F.lit(True).alias("_"))
    blank = asks.select(given.alias("_ask")).schema["_ask"].dataType
    # an ask sorts before a mark at the same place, so an equal mark is after it; the last key deals out rows that are alike
    both = marks.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), mark.alias("_mark"), F.lit(None).cast(blank).alias("_ask"))
    both = both.unionByName(asks.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(none).alias("_mark"), given.alias("_ask")))
    order = [*keys, "_at", "_kind", "_row"]
    laid = both.withColumn("_row", F.monotonically_increasing_id())
    ranges = cut(laid.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    turned = (lambda c: F.asc(c)) if before else (lambda c: F.desc(c))
    passed = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    place = F.when(F.col("_kind") == 1, F.struct(*order))
    pick = F.max_by if before else F.min_by
    heads = ranges.groupBy("_range").agg(pick("_mark", place).alias("_head"))
    carried = F.last("_head", ignorenulls=True).over(passed(Window.orderBy(turned("_range"))))  # one row per task
    carried = F.broadcast(heads.select("_range", carried.alias("_beyond")))
    within = passed(Window.partitionBy("_range").orderBy(*[turned(c) for c in order]))
    found = ranges.withColumn("_here", F.last("_mark", ignorenulls=True).over(within)).join(carried, "_range")
    found = found.filter("_kind = 0").withColumn("_near", F.coalesce("_here", "_beyond"))
    same = F.col("_near").isNotNull()
    for key in keys:
        same = same & F.col(f"_near.{key}").eqNullSafe(F.col(key))
    near = F.struct(F.col("_near._at").alias(at), *[F.col(f"_near.{c}").alias(c) for c in told])
    return found.filter(same).select(
        *keys, F.col("_at").alias(at), *[F.col(f"_ask.{n}").alias(n) for n in asked], near.alias("mark")
    )


def reached(firsts: DataFrame, steps: DataFrame, keys: list[str], t: str = "t", nxt: str = "nxt") -> DataFrame:
    """(keys, t): the places that jumps ``steps`` (keys, t, nxt) reach from ``firsts`` (keys, t), those included.

    The jumps are doubled per round: from the first 2**i places of a run those of 2**i reach the next 2**i, so a run of n
    places takes log2(n) rounds and nothing is reached twice.  A place has one jump, and jumps lead onwards.
    """
    spark = steps.sparkSession
    kept, steps = cut(firsts.select(*keys, t)), cut(steps.select(*keys, t, nxt))
    while True:
        fresh = cut(steps.join(kept, [*keys, t], "left_semi").select(*keys, F.col(nxt).alias(t)))
        if fresh.isEmpty():
            discard(spark, steps, fresh)
            return kept
        kept = kept.unionByName(fresh)
        onward = steps.select(*keys, F.col(t).alias(nxt), F.col(nxt).alias("_far"))
        before, steps = steps, cut(steps.join(onward, [*keys, nxt]).select(*keys, t, F.col("_far").alias(nxt)))
        discard(spark, before)
