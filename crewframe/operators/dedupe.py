"""Merge candidate records that share an e-mail, phone or profile link.

A record starts a profile exactly when none of its keys is held by an *earlier record that
starts a profile*; every other record joins the starter that holds its e-mail, else its phone,
else its link.  Keys a profile picks up later from its members do not attract further records.
So the starters are the order-first independent set of the graph "shares a key", and they are
found in rounds:

1. per key, the first undecided record that holds it (a combining minimum);
2. a record that is first for all its keys starts a profile and owns them;
3. records that hold an owned key are decided and leave.

A record is identified by its arrival, its id and a hash of the rest, in that order, so records that arrive
at the same instant are told apart; records alike in everything are one for this purpose and stay together.
After PEELED rounds only records are open that wait for others in long rows, and those are contracted:
let u(key, record) say that no starter before the record holds the key.  A record starts a profile when all
its u are true, so u(key, next holder) = u(key, holder) and not all other u of the holder.  This is a network of
small gates.  Each round puts what is known into them; a gate with one open input is a copy of it or its opposite,
and copies of copies are followed two by two, so a row of n records that wait for each other takes log2(n)
rounds.  Only gates that still have two open inputs wait for the rounds before.

Each round shuffles (record, key) rows only, never gathers the rows of a key, stores what is open and drops
the table before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewframe.operators.sequences import successive_pairs
from crewframe.session import cut, discard

#: rounds that settle what waits for nothing, before the rest is contracted
PEELED = 2
#: the truth value true; a number is an input, its negative the opposite
TRUE = (1 << 63) - 1


def _who() -> Column:
    return F.struct("arrival", "candidate_id", F.xxhash64("full_name", "email", "phone", "linkedin_url", "source").alias("tie"))


def _text(df: DataFrame, names: list[str]) -> Column:
    present = [F.when(F.col(n).cast("string") != "", F.col(n).cast("string")) for n in names if n in df.columns]
    return F.coalesce(*present, F.lit(""))


def normalise_candidates(df: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Cleaned identity columns: e-mail lower-cased, phone digits only, link without last slash."""
    pair = F.concat_ws(" ", _text(df, ["first_name"]), _text(df, ["last_name"]))
    name, ident, source = _text(df, ["full_name"]), _text(df, ["id", "candidate_id"]), _text(df, ["source", "channel"])
    return df.select(
        F.col(arrival).alias("arrival"),
        F.when(ident == "", F.lit("CAND-0")).otherwise(ident).alias("candidate_id"),
        F.trim(F.when(name == "", pair).otherwise(name)).alias("full_name"),
        F.lower(F.trim(_text(df, ["email"]))).alias("email"),
        F.regexp_replace(_text(df, ["phone"]), r"(?U)\D", "").alias("phone"),
        F.regexp_replace(F.lower(_text(df, ["linkedin_url", "linkedin"])), "/+$", "").alias("linkedin_url"),
        F.when(source == "", F.lit("DIRECT_PORTAL")).otherwise(source).alias("source"),
    )


def _key_rows(candidates: DataFrame) -> DataFrame:
    """(who, key, priority, n_keys): the distinct keys of a record in one untyped namespace."""
    filled = F.array_distinct(F.filter(F.array("email", "phone", "linkedin_url"), lambda key: key != ""))
    return (
        candidates.select(_who().alias("who"), filled.alias("_keys"))
        .distinct()
        .select("who", F.size("_keys").alias("n_keys"), F.posexplode("_keys").alias("priority", "key"))
    )


def profile_owners(key_rows: DataFrame) -> DataFrame:
    """(key, starter): which profile-starting record owns a key."""
    spark = key_rows.sparkSession
    left = cut(key_rows.select("who", "n_keys", "key"))
    owners = []
    remaining = left.count()
    for _ in range(PEELED):
        if not remaining:
            break
        first = left.groupBy("key").agg(F.min(F.struct("who", "n_keys")).alias("_first"))
        # a record has at most three keys, so this grouping has no hot key
        starters = (
            first.groupBy(F.col("_first.who").alias("starter"), F.col("_first.n_keys").alias("n_keys"))
            .agg(F.collect_list("key").alias("_keys"))
            .filter(F.size("_keys") == F.col("n_keys"))
        )
        owned = cut(starters.select(F.explode("_keys").alias("key"), "starter"))
        owners.append(owned)
        # both sides of this join come from stored tables: a hot key is split by the adaptive join
        decided = left.join(owned, "key").select("who").distinct()
        rest = cut(left.join(decided, "who", "left_anti"))
        remaining = rest.count()
        discard(spark, left)
        left = rest
    if remaining:
        owners.append(_contracted(left))
    if not owners:
        return left.select("key", F.col("who").alias("starter"))
    found = cut(spark.read.schema(owners[0].schema).parquet(*[o.stored_at for o in owners]))
    discard(spark, left, *owners)
    return found


def _settled(p: Column, n1: Column, n2: Column) -> Column:
    """What ``p and not (n1 and n2)`` is, as a number, or null while two inputs are open.  A missing n is true."""
    first, second = F.coalesce(n1, F.lit(TRUE)), F.coalesce(n2, F.lit(TRUE))
    # what is not p's own value matters only where p holds
    first = F.when(first == p, F.lit(TRUE)).when(first == -p, F.lit(-TRUE)).otherwise(first)
    second = F.when(second == p, F.lit(TRUE)).when(second == -p, F.lit(-TRUE)).otherwise(second)
    second = F.when(second == first, F.lit(TRUE)).otherwise(second)
    both = (
        F.when((first == -TRUE) | (second == -TRUE) | (first == -second), F.lit(-TRUE))
        .when(first == TRUE, second).when(second == TRUE, first)
    )
    return (
        F.when((p == -TRUE) | (both == TRUE), F.lit(-TRUE))
        .when(both == -TRUE, p)
        .when(p == TRUE, -both)
    )


def _contracted(left: DataFrame) -> DataFrame:
    """(key, starter), stored, of the open records ``left`` (who, n_keys, key)."""
    spark = left.sparkSession
    inputs = cut(left.select("who", "key", (F.monotonically_increasing_id() + 1).alias("id")))
    pairs = successive_pairs(inputs, ["key"], "who", "id").select(
        F.col("cur.id").alias("id"), F.col("prev.id").alias("p"), F.col("prev.who").alias("who")
    )
    # a record has at most three keys
    held = inputs.groupBy("who").agg(F.collect_list("id").alias("ids"))
    others = F.filter("ids", lambda i: i != F.col("p"))
    gates = pairs.join(held, "who").select("id", "p", F.get(others, F.lit(0)).alias("n1"), F.get(others, F.lit(1)).alias("n2"))
    firsts = inputs.select("id").join(pairs.select("id"), "id", "left_anti")
    opened = firsts.select("id", F.lit(TRUE).alias("p"), F.lit(-TRUE).alias("n1"), F.lit(None).cast("long").alias("n2"))
    state = cut(gates.unionByName(opened).withColumn("value", _settled(F.col("p"), F.col("n1"), F.col("n2"))))
    while True:
        open_ = F.col("value").isNull() | (F.abs("value") < TRUE)
        if state.filter(open_).isEmpty():
            break
        known = state.filter("value is not null").select(F.col("id").alias("of"), F.col("value").alias("is"))
        copies = F.col("value").isNotNull()
        asked = F.when(copies, F.array(F.struct(F.lit(0).alias("slot"), F.col("value").alias("v")))).otherwise(
            F.array(*[F.struct(F.lit(i).alias("slot"), F.col(c).alias("v")) for i, c in enumerate(("p", "n1", "n2"))])
        )
        asks = state.filter(open_).select("id", copies.alias("copy"), F.explode(asked).alias("ask")).select("id", "copy", "ask.*")
        asks = asks.filter("v is not null")
        through = F.when(F.abs("v") == TRUE, F.col("v")).when(F.col("is").isNull(), F.col("v"))
        through = through.otherwise(F.when(F.col("v") > 0, F.col("is")).otherwise(-F.col("is")))
        answered = asks.join(known, F.abs("v") == F.col("of"), "left").select("id", "copy", "slot", through.alias("v"))
        slot = lambda i: F.max(F.when(F.col("slot") == i, F.col("v")))
        rows = answered.groupBy("id", "copy").agg(slot(0).alias("p"), slot(1).alias("n1"), slot(2).alias("n2"))
        value = F.when(F.col("copy"), F.col("p")).otherwise(_settled(F.col("p"), F.col("n1"), F.col("n2")))
        after = cut(rows.select("id", "p", "n1", "n2", value.alias("value")).unionByName(state.filter(~open_)))
        discard(spark, state)
        state = after
    free = inputs.join(state.select("id", "value"), "id").groupBy("who").agg(
        F.min(F.col("value") == TRUE).alias("starts"), F.collect_list("key").alias("keys")
    )
    owned = cut(free.filter("starts").select(F.explode("keys").alias("key"), F.col("who").alias("starter")))
    discard(spark, inputs, state)
    return owned


def dedupe_members(candidates: DataFrame) -> DataFrame:
    """Every kept record with the record that starts its profile (``starter``).

    Records without any key are kept once per id, the last one.
    """
    candidates = candidates.withColumn("who", _who())
    keys = cut(_key_rows(candidates))
    owners = profile_owners(keys)
    joined = (
        keys.join(owners, "key")
        .filter(F.col("starter") <= F.col("who"))
        .groupBy("who")
        .agg(F.min_by("starter", "priority").alias("starter"))
    )
    with_key = candidates.join(joined, "who")
    bare = candidates.filter((F.col("email") == "") & (F.col("phone") == "") & (F.col("linkedin_url") == ""))
    last = bare.groupBy("candidate_id").agg(F.max("who").alias("who")).select("who")
    without_key = bare.join(last, "who", "left_semi").dropDuplicates(["who"]).withColumn("starter", F.col("who"))
    return with_key.unionByName(without_key)


def merged_profiles(members: DataFrame) -> DataFrame:
    """One row per profile.  All aggregates combine on the map side, so a profile of any size is
    one buffer; the merged ids stay in long form (:func:`merged_ids`)."""
    main = members.groupBy("starter").agg(
        F.min_by(F.struct("candidate_id", "full_name", "email"), "who").alias("_head"),
        F.min_by("phone", F.when(F.col("phone") != "", F.col("who"))).alias("phone"),
        F.min_by("linkedin_url", F.when(F.col("linkedin_url") != "", F.col("who"))).alias("linkedin_url"),
        F.count("*").alias("application_count"),
    )
    # one row per channel of a profile before the list is built
    channels = (
        members.groupBy("starter", "source")
        .agg(F.min("who").alias("_at"))
        .groupBy("starter")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "source")))["source"].alias("merged_source_channels"))
    )
    return main.join(channels, "starter").select(
        F.col("starter.arrival").alias("arrival"),
        F.col("_head.candidate_id").alias("primary_id"),
        F.col("_head.full_name").alias("full_name"),
        F.col("_head.email").alias("email"),
        "phone",
        "linkedin_url",
        "merged_source_channels",
        "application_count",
    )


def merged_ids(members: DataFrame) -> DataFrame:
    """(profile, candidate_id) with the first arrival of each id, to be read in that order."""
    return members.groupBy(F.col("starter").alias("_profile"), "candidate_id").agg(F.min("arrival").alias("first_arrival")).select(
        F.col("_profile.arrival").alias("profile"), "candidate_id", "first_arrival"
    )


def dedupe_candidates(df: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Merged candidate profiles of raw candidate rows."""
    return merged_profiles(dedupe_members(normalise_candidates(df, arrival)))
