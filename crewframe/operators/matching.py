"""Match profiled host fields to canonical fields.

Targets of an entity are served in their fixed order and each host field once.  Scoring is a
join with the constant spec; only the best few candidates per target can ever matter, because
the targets before it use at most ``REACH`` host fields.  The ordered pass then runs as one
expression over that short list.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewframe import refdata
from crewframe.operators.mapping import FieldRule, Mapping

#: rules of one mapping that may come to the driver
MAPPED = 10_000
SPEC = refdata.canonical_spec()
ENTITIES = sorted({row["entity"] for row in SPEC})
# no entity has more targets than this, and one of them may use two fields: exact while no more than one does
REACH = max(sum(row["entity"] == entity for row in SPEC) for entity in ENTITIES) + 1
assert all(sum(bool(row["compound"]) for row in SPEC if row["entity"] == entity) <= 1 for entity in ENTITIES)

_SPEC_FIELDS = (
    "entity:string,target:string,position:int,transform:string,synonyms:array<string>,compound:array<string>,"
    "required:boolean,default:string,enum_keys:array<string>,enum_values:array<string>"
)
_PICK = (
    "struct<target:string,position:int,source:array<string>,confidence:double,transform:string,rationale:string,"
    "is_required:boolean,default:string,enum_map:map<string,string>>"
)


def canonical_spec(spark) -> DataFrame:
    """The constant matching spec as a relation."""
    names = [part.split(":")[0] for part in _SPEC_FIELDS.split(",")]
    kinds = ", ".join(f"`{part.split(':')[0]}` {part.split(':')[1]}" for part in _SPEC_FIELDS.split(","))
    return spark.createDataFrame([tuple(row[n] for n in names) for row in refdata.canonical_spec()], kinds)


def spec_of(entity: Column) -> Column:
    """The targets of an entity as an array: a constant that is folded into the plan, so bringing
    the spec to the fields takes no join."""
    by_entity: dict = {}
    for row in refdata.canonical_spec():
        by_entity.setdefault(row["entity"], []).append(row)
    spec = F.from_json(F.lit(json.dumps(by_entity)), f"map<string,array<struct<{_SPEC_FIELDS}>>>")
    return F.try_element_at(spec, F.upper(entity))


def normalised(name: Column) -> Column:
    """Lower-case letters and digits only; camel case and snake case meet here."""
    return F.regexp_replace(F.lower(name), r"(?U)[\W_]+", "")


def align_enums(host_values: Column, keys: Column, values: Column) -> Column:
    """map<host value, canonical value>: equal after trim/upper, else the first key that contains
    or is contained."""

    def canonical(host: Column) -> Column:
        upper = F.upper(F.trim(host))
        exact = F.array_position(keys, upper)
        near = F.filter(F.sequence(F.lit(1), F.size(keys)), lambda i: _near(upper, i))
        index = F.when(exact > 0, exact.cast("int")).otherwise(F.get(near, F.lit(0)))
        return F.struct(host.alias("key"), F.get(values, index - 1).alias("value"))

    def _near(upper: Column, index: Column) -> Column:
        key = F.get(keys, index - 1)
        return F.contains(upper, key) | F.contains(key, upper)

    pairs = F.filter(F.transform(host_values, canonical), lambda pair: pair["value"].isNotNull())
    empty = F.create_map().cast("map<string,string>")
    return F.when((F.size(keys) > 0) & (F.size(host_values) > 0), F.map_from_entries(pairs)).otherwise(empty)


def _single_candidates(profile: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """Scored (host field, target) candidates; level 2 synonym, 3 normalised, 4 substring."""
    host, lower = F.col("field"), F.lower(F.col("field"))
    lowered = F.transform("synonyms", lambda s: F.lower(s))
    norms = F.transform("synonyms", normalised)
    exact = F.array_position(lowered, lower)
    norm = normalised(host)
    norm_at = F.array_position(norms, norm)
    inside = F.filter(
        F.sequence(F.lit(1), F.size("synonyms")),
        lambda i: (F.contains(lower, F.get(lowered, i - 1)) | F.contains(F.get(lowered, i - 1), lower))
        & (F.length(F.get(lowered, i - 1)) >= 4)
        & (F.length(lower) >= 4),
    )
    inside_at = F.get(inside, F.lit(0))

    def scored(level: int, order: Column, confidence: Column, rationale: Column) -> Column:
        return F.struct(
            F.lit(level).alias("level"), order.cast("int").alias("order"), confidence.cast("double").alias("confidence"),
            rationale.alias("rationale"),
        )

    best = (
        F.when(
            exact > 0,
            scored(
                2, exact, F.when(lower == F.lower("target"), 1.0).otherwise(0.95),
                F.concat(F.lit("Exact match on synonym '"), F.get("synonyms", exact.cast("int") - 1), F.lit("'")),
            ),
        )
        .when(
            norm == normalised(F.col("target")),
            scored(3, F.lit(0), F.lit(0.90), F.lit("Normalized token equivalence")),
        )
        .when(
            norm_at > 0,
            scored(
                3, F.lit(0), F.lit(0.85),
                F.concat(F.lit("Normalized match on synonym '"), F.get("synonyms", norm_at.cast("int") - 1), F.lit("'")),
            ),
        )
        .when(
            inside_at.isNotNull(),
            scored(
                4, F.lit(0), F.lit(0.75),
                F.concat(F.lit("Substring match on '"), F.get("synonyms", inside_at - 1), F.lit("'")),
            ),
        )
    )
    return (
        profile.select(*keys, "field", "enum_values_host", F.inline(spec_of(F.col(entity))))
        .withColumn("_best", best)
        .filter(F.col("_best").isNotNull())
        .select(
            *keys,
            "target",
            "position",
            F.col("_best.level").alias("level"),
            F.col("_best.order").alias("order"),
            host.alias("host"),
            F.array(host).alias("source"),
            F.col("_best.confidence").alias("confidence"),
            "transform",
            F.col("_best.rationale").alias("rationale"),
            F.col("required").alias("is_required"),
            F.col("default"),
            align_enums(F.col("enum_values_host"), F.col("enum_keys"), F.col("enum_values")).alias("enum_map"),
        )
    )


def _compound_candidates(profile: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """Pairs of name parts for targets that may be built from two fields."""
    norm = normalised(F.col("field"))

    def part(index: int) -> Column:
        others = F.array(*[normalised(F.lit(s)) for s in refdata.NAME_PART_SYNONYMS[index]])
        names = F.concat(F.array(normalised(F.get("compound", F.lit(index)))), others)
        at = F.array_position(names, norm)
        return F.min(F.when(at > 0, F.struct(at.alias("at"), F.col("field").alias("name"))))["name"]

    return (
        profile.select(*keys, "field", F.inline(spec_of(F.col(entity))))
        .filter(F.size("compound") == 2)
        .groupBy(*keys, "target", "position", "required", "default")
        .agg(part(0).alias("_a"), part(1).alias("_b"), F.max(F.col("field") == F.col("target")).alias("_direct"))
        .filter(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col("_direct"))
        .select(
            *keys,
            "target",
            "position",
            F.lit(1).alias("level"),
            F.lit(0).alias("order"),
            F.lit("").alias("host"),
            F.array("_a", "_b").alias("source"),
            F.lit(0.95).alias("confidence"),
            F.lit("join_names").alias("transform"),
            F.concat(F.lit("Compound fields ("), "_a", F.lit(" + "), "_b", F.lit(")")).alias("rationale"),
            F.col("required").alias("is_required"),
            "default",
            F.create_map().cast("map<string,string>").alias("enum_map"),
        )
    )


def _in_order(candidates: Column) -> Column:
    """Serve the sorted candidates: first free one per target; a pair does not ask who is free."""
    start = F.struct(
        F.array().cast("array<string>").alias("used"),
        F.lit(-1).alias("done"),
        F.array().cast(f"array<{_PICK}>").alias("picks"),
    )

    def step(state: Column, cand: Column) -> Column:
        free = (cand["level"] == 1) | ~F.array_contains(state["used"], cand["host"])
        take = (cand["position"] != state["done"]) & free
        pick = F.struct(
            cand["target"].alias("target"), cand["position"].alias("position"), cand["source"].alias("source"),
            cand["confidence"].alias("confidence"), cand["transform"].alias("transform"),
            cand["rationale"].alias("rationale"), cand["is_required"].alias("is_required"),
            cand["default"].alias("default"), cand["enum_map"].alias("enum_map"),
        ).cast(_PICK)
        return F.when(
            take,
            F.struct(
                F.concat(state["used"], cand["source"]).alias("used"),
                cand["position"].alias("done"),
                F.concat(state["picks"], F.array(pick)).alias("picks"),
            ),
        ).otherwise(state)

    return F.aggregate(candidates, start, step, lambda state: state["picks"])


def spec_from_profile(profile: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one mapping rows for an entity without a canonical spec."""
    transform = (
        F.when(F.col("data_type") == "integer", F.lit("int"))
        .when(F.col("data_type") == "number", F.lit("decimal"))
        .when(F.col("data_type").isin("date", "datetime"), F.col("data_type"))
        .when(F.col("data_type") == "boolean", F.lit("bool"))
        .otherwise(F.lit("strip"))
    )
    return profile.select(
        *keys,
        F.col("field").alias("target"),
        F.lit(None).cast("int").alias("position"),
        F.array("field").alias("source"),
        F.lit(1.0).alias("confidence"),
        transform.alias("transform"),
        F.concat(F.lit("Exact match on synonym '"), F.col("field"), F.lit("'")).alias("rationale"),
        F.col("is_required").alias("is_required"),
        F.lit(None).cast("string").alias("default"),
        F.create_map().cast("map<string,string>").alias("enum_map"),
        F.lit(True).alias("writeback"),
    )


def match_fields(profile: DataFrame, keys: list[str], entity: str = "entity_type") -> DataFrame:
    """Mapping rows per key group: target, source fields, transform, confidence, enum map, writeback."""
    known = F.upper(F.col(entity)).isin(ENTITIES)
    rows = profile.filter(known).withColumnRenamed("enum_values", "enum_values_host")
    single = _single_candidates(rows, keys, entity)
    # row_number <= k is cut down inside each map task before anything is shuffled
    best = Window.partitionBy(*keys, "target").orderBy("level", "order", "host")
    single = single.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= REACH).drop("_n")
    pairs = _compound_candidates(rows, keys, entity)
    listed = [
        "position", "level", "order", "host", "target", "source", "confidence", "transform", "rationale",
        "is_required", "default", "enum_map",
    ]
    # a map cannot be sorted: sort by the leading fields only
    by_rank = lambda a, b: (
        F.when(_rank(a) < _rank(b), -1).when(_rank(a) > _rank(b), 1).otherwise(0)
    )
    picked = (
        single.unionByName(pairs)
        .groupBy(*keys)
        .agg(F.collect_list(F.struct(*listed)).alias("_all"))
        .select(*keys, F.inline(_in_order(F.array_sort("_all", by_rank))))
        .withColumn("writeback", (F.col("confidence") >= 0.8) & (F.size("source") == 1))
    )
    return picked.unionByName(spec_from_profile(profile.filter(~known), keys))


def _rank(row: Column) -> Column:
    return F.struct(row["position"], row["level"], row["order"], row["host"])


def match_report(profile: DataFrame, matches: DataFrame, keys: list[str], entity: str = "entity_type") -> DataFrame:
    """Average confidence, unmapped targets, number of unmapped host fields and of write paths."""
    mapped = matches.groupBy(*keys).agg(
        F.round(F.avg("confidence"), 3).alias("average_confidence"),
        F.count("*").alias("mapped_count"),
        F.count_if("writeback").alias("writeback_count"),
        # at most the targets of one entity where a spec exists
        F.collect_set(F.when(F.col("position").isNotNull(), F.col("target"))).alias("_targets"),
    )
    hosts = profile.groupBy(*keys).agg(F.count("*").alias("host_fields"))
    used = unmapped_host_fields(profile, matches, keys).groupBy(*keys).agg(F.count("*").alias("_free"))
    wanted = spec_of(F.col(entity))["target"]
    return (
        hosts.join(mapped, keys, "left")
        .join(used, keys, "left")
        .select(
            *keys,
            F.coalesce("average_confidence", F.lit(0.0)).alias("average_confidence"),
            F.coalesce("mapped_count", F.lit(0)).alias("mapped_count"),
            F.coalesce(
                F.array_except(wanted, F.coalesce("_targets", F.array().cast("array<string>"))),
                F.array().cast("array<string>"),
            ).alias("unmapped_canonical_fields"),
            F.coalesce("_free", F.lit(0)).alias("unmapped_host_count"),
            F.coalesce("writeback_count", F.lit(0)).alias("writeback_count"),
        )
    )


def unmapped_host_fields(profile: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field) of host fields no target uses."""
    used = matches.select(*keys, F.explode("source").alias("field"))
    return profile.select(*keys, "field").join(used, [*keys, "field"], "left_anti")


def id_paths(profile: DataFrame, picked: DataFrame, keys: list[str], entity: str = "entity_type") -> DataFrame:
    """Id path per group: the picked field, else id, code, {entity}_id, {entity}Id, else the first field."""
    name, lower = F.col("field"), F.lower(F.col(entity))
    rank = (
        F.when(name == "id", 0)
        .when(name == "code", 1)
        .when(name == F.concat(lower, F.lit("_id")), 2)
        .when(name == F.concat(lower, F.lit("Id")), 3)
        .otherwise(4)
    )
    fallback = profile.groupBy(*keys).agg(F.min(F.struct(rank.alias("rank"), "field"))["field"].alias("_fallback"))
    return fallback.join(picked, keys, "left").select(
        *keys, F.coalesce("id_field", "_fallback").alias("id_path")
    )


def mapping_of(matches: DataFrame, vendor: str, entity: str, id_path: str, **group: str) -> Mapping:
    """The rules of one group as a mapping; a few dozen rows come to the driver."""
    rows = matches
    for name, value in group.items():
        rows = rows.filter(F.col(name).eqNullSafe(F.lit(value)))
    found = rows.orderBy("position", "target").limit(MAPPED + 1).collect()
    if len(found) > MAPPED:
        raise ValueError(f"more than {MAPPED} rules: name the group whose mapping is wanted")
    return Mapping(
        vendor=vendor,
        entity=entity,
        id_path=id_path,
        fields=tuple(
            FieldRule(r["target"], tuple(r["source"]), r["transform"], r["default"], r["is_required"], r["enum_map"] or {})
            for r in found
        ),
        writeback={r["target"]: r["source"][0] for r in found if r["writeback"]},
    )
