"""Who may do what, and which write is which: roles, keys, attribution, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewframe import refdata
from crewframe.operators.sequences import nearest_marks, reached
from crewframe.session import cut, discard

#: most updates of an entity that one task walks
WALKED = 1024


def role_allows(role: Column, permission: Column) -> Column:
    """Does the role hold the permission?  Six constant arrays in one CASE: no join."""
    held = None
    for name, permissions in refdata.ROLE_PERMISSIONS.items():
        branch = permission.isin(permissions)
        held = F.when(role == name, branch) if held is None else held.when(role == name, branch)
    return F.coalesce(held.otherwise(F.lit(False)), F.lit(False))


def authorize_actions(df: DataFrame) -> DataFrame:
    """Add ``role_allowed``, ``duty_separated`` and ``allowed`` to requested actions."""
    on_oneself = F.col("permission").isin(refdata.SELF_ACTION_FORBIDDEN) & (
        F.col("user_id").cast("string") == F.col("target_employee_id").cast("string")
    )
    return df.withColumns(
        {
            "role_allowed": role_allows(F.col("role"), F.col("permission")),
            "duty_separated": ~F.coalesce(on_oneself, F.lit(False)),
        }
    ).withColumn("allowed", F.col("role_allowed") & F.col("duty_separated"))


def denied_actions(df: DataFrame) -> DataFrame:
    return authorize_actions(df).filter(~F.col("allowed"))


#: scalars whose JSON is the same from a struct and from a variant
_PLAIN = (T.StringType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)


def _key_sorted(value: Column, kind: T.DataType) -> Column | None:
    """The value with the fields of all its structs in order of their names; None if its JSON must be read to be sorted."""
    if isinstance(kind, _PLAIN):
        return value
    if isinstance(kind, T.ArrayType):
        inner = _key_sorted(F.lit(None).cast(kind.elementType), kind.elementType)
        return None if inner is None else F.transform(value, lambda item: _key_sorted(item, kind.elementType))
    if isinstance(kind, T.StructType) and len({f.name for f in kind}) == len(kind):
        parts = [(f.name, _key_sorted(value.getField(f.name), f.dataType)) for f in sorted(kind, key=lambda f: f.name)]
        if all(part is not None for _, part in parts) and parts:
            return F.when(value.isNotNull(), F.struct(*[part.alias(name) for name, part in parts]))
    return None


def canonical_json(payload: Column, kind: T.DataType | None = None) -> Column:
    """JSON with keys sorted at every level, without null fields.

    Structs of plain fields (``kind``) are sorted in the plan and written once; of others the JSON is read
    as a variant, whose objects keep their keys sorted.
    """
    ready = _key_sorted(payload, kind) if isinstance(kind, T.StructType) else None
    return F.to_json(ready) if ready is not None else F.to_json(F.parse_json(F.to_json(payload)))


def idempotency_key(
    df: DataFrame,
    payload: str = "payload",
    entity: str = "entity_type",
    action: str = "action",
    actor: str = "actor_id",
    tenant: str = "tenant_id",
) -> DataFrame:
    """sha256 over tenant, entity, action, actor and the key-sorted payload."""
    filled = lambda name, default: F.coalesce(
        F.when(F.col(name).cast("string") != "", F.col(name).cast("string")), F.lit(default)
    )
    raw = F.concat_ws(
        ":",
        filled(tenant, "default"),
        F.col(entity),
        F.lower(F.col(action)),
        filled(actor, "anonymous"),
        canonical_json(F.col(payload), df.schema[payload].dataType if payload in df.columns else None),
    )
    return df.withColumn("idempotency_key", F.sha2(raw, 256))


def attribution_columns(
    df: DataFrame,
    agent: Column,
    approver: Column,
    reasoning: Column,
    at: Column | None = None,
    tenant: str = "tenant_id",
) -> DataFrame:
    """Audit columns of a write.  The invocation id comes from the content, so reruns agree."""
    hashed = F.sha2(F.to_json(F.parse_json(reasoning)), 256)
    columns = {
        "plugin_version": F.lit("2.0.0"),
        "agent_name": agent,
        "hitl_approver_id": approver.cast("string"),
        "reasoning_hash": F.concat(F.lit("sha256:"), hashed),
        "agent_invocation_id": F.concat(
            F.lit("inv_"),
            F.substring(F.sha2(F.concat_ws(":", F.col(tenant), agent, approver.cast("string"), hashed), 256), 1, 12),
        ),
    }
    if at is not None:
        columns["timestamp_utc"] = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return df.withColumns(columns)


def _conflict_message(expected: Column, stored: Column) -> Column:
    return F.concat(
        F.lit("Optimistic concurrency conflict on "), F.col("entity_type"), F.lit(" '"),
        F.col("entity_id").cast("string"), F.lit("': expected version '"), expected,
        F.lit("' but remote is '"), F.coalesce(stored, F.lit("None")), F.lit("'."),
    )


def version_conflicts(updates: DataFrame, current: DataFrame) -> DataFrame:
    """Mark updates whose expected version is given and differs from the stored one."""
    expected, stored = F.col("expected_version"), F.col("current_version")
    conflict = expected.isNotNull() & ~expected.eqNullSafe(stored)
    return (
        updates.join(current.select("entity_type", "entity_id", "current_version"), ["entity_type", "entity_id"], "left")
        .withColumn("is_conflict", conflict)
        .withColumn("conflict_message", F.when(conflict, _conflict_message(expected, stored)))
    )


def _walked(rows: DataFrame, current: DataFrame, kind: T.DataType) -> DataFrame:
    """(row, remote_version) of the updates of entities of which each has few, and one row in ``current`` at most.

    ``rows``: entity_type, entity_id, expected_version, new_version, place, row; versions are of type ``kind``.  Updates at
    one place count as one step.
    """
    keys = ["entity_type", "entity_id"]
    # nothing is before the place that has neither order nor tie
    placed = rows.filter(F.col("place.o").isNotNull() | F.col("place.i").isNotNull())
    update = F.struct("place", "expected_version", "new_version", "row")
    found = placed.groupBy(*keys).agg(F.collect_list(update).alias("updates")).join(current, keys, "left")
    known = F.col("entity_type").isNotNull() & F.col("entity_id").isNotNull()  # what has no key has no version
    by_place = lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0)

    def walk(done: Column, update: Column) -> Column:
        again = update["place"].eqNullSafe(done["place"])
        remote = F.when(again, done["remote"]).otherwise(done["version"])
        expected, new = update["expected_version"], update["new_version"].cast(kind)
        applies = F.col("known") & (expected.isNull() | F.coalesce(expected == remote, F.lit(False)))
        return F.struct(
            update["place"].alias("place"), remote.alias("remote"),
            F.when(applies, new).otherwise(done["version"]).alias("version"),
            F.array_append(done["out"], F.struct(update["row"].alias("row"), remote.alias("remote_version"))).alias("out"),
        )

    out = T.ArrayType(T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("remote_version", kind)]))
    held = F.col("current_version").cast(kind)
    nowhere = F.lit(None).cast(rows.schema["place"].dataType)
    start = F.struct(nowhere.alias("place"), held.alias("remote"), held.alias("version"), F.array().cast(out).alias("out"))
    walked = F.aggregate(F.array_sort("updates", by_place), start, walk, lambda done: done["out"])
    return found.withColumn("known", known).select(F.explode(walked).alias("met")).select("met.*")


def applied_in_order(updates: DataFrame, current: DataFrame, order: str, tie: str) -> DataFrame:
    """``updates`` of one batch applied in (order, tie) order of each entity: ``remote_version`` that each one meets,
    ``is_conflict`` and ``conflict_message``.

    ``updates``: entity_type, entity_id, expected_version, new_version, order, tie (unique within an entity).  An update that expects nothing, or the version
    that is there, is applied and leaves ``new_version``; any other is a conflict and leaves all as it is.  So the second
    of two writers that read the same version conflicts.  An entity that is not in ``current`` (entity_type,
    entity_id, current_version) has no version.

    An entity of at most WALKED updates is walked.  An entity with more is never walked in one task, see :func:`_jumped`.
    """
    keys = ["entity_type", "entity_id"]
    spark = updates.sparkSession
    place = F.struct(F.col(order).alias("o"), F.col(tie).alias("i"), F.lit(0).alias("f"))
    whole = F.struct(*[F.col(f"`{c}`") for c in updates.columns]).alias("row")
    rows = cut(updates.select(*keys, "expected_version", "new_version", place.alias("place"), whole))
    held = cut(current.select(*keys, "current_version"))
    kind = rows.select("new_version").union(held.select("current_version")).schema[0].dataType
    more = lambda df, n: df.groupBy(*keys).count().filter(F.col("count") > n).select(*keys)
    # whose version is stored twice is left to the jumps as well
    many = cut(more(rows, WALKED).unionByName(more(held, 1)).distinct())
    if many.isEmpty():
        met = _walked(rows, held, kind)
    else:
        named = many.select(*[F.col(k).alias(f"_{k}") for k in keys])
        same = F.col("_entity_type").eqNullSafe(F.col("entity_type")) & F.col("_entity_id").eqNullSafe(F.col("entity_id"))
        met = _walked(rows.join(named, same, "left_anti"), held, kind)
        met = met.unionByName(_jumped(rows.join(named, same, "left_semi"), held))
    expected, remote = F.col("expected_version"), F.col("remote_version")
    conflict = expected.isNotNull() & ~expected.eqNullSafe(remote)
    out = met.select("row.*", "remote_version").withColumn("is_conflict", conflict)
    out = cut(out.withColumn("conflict_message", F.when(conflict, _conflict_message(expected, remote))))
    discard(spark, rows, held, many)
    return out


def _jumped(rows: DataFrame, current: DataFrame) -> DataFrame:
    """(row, remote_version) of the updates of entities of any size; ``rows`` as in :func:`_walked`.

    What an update leaves decides which update is applied next: the first after it that expects that version or none.  These
    jumps are found for all updates at once and followed by doubling, so an entity with very many updates is
    never walked in one task.
    """
    keys = ["entity_type", "entity_id"]
    spark, rows = rows.sparkSession, cut(rows)
    stored = rows.select(*keys).distinct().join(current.select(*keys, "current_version"), keys, "left")
    kinds = rows.schema["place"].dataType
    # nulls sort first: before every update
    start = [F.lit(None).cast(kinds[c].dataType).alias(c) for c in ("o", "i")]
    stored = cut(stored.withColumn("place", F.struct(*start, F.lit(0).alias("f"))))
    past = F.col("place").withField("f", F.lit(1))
    leaves = lambda df, version: df.select(
        *keys, F.col(version).alias("version"), past.alias("place"), F.col("place").alias("t")
    )
    left = leaves(rows, "new_version").unionByName(leaves(stored, "current_version"))
    bound = rows.filter("expected_version is not null").select(*keys, F.col("expected_version").alias("version"), "place")
    free = rows.filter("expected_version is null").select(*keys, "place")
    to = F.col("mark.place").alias("nxt")
    jumps = nearest_marks(bound, left.filter("version is not null"), [*keys, "version"], "place").select(*keys, "t", to)
    jumps = jumps.unionByName(nearest_marks(free, left.drop("version"), keys, "place").select(*keys, "t", to))
    steps = jumps.groupBy(*keys, "t").agg(F.min("nxt").alias("nxt"))
    applied = reached(stored.select(*keys, F.col("place").alias("t")), steps, keys)

    done = rows.join(applied.withColumnRenamed("t", "place"), [*keys, "place"], "left_semi")
    versions = done.select(*keys, "place", F.col("new_version").alias("version")).unionByName(
        stored.select(*keys, "place", F.col("current_version").alias("version"))
    )
    met = nearest_marks(versions, rows.select(*keys, "place", "row"), keys, "place", before=True)
    out = cut(met.select("row", F.col("mark.version").alias("remote_version")))
    discard(spark, rows, stored)
    return out
