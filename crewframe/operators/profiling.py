"""Field profiles of schemaless records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewframe import refdata
from crewframe.functions.payload import as_text
from crewframe.session import cut

ENUM_LIMIT = 12
SAMPLES = 3
#: heaps in whose minima the first records of a field are told
DEALT = 8


def infer_field_type(value: Column) -> Column:
    """Type label of one variant value."""
    kind, text = F.schema_of_variant(value), as_text(value)
    number = r"^\s*[+-]?((\d[\d_]*)?\.?\d[\d_]*|\d[\d_]*\.)([eE][+-]?\d+)?\s*$|(?i)^\s*[+-]?(nan|inf|infinity)\s*$"
    return (
        F.when(kind == "BOOLEAN", F.lit("boolean"))
        .when(kind == "BIGINT", F.lit("integer"))
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.lit("number"))
        .when(kind.startswith("ARRAY"), F.lit("array"))
        .when(kind.startswith("OBJECT"), F.lit("object"))
        .when(kind.startswith("TIMESTAMP") | (kind == "DATE"), F.lit("datetime"))
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"), F.lit("datetime"))
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit("date"))
        .when(text.rlike(r"^\s*[+-]?\d+(_\d+)*\s*$"), F.lit("integer"))
        .when(text.rlike(number), F.lit("number"))
        .otherwise(F.lit("string"))
    )


def field_rows(df: DataFrame, keys: list[str], order: str, payload: str = "payload") -> DataFrame:
    """(keys, field, order, value variant) for every key of every record."""
    return df.select(
        *keys, F.col(order).alias("_ord"), F.explode(F.try_variant_get(F.col(payload), "$", "map<string,variant>"))
        .alias("field", "value")
    )


def profile_parts(df: DataFrame, keys: list[str], order: str, payload: str = "payload") -> DataFrame:
    """What a profile needs of one landing, small and mergeable: store it, and later landings need not read this one again.

    Per key group and field: ``non_null_count``, ``first`` (order, type), ``values`` (the distinct texts, null
    beyond ENUM_LIMIT of them) and ``samples`` (the first three, with their order); per key group one row without
    field with ``records``.  ``order`` must go on over the landings.

    The first pass has buffers of fixed size per field and sorts nothing: the distinct values come from a frequent-items
    sketch that is exact up to 48 values, and is used only where the distinct estimate says there
    are far fewer.  It also tells an order by which every field has its first three records (see :func:`_reach`), so the
    second pass looks at those few records alone for types and samples.
    """
    value, group = F.col("value"), [*keys, "field"]
    given = ~F.is_variant_null("value")
    cells = field_rows(df, keys, order, payload)
    rows = cells.select(*group, F.when(given, F.col("_ord")).alias("_ord"), F.when(given, _shown(value)).alias("_text"))
    # rows whose value is null have no order and leave every aggregate alone
    values = cut(
        rows.groupBy(*group).agg(
            F.count("_ord").alias("non_null_count"),
            F.approx_count_distinct("_text").alias("_estimate"),
            F.expr(f"approx_top_k(_text, {ENUM_LIMIT + 1}, 64) FILTER (WHERE _text IS NOT NULL)").alias("_top"),
            _reach(F.col("_ord")).alias("_reach"),
        )
    )
    # records beyond the reach of all fields of their group are not taken apart again
    far = values.groupBy(*keys).agg(F.max("_reach").alias("_far"), F.max(F.col("_reach").isNull()).alias("_all"))
    near = _met(df, far, keys).filter(F.col("_all") | (F.col(order) <= F.col("_far"))).drop("_far", "_all")
    early = _met(field_rows(near, keys, order, payload), values.select(*group, "_reach"), group)
    early = early.filter(given & F.col("_ord").isNotNull() & (F.col("_reach").isNull() | (F.col("_ord") <= F.col("_reach"))))
    early = early.select(*group, "_ord", infer_field_type(value).alias("_type"), _shown(value).alias("_text"))
    first = early.groupBy(*group).agg(F.min(F.struct("_ord", "_type")).alias("first"))
    samples = (
        early.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy("_ord")))
        .filter(F.col("_n") <= SAMPLES)
        .groupBy(*group)
        .agg(F.array_sort(F.collect_list(F.struct("_ord", "_text"))).alias("samples"))
    )
    few = (F.col("_estimate") <= 2 * ENUM_LIMIT) & (F.size("_top") <= ENUM_LIMIT)
    fields = _met(_met(values, first, group, "left"), samples, group, "left").select(
        *group, "non_null_count", "first", F.when(few, F.array_sort(F.col("_top")["item"])).alias("values"), "samples",
        F.lit(None).cast("bigint").alias("records"),
    )
    totals = df.groupBy(*keys).agg(F.count("*").alias("records"))
    return fields.unionByName(totals, allowMissingColumns=True)


def _shown(value: Column) -> Column:
    """A variant value as text; booleans as True and False.  Only texts spelled like one are asked for their kind."""
    text = as_text(value)
    boolean = F.when(F.schema_of_variant(value) == "BOOLEAN", F.initcap(text)).otherwise(text)
    return F.when(text.isin("true", "false"), boolean).otherwise(text)


def _reach(order: Column) -> Column:
    """Aggregate: an order that at least SAMPLES rows do not exceed, and few more; null if the rows may all be needed.

    Rows are dealt into DEALT heaps by a hash of their order; the third smallest of the heaps' minima is no less than the third
    smallest of all.
    """
    heap = F.pmod(F.xxhash64(order), F.lit(DEALT))
    least = F.array_compact(F.array(*[F.min(F.when(heap == n, order)) for n in range(DEALT)]))
    return F.get(F.array_sort(least), F.lit(SAMPLES - 1))


def _met(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys meet."""
    named, same = {key: f"_met_{n}" for n, key in enumerate(keys)}, F.lit(True)
    for key, name in named.items():
        same = same & F.col(key).eqNullSafe(F.col(name))
    return rows.join(small.withColumnsRenamed(named), same, how).drop(*named.values())


def merge_parts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Parts of several landings as one: the parts of all their records together."""
    over = F.max(F.col("field").isNotNull() & (F.col("non_null_count") > 0) & F.col("values").isNull())
    found = parts.groupBy(*keys, "field").agg(
        F.sum("non_null_count").alias("non_null_count"), F.min("first").alias("first"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("values")))).alias("values"),
        # three of each landing
        F.slice(F.array_sort(F.flatten(F.collect_list("samples"))), 1, SAMPLES).alias("samples"),
        F.sum("records").alias("records"), over.alias("_over"),
    )
    fits = ~F.col("_over") & (F.size("values") <= ENUM_LIMIT)
    return found.withColumn("values", F.when(fits, F.col("values"))).drop("_over")


def finished_profile(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Per key group and field: type of the first value, nullability, enum values, first samples."""
    filled, none = F.col("non_null_count"), F.array().cast("array<string>")
    totals = parts.filter("field is null").select(*keys, F.col("records").alias("record_count"))
    return (
        parts.filter("field is not null")
        .join(totals, keys)
        .select(
            *keys,
            "field",
            F.coalesce("first._type", F.lit("string")).alias("data_type"),
            (filled < F.col("record_count")).alias("is_nullable"),
            (filled == F.col("record_count")).alias("is_required"),
            F.when(filled > 0, F.coalesce("values", none)).otherwise(none).alias("enum_values"),
            F.coalesce(F.col("samples")["_text"], none).alias("sample_values"),
            filled.alias("non_null_count"),
            "record_count",
        )
    )


def profile_records(df: DataFrame, keys: list[str], order: str, payload: str = "payload") -> DataFrame:
    """The profile of one table of records, see :func:`profile_parts` and :func:`finished_profile`."""
    return finished_profile(profile_parts(df, keys, order, payload), keys)


def pick_id_field(profile: DataFrame, keys: list[str], entity: str = "entity_type") -> DataFrame:
    """The id field per key group: known names in order, else the first field that looks like one."""
    name, lower = F.col("field"), F.lower(F.col(entity))
    rank = None
    for position, pattern in enumerate(refdata.ID_FIELDS):
        if "{entity}" in pattern:
            wanted = F.concat(lower, F.lit(pattern.replace("{entity}", "")))
        else:
            wanted = F.lit(pattern)
        rank = F.when(name == wanted, position) if rank is None else rank.when(name == wanted, position)
    rank = rank.when(name.endswith("_id") | name.endswith("Id") | name.startswith("id_"), len(refdata.ID_FIELDS))
    return (
        profile.select(*keys, F.struct(rank.alias("rank"), name.alias("field")).alias("_pick"))
        .groupBy(*keys)
        .agg(F.min(F.when(F.col("_pick.rank").isNotNull(), F.col("_pick"))).alias("_best"))
        .select(*keys, F.col("_best.field").alias("id_field"))
    )
