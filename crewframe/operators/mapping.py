"""Compile declarative mappings into projections, both ways.

A mapping is a few dozen rules.  It is the only thing the driver reads; the data stays in one
``select`` that Catalyst sees whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewframe import schemas
from crewframe.functions.payload import (
    TEXT_TRANSFORMS, TRANSFORM_TYPES, TRANSFORMS, as_list, as_text, filled_text, is_array, is_filled, is_object, joined,
    path_col, text_at,
)
from crewframe.sources.tables import append_upsert, latest_by_key


@dataclass(frozen=True)
class FieldRule:
    """One canonical field and the payload paths that feed it."""

    target: str
    source: tuple[str, ...]
    transform: str = "string"
    default: str | None = None
    required: bool = False
    values: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.transform not in TRANSFORMS:
            raise ValueError(f"{self.target}: unknown transform {self.transform!r}; known: {sorted(TRANSFORMS)}")
        if isinstance(self.source, str):
            object.__setattr__(self, "source", (self.source,))


@dataclass(frozen=True)
class Mapping:
    """How one vendor's records become one canonical entity."""

    vendor: str
    entity: str
    id_path: str
    fields: tuple[FieldRule, ...] = ()
    version_path: str | None = None
    collection_path: str | None = None
    writeback: dict[str, str] = field(default_factory=dict)


def _by_text(rule: FieldRule) -> bool:
    """Does the rule only need the texts at its paths?"""
    return rule.transform in TEXT_TRANSFORMS or (rule.transform == "join_names" and len(rule.source) > 1)


def _transformed(rule: FieldRule, texts: list[Column], value: Column) -> Column:
    if not _by_text(rule):
        return TRANSFORMS[rule.transform](value)
    if rule.transform == "join_names":
        return joined(texts)
    return TEXT_TRANSFORMS[rule.transform](texts[0])


def _natural(rule: FieldRule, value: Column) -> Column:
    """The text a value map is asked for: a number without the zeros its column type adds, ``True`` and ``False``."""
    text = value.cast("string")
    kind = TRANSFORM_TYPES.get(rule.transform, "string")
    if kind.startswith("decimal"):
        return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.initcap(text) if kind == "boolean" else text


def _looked_up(rule: FieldRule, value: Column) -> Column:
    """What the value map has for a value, null for nothing."""
    table = F.create_map(*[F.lit(x) for pair in rule.values.items() for x in pair])
    text = _natural(rule, value)
    return F.coalesce(F.try_element_at(table, text), F.try_element_at(table, F.upper(text)))


def _finished(rule: FieldRule, value: Column) -> Column:
    """Value map and default."""
    if rule.values and rule.transform != "list":
        plain = _natural(rule, value) if rule.transform == "decimal" else value.cast("string")
        value = F.coalesce(_looked_up(rule, value), plain)
    kind = TRANSFORM_TYPES.get(rule.transform, "string")
    if kind == "array<string>":
        default = F.array().cast(kind) if rule.default is None else F.split(F.lit(rule.default), ",")
        return F.when(F.size(value) > 0, value).otherwise(default)
    if rule.values:
        kind = "string"
    if kind == "string":
        value = F.when(value != "", value)
    return value if rule.default is None else F.coalesce(value, F.lit(rule.default).cast(kind))


def _raw_col(payload: Column, rule: FieldRule) -> Column:
    """Value of one rule before value map and default: first filled path, transformed."""
    texts = [text_at(payload, p) for p in rule.source]
    if rule.transform != "join_names":
        texts = [F.coalesce(*[filled_text(payload, p, t) for p, t in zip(rule.source, texts)])]
    filled = [(lambda raw: F.when(is_filled(raw), raw))(path_col(payload, p)) for p in rule.source]
    return _transformed(rule, texts, F.coalesce(*filled))


def field_col(payload: Column, rule: FieldRule) -> Column:
    """Value of one rule as one expression: first filled path, transform, value map, default."""
    return _finished(rule, _raw_col(payload, rule))


def mapped_to_text(payload: Column, rule: FieldRule) -> Column:
    """Whether the value map turns a date or number of the rule into a text."""
    if not rule.values or rule.transform not in ("date", "datetime", "decimal"):
        return F.lit(False)
    return _looked_up(rule, _raw_col(payload, rule)).isNotNull()


def _is_empty(column: Column, rule: FieldRule) -> Column:
    if rule.transform == "list":
        return F.coalesce(F.size(column) == 0, F.lit(True))
    return column.isNull()


def external_id(payload: Column, mapping: Mapping) -> Column:
    """Id as text; null when absent or empty."""
    text = as_text(path_col(payload, mapping.id_path))
    return F.when(text != "", text)


def version(payload: Column, mapping: Mapping) -> Column:
    if not mapping.version_path:
        return F.lit(None).cast("string")
    text = as_text(path_col(payload, mapping.version_path))
    return F.when(text != "", text)


def records_of(response: Column, mapping: Mapping) -> Column:
    """array<variant> of the records in a response, by the mapping's collection path."""
    if mapping.collection_path:
        found = path_col(response, mapping.collection_path)
        return F.when(is_array(found), as_list(found)).when(is_filled(found), F.array(found))
    return F.when(is_array(response), as_list(response)).when(is_object(response), F.array(response))


def project(df: DataFrame, mapping: Mapping, payload: str = "payload") -> DataFrame:
    """All columns of ``df`` plus one per rule (prefix ``m_``) and ``_errors``.

    Texts, filled texts and transforms are columns of their own, one projection each: a path is
    read from the payload once however often its transform looks at it.
    """
    body = F.col(payload)
    named = {rule.target: rule for rule in mapping.fields}
    texts = {
        f"_t_{target}_{i}": text_at(body, path)
        for target, rule in named.items()
        for i, path in enumerate(rule.source)
        if _by_text(rule)
    }
    values = {}
    for target, rule in named.items():
        if not _by_text(rule):
            filled = [(lambda raw: F.when(is_filled(raw), raw))(path_col(body, p)) for p in rule.source]
            values[f"_v_{target}"] = F.coalesce(*filled)
    firsts = {
        f"_f_{target}": F.coalesce(
            *[filled_text(body, path, F.col(f"_t_{target}_{i}")) for i, path in enumerate(rule.source)]
        )
        for target, rule in named.items()
        if rule.transform in TEXT_TRANSFORMS
    }
    changed = {}
    for target, rule in named.items():
        if rule.transform == "join_names" and _by_text(rule):
            given = [F.col(f"_t_{target}_{i}") for i in range(len(rule.source))]
        else:
            given = [F.col(f"_f_{target}")] if _by_text(rule) else []
        value = F.lit(None) if _by_text(rule) else F.col(f"_v_{target}")
        changed[f"_c_{target}"] = _transformed(rule, given, value)
    out = df
    for step in (texts | values, firsts, changed):
        out = out.withColumns(step) if step else out
    out = out.withColumns({f"m_{t}": _finished(rule, F.col(f"_c_{t}")) for t, rule in named.items()})
    errors = [
        F.when(
            _is_empty(F.col(f"m_{rule.target}"), rule),
            F.lit(f"required field {rule.target!r} is empty; looked in {list(rule.source)}"),
        )
        for rule in mapping.fields
        if rule.required
    ]
    listed = F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>")
    row = F.struct(*[f"m_{t}" for t in named], listed.alias("_errors"))
    # The one-row generator keeps a later filter on the errors above the projections; moved below
    # them it would work out the required fields a second time, in front of any repartitioning.
    return out.select(*df.columns, F.inline_outer(F.array(row)))


def canonical_columns(df: DataFrame, mapping: Mapping, payload: str, tenant: Column) -> list[Column]:
    """The canonical table's columns from a projected frame."""
    body = F.col(payload)
    targets = {
        schemas.TARGET_COLUMN.get((mapping.entity, rule.target), rule.target): rule.target for rule in mapping.fields
    }
    plain = lambda name: as_text(F.try_variant_get(body, f"$.{name}", "variant"))
    given = lambda column: F.when(column != "", column)
    source_ref = F.struct(
        F.lit(mapping.vendor).alias("vendor"),
        F.lit(mapping.entity).alias("entity_type"),
        F.coalesce(
            external_id(body, mapping), *[given(plain(n)) for n in ("id", "name", "pkId", "job_id")], F.lit("unknown")
        ).alias("external_id"),
        F.coalesce(given(plain("version")), given(plain("updatedAt")), F.lit("1")).alias("version"),
        F.lit(None).cast("string").alias("url"),
    )
    columns = [source_ref.alias("source_ref"), tenant.alias("tenant_id")]
    known = schemas.CANONICAL.get(mapping.entity)
    if known is None:  # an entity without a canonical table keeps every mapped field
        columns += [F.col(f"m_{rule.target}").alias(rule.target) for rule in mapping.fields]
    else:
        for name, kind, default in known:
            value = F.col(f"m_{targets[name]}").try_cast(kind) if name in targets else F.lit(None).cast(kind)
            if default is not None and name not in targets:
                value = F.lit(default).cast(kind)
            columns.append(value.alias(name))
    return columns + [body.alias("raw")]


def to_canonical(
    df: DataFrame, mapping: Mapping, payload: str = "payload", tenant: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(good canonical rows, rejected rows with their errors).  No row ever throws."""
    projected = project(df, mapping, payload)
    owner = tenant if tenant is not None else F.lit(mapping.vendor)
    good = projected.filter(F.size("_errors") == 0).select(*canonical_columns(df, mapping, payload, owner))
    rejected = projected.filter(F.size("_errors") > 0).select(*df.columns, F.col("_errors").alias("errors"))
    return good, rejected


def to_vendor(df: DataFrame, mapping: Mapping, keep: list[str] | None = None) -> DataFrame:
    """Canonical rows as vendor JSON along the write paths; absent values are left out."""
    if not mapping.writeback:
        raise ValueError(f"{mapping.vendor}/{mapping.entity} is read-only: no writeback mapping")
    tree: dict = {}
    for target, path in mapping.writeback.items():
        column = schemas.TARGET_COLUMN.get((mapping.entity, target), target)
        column = column if column in df.columns else target
        if column not in df.columns:
            continue
        node = tree
        *parents, leaf = path.split(".")
        for parent in parents:
            node = node.setdefault(parent, {})
        kind = df.schema[column].dataType.typeName()
        value = F.col(column)
        if kind in ("decimal", "date"):
            value = value.cast("string")
        elif kind == "timestamp":
            value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ssXXX")
        node[leaf] = value

    def build(node: dict) -> Column:
        parts = {k: build(v) if isinstance(v, dict) else v for k, v in node.items()}
        anything = F.coalesce(*[F.when(v.isNotNull(), True) for v in parts.values()])
        return F.when(anything, F.struct(*[v.alias(k) for k, v in parts.items()]))

    return df.select(*(keep or []), F.coalesce(F.to_json(build(tree)), F.lit("{}")).alias("payload"))


# ------------------------------------------------------------------------------ catalog
CATALOG_SCHEMA = (
    "tenant_id string, vendor string, entity_type string, id_path string, version_path string, "
    "collection_path string, fields array<struct<target:string,source:array<string>,transform:string,"
    "default:string,required:boolean,`values`:map<string,string>>>, writeback map<string,string>, "
    "updated_at timestamp"
)


def catalog_rows(spark, tenant: str, mappings: list[Mapping], updated_at) -> DataFrame:
    """Mappings as catalog rows; vendor lower-cased, entity upper-cased."""
    rows = [
        (
            tenant, m.vendor.lower(), m.entity.upper(), m.id_path, m.version_path, m.collection_path,
            [(r.target, list(r.source), r.transform, r.default, r.required, dict(r.values)) for r in m.fields],
            dict(m.writeback), updated_at,
        )
        for m in mappings
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def save_mappings(spark, path: str, tenant: str, mappings: list[Mapping], updated_at) -> None:
    """Append mappings to the catalog log; the latest of a key counts."""
    append_upsert(catalog_rows(spark, tenant, mappings, updated_at), path)


def list_mappings(log: DataFrame, tenant: str | None = None) -> DataFrame:
    """The current mapping of every (tenant, vendor, entity), in key order."""
    keys = ["tenant_id", "vendor", "entity_type"]
    rows = log if tenant is None else log.filter(F.col("tenant_id") == tenant)
    return latest_by_key(rows, keys, F.current_timestamp()).orderBy(*keys)


def load_mapping(catalog: DataFrame, tenant: str, vendor: str, entity: str) -> Mapping | None:
    """The one mapping of (tenant, vendor, entity): a single row of rules comes to the driver."""
    rows = (
        catalog.filter(
            (F.col("tenant_id") == tenant)
            & (F.col("vendor") == vendor.lower())
            & (F.col("entity_type") == entity.upper())
        )
        .orderBy(F.desc("updated_at"))
        .limit(1)
        .collect()
    )
    if not rows:
        return None
    row = rows[0]
    return Mapping(
        vendor=row["vendor"],
        entity=row["entity_type"],
        id_path=row["id_path"],
        version_path=row["version_path"],
        collection_path=row["collection_path"],
        fields=tuple(
            FieldRule(f["target"], tuple(f["source"]), f["transform"], f["default"], f["required"], f["values"] or {})
            for f in row["fields"]
        ),
        writeback=row["writeback"] or {},
    )
