"""Columns out of a VARIANT payload: paths, transforms, emptiness."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of the transforms and the date formats they try, in this order.

BLANKS = " \t\n\r\f\x0b"
_INDEXED = re.compile(r"^([^\[\]]*)\[(\d*)\]$")


def json_step(name: str) -> str:
    """One object step of a variant path."""
    quote = '"' if "'" in name else "'"
    return f"[{quote}{name}{quote}]"


def variant_at(payload: Column, *names: str) -> Column:
    """Variant under nested names, or null."""
    return F.try_variant_get(payload, "$" + "".join(json_step(n) for n in names), "variant")


def as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def as_list(value: Column) -> Column:
    """Array elements, or null when the value is no array."""
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def is_array(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))


def is_filled(value: Column) -> Column:
    """Neither absent nor null, '', [] or {}."""
    return F.coalesce(~F.to_json(value).isin("null", '""', "[]", "{}"), F.lit(False))


def path_col(payload: Column, path: str) -> Column:
    """Variant at a dotted path.

    ``name[i]`` takes one element, ``name[]`` carries the rest of the path over the array and drops
    nulls and empty strings; a wrong shape anywhere gives null.
    """
    if not path:
        return F.lit(None).cast("variant")
    prefix = "$"
    segments = path.split(".")
    for position, segment in enumerate(segments):
        indexed = _INDEXED.match(segment)
        if not indexed:
            prefix += json_step(segment)
            continue
        name, index = indexed.groups()
        prefix += json_step(name) if name else ""
        if index:
            prefix += f"[{index}]"
            continue
        rest = ".".join(segments[position + 1 :])
        whole = F.try_variant_get(payload, prefix, "variant")
        if not rest:
            return F.when(is_array(whole), whole)
        inner = F.transform(as_list(whole), lambda item: path_col(item, rest))
        kept = F.filter(inner, lambda v: F.coalesce(~F.to_json(v).isin("null", '""'), F.lit(False)))
        return F.to_variant_object(kept)
    return F.try_variant_get(payload, prefix, "variant")


# ------------------------------------------------------------------------- transforms
def _strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def _datetime(text: Column) -> Column:
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"), text.try_cast("timestamp"))
    named = [
        F.try_to_timestamp(text, F.lit(f))
        for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy")
    ]
    return F.coalesce(iso, *named)


def _date(text: Column) -> Column:
    """Calendar date as written; an offset does not shift it."""
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
        .when(
            text.rlike(r"^\d{4}-\d{2}-\d{2}"),
            F.when(_datetime(text).isNotNull(), F.substring(text, 1, 10).try_cast("date")),
        )
        .otherwise(F.to_date(_datetime(text)))
    )


def _int(text: Column) -> Column:
    return F.when(_strip(text).rlike(r"^-?\d+$"), _strip(text).try_cast("bigint"))


# Transforms that only look at the text of a value.
TEXT_TRANSFORMS = {
    "string": lambda t: t,
    "strip": _strip,
    "lower": F.lower,
    "upper": F.upper,
    "int": _int,
    "decimal": lambda t: _strip(t).try_cast("decimal(28,10)"),
    "datetime": _datetime,
    "date": _date,
}


def _item_text(item: Column) -> Column:
    """A list element as text; an object gives its first scalar value."""
    scalars = F.filter(
        F.map_values(F.try_variant_get(item, "$", "map<string,variant>")),
        lambda v: F.schema_of_variant(v).rlike("^(STRING|BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)"),
    )
    first = as_text(F.get(scalars, F.lit(0)))
    return F.when(is_object(item), F.when(first != "", first)).otherwise(as_text(item))


def _list(value: Column) -> Column:
    text = as_text(value)
    parts = F.filter(F.transform(F.split(text, "[,;|]"), _strip), lambda p: p != "")
    items = F.filter(F.transform(as_list(value), _item_text), lambda p: p.isNotNull())
    empty = F.array().cast("array<string>")
    return (
        F.when(text.isNull(), empty)
        .when(is_array(value), items)
        .when(F.schema_of_variant(value) == "STRING", parts)
        .otherwise(F.array(text))
    )


def _join_names(value: Column) -> Column:
    parts = F.filter(
        F.transform(as_list(value), lambda v: _strip(as_text(v))), lambda p: p.isNotNull() & (p != "")
    )
    joined = F.when(is_array(value), F.array_join(parts, " ")).otherwise(_strip(as_text(value)))
    return F.when(joined != "", joined)


TRANSFORMS = {
    **{name: (lambda change: lambda v: change(as_text(v)))(change) for name, change in TEXT_TRANSFORMS.items()},
    "list": _list,
    "join_names": _join_names,
    "bool": lambda v: F.try_variant_get(v, "$", "boolean"),
}
TRANSFORM_TYPES = {
    "int": "bigint", "decimal": "decimal(28,10)", "datetime": "timestamp", "date": "date",
    "list": "array<string>", "bool": "boolean",
}


def text_at(payload: Column, path: str) -> Column:
    """Text at a path; arrays and objects give their JSON."""
    if "[]" in path or not path:
        return as_text(path_col(payload, path))
    prefix = "$"
    for segment in path.split("."):
        indexed = _INDEXED.match(segment)
        name, index = indexed.groups() if indexed else (segment, "")
        prefix += (json_step(name) if name else "") + (f"[{index}]" if index else "")
    return F.try_variant_get(payload, prefix, "string")


def filled_text(payload: Column, path: str, text: Column) -> Column:
    """``text`` unless it is '' or the JSON of an empty array or object.

    Only where it reads [] or {} is the value itself asked whether it is a string of that spelling.
    """
    is_string = F.schema_of_variant(path_col(payload, path)) == "STRING"
    return F.when(text.isin("[]", "{}"), F.when(is_string, text)).when(text != "", text)


def joined(texts: list[Column]) -> Column:
    """Non-empty stripped texts joined by a blank."""
    parts = [F.when(_strip(t) != "", _strip(t)) for t in texts]
    return F.nullif(F.concat_ws(" ", *parts), F.lit(""))
