"""Reversible masking of personal data with keyed, repeatable tokens.

Matching, token making and rewriting are expressions on the row; no UDF, no shuffle.  The
vault is the distinct set of what was found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewframe import refdata

TOKEN = r"\[VAULT_[A-Z0-9_]+_[A-Z]{20}\]"
VAULT_FIELDS = "struct<token:string,original_value:string,entity_type:string>"


# What the first character of a match can be.  Looking at it first spares the costly Unicode word
# edge at nearly every position of a text and changes no match.
_FIRST = {
    "AADHAAR": r"\d", "PAN": "[A-Z]", "EMIRATES_ID": "7", "SSN": r"\d", "EMAIL": "[A-Za-z0-9._%+-]", "PHONE": r"[+(\d]",
}


def _pattern(name: str) -> str:
    return f"(?U)(?={_FIRST[name]})" + dict(refdata.PII_PATTERNS)[name]


def token(kind: Column, value: Column, tenant: Column, secret: str) -> Column:
    """``[VAULT_KIND_xxx]`` from a keyed hash of tenant and value.

    80 bits spelled with the letters A to P: no later pattern can match inside a token, and equal
    values of a tenant always meet in the same token.
    """
    if not secret:
        raise ValueError("a secret is required: unkeyed hashes of short identifiers can be searched")
    inner = F.sha2(F.concat(F.lit(secret), F.lit("|"), tenant.cast("string"), F.lit("|"), value), 256)
    digest = F.sha2(F.concat(F.lit(secret), F.lit("|"), inner), 256)
    letters = F.translate(F.substring(digest, 1, 20), "0123456789abcdef", "ABCDEFGHIJKLMNOP")
    return F.concat(F.lit("[VAULT_"), kind, F.lit("_"), letters, F.lit("]"))


# A phone match can have the shape of an earlier pattern where that one lacked its word edge.
_SAME_SHAPE = {"PHONE": "AADHAAR"}


def _kind(name: str, value: Column) -> Column:
    """Type by the first pattern that matches the whole value, so one value has one type."""
    earlier = _SAME_SHAPE.get(name)
    if earlier is None:
        return F.lit(name)
    whole = F.regexp_extract(value, f"^({_pattern(earlier)})$", 0) != ""
    return F.when(whole, F.lit(earlier)).otherwise(F.lit(name))


def _worth_looking(text: Column, mask_emails: bool) -> Column:
    """Every pattern needs three digits in a row, or an @ for addresses: one cheap scan skips the
    others for plain prose."""
    digits = text.rlike(r"(?U)\d{3}")
    return digits | F.contains(text, F.lit("@")) if mask_emails else digits


def _names(mask_emails: bool) -> list[str]:
    return [name for name, _ in refdata.PII_PATTERNS if mask_emails or name != "EMAIL"]


# A match is set between marks, so one scan of a pattern gives the matches and what lies between them.  Control
# characters of a text that look like marks are written otherwise meanwhile; no pattern takes one, and none is part of a word.
_MARK, _ESCAPE, _FOR_ESCAPE, _FOR_MARK = "\u0003", "\u0002", "\u0004", "\u0005"


def _guarded(text: Column) -> Column:
    escaped = F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + _FOR_ESCAPE))
    escaped = F.replace(escaped, F.lit(_MARK), F.lit(_ESCAPE + _FOR_MARK))
    return F.when(F.contains(text, F.lit(_ESCAPE)) | F.contains(text, F.lit(_MARK)), escaped).otherwise(text)


def _unguarded(text: Column) -> Column:
    plain = F.replace(text, F.lit(_ESCAPE + _FOR_MARK), F.lit(_MARK))
    plain = F.replace(plain, F.lit(_ESCAPE + _FOR_ESCAPE), F.lit(_ESCAPE))
    return F.when(F.contains(text, F.lit(_ESCAPE)), plain).otherwise(text)


def _parted(text: Column, pattern: str) -> Column:
    """The text in pieces: every second one is a match."""
    return F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)


def _once(value: Column, step) -> Column:
    """``step(value)`` with the value bound to a lambda variable.

    A step reads its text several times.  Bound like this it is computed once, and the expression
    stays small when the optimizer moves a filter on the result below it.
    """
    return F.get(F.transform(F.array(value), step), F.lit(0))


_HITS = "array<struct<entity_type:string,original_value:string,token:string>>"


def scanned(text: Column, tenant: Column, secret: str, mask_emails: bool = False) -> Column:
    """struct<text, found>: the text with all patterns replaced in their fixed order, and what they took.

    Each pattern scans the text once, and each match is hashed once, for both.
    """

    def step(name: str):
        def taken(value: Column) -> Column:
            def hit(kind: Column) -> Column:
                return F.struct(kind.alias("entity_type"), value.alias("original_value"), token(kind, value, tenant, secret).alias("token"))

            return _once(_kind(name, value), hit)

        def piece(value: Column, at: Column) -> Column:
            none = F.lit(None).cast("string")
            plain = F.struct(none.alias("entity_type"), none.alias("original_value"), value.alias("token"))
            return F.when(at % 2 == 1, taken(value)).otherwise(plain)

        def advance(before: Column) -> Column:
            def joined(pieces: Column) -> Column:
                hits = F.filter(pieces, lambda one: one["entity_type"].isNotNull())
                return F.struct(F.array_join(pieces["token"], "").alias("text"), F.concat(before["found"], hits).alias("found"))

            def built(pieces: Column) -> Column:
                return F.when(F.size(pieces) > 1, _once(F.transform(pieces, piece), joined)).otherwise(before)

            return _once(_parted(before["text"], _pattern(name)), built)

        return advance

    none = F.array().cast(_HITS)
    state = F.struct(_guarded(text).alias("text"), none.alias("found"))
    for name in _names(mask_emails):
        state = _once(state, step(name))
    done = _once(state, lambda end: F.struct(_unguarded(end["text"]).alias("text"), end["found"].alias("found")))
    return F.when(_worth_looking(text, mask_emails), done).otherwise(F.struct(text.alias("text"), none.alias("found")))


def masked(text: Column, tenant: Column, secret: str, mask_emails: bool = False) -> Column:
    """The text with all patterns replaced, in their fixed order."""
    return scanned(text, tenant, secret, mask_emails)["text"]


def _found(text: Column, tenant: Column, secret: str, mask_emails: bool) -> Column:
    """array<struct<entity_type, original_value>> of everything the patterns take, in order."""
    return F.transform(scanned(text, tenant, secret, mask_emails)["found"], lambda hit: hit.dropFields("token"))


def mask_text(
    df: DataFrame, column: str, secret: str, tenant: str = "tenant_id", mask_emails: bool = False, found: str | None = None
) -> DataFrame:
    """Replace personal data in a text column.

    ``found`` names a column for what was taken, from the same scan: store the result and give it to
    :func:`vault_of`, and the patterns run once for texts and vault together.
    """
    one = scanned(F.col(column), F.col(tenant), secret, mask_emails)
    if found is None:
        return df.withColumn(column, one["text"])
    # one generator row holds the struct, so that the scan is not repeated for its fields
    both = df.select("*", F.inline(F.array(one)).alias("_masked", "_found"))
    named = {column: F.col("_masked").alias(column), found: F.col("_found").alias(found)}
    kept = [named.get(c, F.col(f"`{c}`")) for c in df.columns]
    return both.select(*kept, *([named[found]] if found not in df.columns else []))


def vault_of(masked_texts: DataFrame, found: str, tenant: str = "tenant_id") -> DataFrame:
    """The distinct vault rows of texts masked with ``found``; duplicates go on the map side."""
    hits = masked_texts.select(tenant, F.inline(F.col(found)))
    return hits.select(tenant, "token", "original_value", "entity_type").distinct()


def found_values(df: DataFrame, column: str, secret: str, tenant: str = "tenant_id", mask_emails: bool = False) -> DataFrame:
    """(tenant, token, original_value, entity_type) for every match, not yet distinct."""
    text = F.col(column)
    # the outer form keeps the optimizer from running the whole scan again as a filter in front
    return (
        df.filter(_worth_looking(text, mask_emails))
        .select(tenant, F.inline_outer(scanned(text, F.col(tenant), secret, mask_emails)["found"]))
        .filter(F.col("entity_type").isNotNull())
        .select(tenant, "token", "original_value", "entity_type")
    )


def vault(df: DataFrame, column: str, secret: str, tenant: str = "tenant_id", mask_emails: bool = False) -> DataFrame:
    """The distinct found values; duplicates go on the map side."""
    return found_values(df, column, secret, tenant, mask_emails).distinct()


def unmask_text(df: DataFrame, vault_df: DataFrame, column: str, row_key: str, tenant: str = "tenant_id") -> DataFrame:
    """Put original values back for tokens of the row's own tenant; other tokens stay.

    Only rows that hold a token travel, the others are passed on as they are read.  A token that fills a third
    of all texts is a hot key of the vault join: the tokens are first made distinct per row, and the join is
    between two plain shuffles, which the adaptive join splits.
    """
    text = F.col(column)
    # a plain search finds the rows that may hold a token; what only looks like one finds no vault row
    has_token = F.coalesce(F.contains(text, F.lit("[VAULT_")), F.lit(False))
    parted = df.filter(has_token).withColumn("_parts", _parted(_guarded(text), TOKEN))
    tokens = F.array_distinct(F.filter("_parts", lambda _, at: at % 2 == 1))
    pairs = (
        parted.select(row_key, tenant, F.explode(tokens).alias("token"))
        .join(vault_df.select(tenant, "token", "original_value"), [tenant, "token"])
        # bounded by the distinct tokens of one row
        .groupBy(row_key)
        .agg(F.map_from_entries(F.collect_list(F.struct("token", "original_value"))).alias("_back"))
    )

    def restore(piece: Column, at: Column) -> Column:
        return F.when(at % 2 == 1, F.coalesce(F.element_at(F.col("_back"), piece), piece)).otherwise(_unguarded(piece))

    restored = F.array_join(F.transform("_parts", restore), "")
    back = parted.join(pairs, row_key, "left").withColumn(column, F.when(F.col("_back").isNotNull(), restored).otherwise(text))
    return back.select(*df.columns).unionByName(df.filter(~has_token))


def mask_record(
    df: DataFrame, secret: str, tenant: str = "tenant_id", sensitive: list[str] | None = None
) -> DataFrame:
    """Walk the schema: sensitive fields become tokens, other strings are masked as text.

    Structs and arrays of structs are followed; arrays of scalars stay as they are.
    """
    names = {s.lower() for s in (sensitive or refdata.SENSITIVE_KEYS)}
    owner = F.col(tenant)

    def rewrite(value: Column, kind: T.DataType, name: str) -> Column:
        scalar = isinstance(kind, (T.StringType, T.NumericType, T.BooleanType))
        if scalar and name.lower() in names:
            text = value.cast("string")
            return F.when(value.isNotNull(), token(F.lit(name.upper()), text, owner, secret))
        if isinstance(kind, T.StringType):
            return masked(value, owner, secret)
        if isinstance(kind, T.StructType):
            return _struct(value, kind)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.transform(value, lambda item: _struct(item, kind.elementType))
        return value

    def _struct(value: Column, kind: T.StructType) -> Column:
        parts = F.struct(*[rewrite(value[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), parts)

    return df.select(
        *[
            F.col(f.name) if f.name == tenant else rewrite(F.col(f.name), f.dataType, f.name).alias(f.name)
            for f in df.schema.fields
        ]
    )


def record_vault(
    df: DataFrame, secret: str, tenant: str = "tenant_id", sensitive: list[str] | None = None
) -> DataFrame:
    """Vault rows of every token :func:`mask_record` makes: sensitive fields at any depth, and what it finds in texts."""
    names = {s.lower() for s in (sensitive or refdata.SENSITIVE_KEYS)}
    owner = F.col(tenant)
    none = F.array().cast("array<struct<entity_type:string,original_value:string>>")

    def entries(value: Column, kind: T.DataType, name: str) -> Column | None:
        scalar = isinstance(kind, (T.StringType, T.NumericType, T.BooleanType))
        if scalar and name.lower() in names:
            one = F.struct(F.lit(name.upper()).alias("entity_type"), value.cast("string").alias("original_value"))
            return F.when(value.isNotNull(), F.array(one)).otherwise(none)
        if isinstance(kind, T.StringType):
            looked = F.when(_worth_looking(value, False), _found(value, owner, secret, False))
            return F.coalesce(looked, none)
        if isinstance(kind, T.StructType):
            return _within(value, kind)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            if _within(F.lit(None), kind.elementType) is None:
                return None
            return F.coalesce(F.flatten(F.transform(value, lambda item: _within(item, kind.elementType))), none)
        return None

    def _within(value: Column, kind: T.StructType) -> Column | None:
        parts = [entries(value[f.name], f.dataType, f.name) for f in kind.fields]
        parts = [part for part in parts if part is not None]
        return F.concat(*parts) if parts else None

    parts = [entries(F.col(f.name), f.dataType, f.name) for f in df.schema.fields if f.name != tenant]
    parts = [part for part in parts if part is not None] or [none]
    return (
        df.select(tenant, F.inline_outer(F.concat(*parts)))
        .filter(F.col("entity_type").isNotNull())
        .withColumn("token", token(F.col("entity_type"), F.col("original_value"), owner, secret))
        .select(tenant, "token", "original_value", "entity_type")
        .distinct()
    )


def pii_literals(df: DataFrame, row_key: str) -> DataFrame:
    """(row_key, literal): name parts longer than one letter, e-mail addresses and phone."""
    names = F.filter(
        F.split(F.trim(F.coalesce(F.col("full_name"), F.lit(""))), r"(?U)\s+"), lambda part: F.length(part) > 1
    )
    others = [F.col(c) for c in ("email", "work_email", "personal_email", "phone") if c in df.columns]
    rest = F.filter(F.array(*others), lambda v: v.isNotNull() & (v != "")) if others else F.array().cast("array<string>")
    return df.select(row_key, F.explode(F.concat(names, rest)).alias("literal"))


def leaked_literals(literals: DataFrame, texts: DataFrame, row_key: str, column: str) -> DataFrame:
    """Literals of a row that its masked text still holds."""
    return literals.join(texts.select(row_key, column), row_key).filter(F.contains(F.col(column), F.col("literal"))).select(
        row_key, "literal"
    )
