"""What the operators of this folder share: registration, words, stored steps, labels of linked rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crewframe.session import cut, discard, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: the white space of the contracts: blank and 0x09-0x0D
SPACE = " \t\n\x0b\f\r"


def query(name: str, sql: str | None = None):
    """Register a query of this folder; executors get the package."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return build(spark, sf_dir)

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    only_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def words(text: Column) -> Column:
    """Lower-case words of a text; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def text_key(text: Column) -> list[Column]:
    """128 bits that name a text, stable when a lost task is run again."""
    full = F.coalesce(text, F.lit(""))
    return [F.xxhash64(full), F.xxhash64(F.lit("second"), full)]


def write_blobs(blobs: DataFrame, path: str, ending: bytes) -> None:
    """Each binary value of column ``content`` as one file below ``path``, byte for byte; each must end in ``ending``.

    Spark's text writer puts them there, so files are committed like any output, on any store, whatever executors are
    lost: a row is the value less its ending, which is the separator that the writer adds.
    """
    body = F.expr(f"substring(content, 1, octet_length(content) - {len(ending)})").cast("string").alias("value")
    out = blobs.select(body).write.option("lineSep", ending.decode("latin-1")).option("encoding", "ISO-8859-1")
    out.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(content) of every file of :func:`write_blobs`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.filter("length > 0").select("content")


def row_key(docs: DataFrame) -> Column:
    """64 bits over all columns that can be hashed: equal for rows that are alike in them."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not re.search("map<|variant", kind)])


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``edges`` (u, v): rows (node, root).

    Alternates the large-star and the small-star step, each a combining minimum and an equi-join that
    adaptive execution can split at hubs; every round is a stored table and the one before is dropped.
    Nodes without an edge to another node do not come out.
    """
    pairs = cut(edges.filter("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct())
    state = _digest(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        )
        large = cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        discard(edges.sparkSession, pairs, large)
        pairs, before = after, state
        state = _digest(pairs)
        if state == before:
            break
    return pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _digest(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.min("v"), F.max("u")).first())
