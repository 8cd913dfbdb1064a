"""Vectors as short codes: Lloyd's rounds over parts that stay where their entry is kept."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crewframe.llm.base import query, read
from crewframe.session import cut, discard

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6


@dataclass(frozen=True)
class Codes:
    """``rows``: (vec_id, label, code, error).  ``books``: entries by part, entry and component."""

    rows: DataFrame
    books: np.ndarray

    @property
    def books_sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def component_bound(width: int) -> int:
    """Largest size of a component whose squared distances over ``width`` of them stay below 2^62."""
    return math.isqrt((1 << 62) // max(width, 1)) // 2


def whole_numbers(vector: Column, width: int) -> Column:
    """floor(4096 x) of every component, followed by zeros up to ``width``, none beyond the bound of that width."""
    most = float(component_bound(width))
    scaled = F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), x.cast("double") * SCALE))).cast("int"))
    return F.concat(scaled, F.array_repeat(F.lit(0), F.lit(width) - F.size(vector)))


def usable(vector: Column) -> Column:
    """Neither null nor with a null, NaN or infinite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row of ``parts``; ties go to the lower entry."""
    best = np.zeros(len(parts), np.int32)
    least = ((parts - book[0]) ** 2).sum(axis=1)
    for k in range(1, len(book)):
        far = ((parts - book[k]) ** 2).sum(axis=1)
        closer = far < least
        best[closer], least[closer] = k, far[closer]
    return best, least


STATE = "row long, vec_id long, label int, position int, entry int, salt int, part array<int>"


def _assign(state: DataFrame, books: np.ndarray) -> DataFrame:
    """``state`` with every part's nearest entry, its distance, and whether that is another entry than before."""
    width = books.shape[2]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position = batch.column("position").to_numpy()
            before = batch.column("entry").to_numpy()
            parts = _matrix(batch.column("part"), width)
            entry, error = np.zeros(len(parts), np.int32), np.zeros(len(parts), np.int64)
            for p in np.unique(position):
                here = position == p
                entry[here], error[here] = nearest(parts[here], books[p])
            made = {name: batch.column(name) for name in batch.schema.names}
            made |= {"entry": pa.array(entry), "error": pa.array(error), "moves": pa.array(entry != before)}
            yield pa.RecordBatch.from_pydict(made)

    return state.mapInArrow(assign, STATE + ", error long, moves boolean")


def _sums(state: DataFrame, width: int) -> DataFrame:
    """(position, entry, place, count, total): each owner's members counted and added up, component by component."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = _matrix(batch.column("part"), width)
            owner = batch.column("position").to_numpy().astype(np.int64) * ENTRIES + batch.column("entry").to_numpy()
            owners, member, counts = np.unique(owner, return_inverse=True, return_counts=True)
            totals = np.zeros((len(owners), width), np.int64)
            np.add.at(totals, member, parts)
            yield pa.RecordBatch.from_pydict(
                {
                    "position": pa.array(np.repeat(owners // ENTRIES, width).astype(np.int32)),
                    "entry": pa.array(np.repeat(owners % ENTRIES, width).astype(np.int32)),
                    "place": pa.array(np.tile(np.arange(width, dtype=np.int32), len(owners))),
                    "n": pa.array(np.repeat(counts, width)), "total": pa.array(totals.ravel()),
                }
            )

    columns = "position int, entry int, place int, n long, total long"
    made = state.select("position", "entry", "part").mapInArrow(add, columns)
    return made.groupBy("position", "entry", "place").agg(F.sum("n"), F.sum(F.col("total").cast("decimal(38,0)")))


def encode(vectors: DataFrame, rounds: int = ROUNDS, parts: int = PARTS) -> Codes:
    """Code every usable row of ``vectors`` (vec_id, embedding, label) by ``parts`` entries of codebooks fitted to all rows.

    Rows whose vector is null or holds a null, NaN or infinite component are dropped.  Vectors shorter than the longest,
    and lengths that ``parts`` do not divide, count as followed by zeros; components beyond :func:`component_bound` count as
    that bound, as their distances would leave 64 bits.  A codebook starts with the parts of the 16 smallest ids (null
    ids last, equal ids by vector); fewer rows give fewer entries.  Repeated rows count and are coded each.  Without rows
    there are no codes and no entries.

    Parts live with the owner of their entry: files dealt by (position, entry, salt), where the salt spreads an
    entry that holds many.  A round adds up each owner's members where they lie, moves the entries, and assigns
    all parts anew in one narrow pass; only parts whose entry has changed go through the next shuffle.  The
    driver sees the entries and their sums, which do not grow with the rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), "embedding").filter(usable(F.col("embedding")))
    longest = rows.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        none = spark.createDataFrame([], "vec_id long, label int, code string, error long")
        return Codes(none, np.zeros((parts, 0, 0), np.int64))
    width = max(1, -(-longest // parts))
    numbers = whole_numbers(F.col("embedding"), width * parts).alias("numbers")
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", numbers))
    first = rows.select("vec_id", "numbers").orderBy(F.col("vec_id").asc_nulls_last(), "numbers").limit(ENTRIES).collect()
    books = np.array([r.numbers for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()

    cells = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = F.transform(
        F.sequence(F.lit(0), F.lit(parts - 1)),
        lambda p: F.struct(p.cast("int").alias("position"), F.slice("numbers", p * width + 1, F.lit(width)).alias("part")),
    )
    # the id and label go with a vector's first part only
    started = rows.select("row", "vec_id", "label", F.explode(split).alias("s")).select(
        "row", F.when(F.col("s.position") == 0, F.col("vec_id")).alias("vec_id"),
        F.when(F.col("s.position") == 0, F.col("label")).alias("label"), F.col("s.position").alias("position"),
        F.lit(-1).alias("entry"), F.pmod(F.xxhash64("row"), F.lit(cells)).cast("int").alias("salt"), F.col("s.part").alias("part"),
    )
    names = [c.split()[0] for c in STATE.split(", ")]
    laid = cut(_assign(started, books), "moves")
    older: list[DataFrame] = [rows]
    for _ in range(rounds):
        for position, entry, place, n, total in _sums(laid, width).collect():
            books[position, entry, place] = int(total) // n
        stay, move = laid.filter("not moves").select(names), laid.filter("moves").select(names)
        owned = stay.unionByName(move.repartition("position", "entry", "salt"))
        discard(spark, *older)
        older = [laid]
        laid = cut(_assign(owned, books), "moves")
    discard(spark, *older)

    entry_of = [F.max(F.when(F.col("position") == p, F.col("entry"))) for p in range(parts)]
    coded = laid.groupBy("row").agg(
        F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), F.sum("error").alias("error"),
        F.lower(F.concat(*[F.lpad(F.hex(e), 2, "0") for e in entry_of])).alias("code"),
    )
    return Codes(coded.select("vec_id", "label", "code", "error"), books)


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for, in 4096ths."""
    return np.concatenate([books[p, int(code[2 * p : 2 * p + 2], 16)] for p in range(len(books))])


def _sql() -> str:
    """The rounds written out."""
    far = "list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    ctes = [
        f"""k AS MATERIALIZED (
        SELECT row_number() OVER () AS row, vec_id, label,
          list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""p AS MATERIALIZED (
        SELECT row, vec_id, i AS position, v[(i * len(v) // {PARTS} + 1):((i + 1) * len(v) // {PARTS})] AS part
        FROM k, range({PARTS}) AS r(i))""",
        f"""c0 AS MATERIALIZED (
        SELECT position, row_number() OVER (PARTITION BY position ORDER BY vec_id) - 1 AS j, part AS entry FROM p
        QUALIFY j < {ENTRIES})""",
    ]
    for n in range(ROUNDS + 1):
        ctes.append(f"""a{n} AS MATERIALIZED (
        SELECT row, position, any_value(part) AS part, min(struct_pack(d := {far}, j := j)) AS best FROM p JOIN c{n} USING (position)
        GROUP BY row, position)""")
        if n < ROUNDS:
            ctes.append(f"""c{n + 1} AS MATERIALIZED (
            SELECT position, j, coalesce(moved, entry) AS entry FROM c{n} LEFT JOIN (
              SELECT position, j, list(m ORDER BY place) AS moved FROM (
                SELECT position, best.j AS j, place, floor(sum(part[place + 1])::DOUBLE / count(*))::BIGINT AS m
                FROM a{n}, range((SELECT max(len(part)) FROM p)) AS r(place) GROUP BY ALL) GROUP BY ALL) USING (position, j))""")
    return "WITH " + ",\n".join(ctes) + f""",
    f AS (SELECT row, string_agg(printf('%02x', best.j), '' ORDER BY position) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY row)
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (
        SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY position, j)) FROM c{ROUNDS}) AS codebooks_sha256
    FROM f JOIN k USING (row)"""


@query("op11_vector_codes", _sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable vectors coded, with the error of their label."""
    made = encode(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    rows = cut(made.rows)
    labels = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = rows.join(labels, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(made.books_sha256).alias("codebooks_sha256"))
