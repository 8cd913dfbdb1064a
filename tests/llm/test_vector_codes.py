import hashlib
import math
import random

import pytest

from crewframe.llm import vector_codes as vc

SHAPE = "vec_id long, embedding array<float>, label int"


def brute(rows, rounds=6):
    """(vec_id, label, code, error) and the digest of the codebooks, by plain integers."""
    kept = [(i, lab, v) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    long = max((len(v) for *_, v in kept), default=0)
    w = max(1, -(-long // 8))
    kept = [(i, lab, [math.floor(4096 * x) for x in v] + [0] * (8 * w - len(v))) for i, lab, v in kept]
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:16]
    out = [["", 0] for _ in kept]
    every = []
    for p in range(8):
        parts = [v[p * w : (p + 1) * w] for *_, v in kept]
        book = [v[p * w : (p + 1) * w] for *_, v in seeds]

        def find(x, book):
            return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

        for _ in range(rounds):
            at = [find(x, book)[1] for x in parts]
            for k in range(len(book)):
                own = [x for x, a in zip(parts, at, strict=True) if a == k]
                if own:
                    book[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
        for row, x in zip(out, parts, strict=True):
            d, k = find(x, book)
            row[0] += f"{k:02x}"
            row[1] += d
        every += book
    digest = hashlib.sha256(",".join(str(c) for e in every for c in e).encode()).hexdigest()
    return sorted(((i, lab, *o) for (i, lab, _), o in zip(kept, out, strict=True)), key=str), digest


def vectors(n, width, seed=3):
    draw = random.Random(seed)
    centres = [[draw.uniform(-0.4, 0.4) for _ in range(width)] for _ in range(30)]
    return [(i, [float(c + draw.gauss(0, 0.05)) for c in centres[i % 30]], i % 4 if i % 7 else None) for i in range(n)]


def f32(rows):
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]


@pytest.mark.parametrize("width", [64, 8, 13, 3])
def test_equals_brute_force(spark, width):
    rows = f32(vectors(260, width))
    draw = random.Random(1)
    rows += [(1000 + i, rows[5][1], 1) for i in range(150)]  # a third are one vector
    rows += [(5, rows[9][1], 2), (None, rows[4][1], None), (None, rows[4][1], None)]
    rows += [(-1, None, 1), (-2, [None] * width, 1), (-3, [float("nan")] * width, 1), (-4, [float("inf")] * width, 1)]
    draw.shuffle(rows)
    made = vc.encode(spark.createDataFrame(rows, SHAPE).repartition(5))
    want, digest = brute(rows)
    assert sorted(map(tuple, made.rows.collect()), key=str) == want
    assert made.books_sha256 == digest


def test_fewer_rows_than_entries_and_mixed_lengths(spark):
    rows = f32([(3, [0.5] * 9, 1), (1, [], 2), (2, [0.25, -0.25], None), (2, [0.25, -0.25], None)])
    made = vc.encode(spark.createDataFrame(rows, SHAPE))
    want, digest = brute(rows)
    assert sorted(map(tuple, made.rows.collect()), key=str) == want and made.books_sha256 == digest
    assert made.books.shape == (8, 4, 2)


def test_huge_components_keep_to_64_bits(spark):
    rows = [(i, [3e38 if i % 2 else -3e38] * 64, 0) for i in range(40)]
    got = vc.encode(spark.createDataFrame(rows, SHAPE)).rows.collect()
    assert len(got) == 40 and all(r.error == 0 for r in got)


def test_empty_and_clashing_columns(spark):
    none = vc.encode(spark.createDataFrame([(1, None, 1)], SHAPE))
    assert none.rows.collect() == [] and none.books_sha256 == hashlib.sha256(b"").hexdigest()
    rows = f32(vectors(40, 8))
    more = spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 as row", "2 as position", "'x' as entry", "3 as salt", "4 as part", "true as moves")
    assert sorted(map(tuple, vc.encode(more).rows.collect()), key=str) == brute(rows)[0]


def test_only_changed_parts_are_shuffled(spark, monkeypatch):
    """Once assigned, a part that keeps its entry stays in its files."""
    seen = []
    real = vc.cut

    def counted(df, *by):
        out = real(df, *by)
        if by:
            seen.append((out.count(), out.filter("moves").count()))
        return out

    monkeypatch.setattr(vc, "cut", counted)
    vc.encode(spark.createDataFrame(vectors(300, 16), SHAPE))
    assert seen[0] == (2400, 2400) and len(seen) == 7
    assert all(moved < n / 3 for n, moved in seen[2:]) and sum(moved for _, moved in seen[1:]) > 0


def test_decode(spark):
    rows = f32(vectors(50, 16))
    made = vc.encode(spark.createDataFrame(rows, SHAPE))
    exact = {i: [math.floor(4096 * x) for x in v] for i, v, _ in rows}
    for r in made.rows.collect():
        assert sum((a - b) ** 2 for a, b in zip(exact[r.vec_id], vc.decode(r.code, made.books).tolist(), strict=True)) == r.error
