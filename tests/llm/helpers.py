"""Small tables with everything that may stand in them."""

import random
import re

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(["der", "la", "of", "un"]) + draw.choice("abcdefgh") + str(draw.randrange(50)) for _ in range(n))


def documents(spark, rows, extra=False):
    """Rows (doc_id, text) as a documents table; with ``extra``, columns named like those the operators use inside."""
    full = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]
    df = spark.createDataFrame(full, DOC).repartition(3)
    if extra:
        df = df.selectExpr(
            "*", "1 as code", "'k' as row", "2 as h1", "3 as t1", "'x' as score", "5 as n_lines", "map('a', 1) as m", "null as nothing",
            "cast(null as string) as `we.ird`", "1 as __t", "2 as _t", "3 as _l", "4 as _gone", "5 as __fixes", "6 as __new", "7 as __kept",
            "8 as __host", "9 as __digest", "10 as __lines",
        )
    return df


ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (None, "one two"), (None, None), (5, "Ünïcode ß İ 数   x"),
    (6, "\n\n"), (7, prose(1, 30_000)), (8, "a\r\nb"),
]
