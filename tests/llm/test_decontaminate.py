from collections import Counter

from helpers import ODD, documents, prose, words

from crewframe.llm import decontaminate as dc

BENCH = "item_id long, text string"


def similarity(a, b, k=5):
    grams = lambda w: Counter(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))
    x, y = grams(a), grams(b)
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


def brute(rows, items):
    """Documents and items of which some window of the item's length is alike."""
    out = set()
    for i, t in rows:
        w = words(t)
        for j, s in items:
            v = words(s)
            if v and len(v) >= 5:
                spots = range(max(1, len(w) - len(v) + 1))
                if any(similarity(w[p : p + len(v)], v) >= 0.8 for p in spots if len(w[p : p + len(v)]) >= 5):
                    out.add((i, j))
    return out


def planted():
    items = [(i, prose(500 + i, 15 + 6 * i)) for i in range(8)] + [(20, None), (21, "  "), (8, prose(500, 15)), (22, "Two words")]
    rows = []
    for i in range(40):
        body = prose(i, 60).split()
        passage = (items[i % 8][1] or "").split()
        if i % 4 == 1:
            passage = [w.upper() for w in passage]
        if i % 4 == 2:
            passage[-1] = "other"
        if i % 4 == 3:
            passage[len(passage) // 2] = "other"
        rows.append((i, " ".join(body[:20] + passage + body[20:])))
    rows += [(100 + i, items[3][1]) for i in range(3)] + [(200, " ".join(items[5][1].split()[:20])), (201, prose(77, 80)), (202, "of two words here")]
    return rows + [(r + 300 if r is not None else None, t) for r, t in ODD], items


def test_equals_brute_force(spark):
    rows, items = planted()
    docs = documents(spark, rows)
    found = dc.leaks(docs, spark.createDataFrame(items, BENCH))
    keyed = docs.select("doc_id", *[k.alias(n) for k, n in zip(dc.text_key(docs.text), ("t1", "t2"))])
    got = {(r.doc_id, r.item) for r in keyed.join(found, ["t1", "t2"]).collect()}
    assert {p for p in got if p[1] != 22} == brute(rows, items)
    assert (202, 22) in got


def test_clean_documents_stay(spark):
    rows, items = planted()
    kept = dc.drop_leaks(documents(spark, rows, extra=True), spark.createDataFrame(items, BENCH))
    gone = {i for i, _ in brute(rows, items)} | {202}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _ in rows if i not in gone), key=repr)
    assert kept.columns == documents(spark, [], extra=True).columns and kept.filter("__t = 1 and t1 = 3").count() == kept.count()


def test_beyond_the_broadcast_limit(spark, monkeypatch):
    rows, items = planted()
    docs, bench = documents(spark, rows), spark.createDataFrame(items, BENCH)
    near = sorted(map(tuple, dc.leaks(docs, bench).collect()))
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, dc.leaks(docs, bench).collect())) == near


def test_items_that_repeat_and_ties(spark):
    items = [(1, prose(1, 20)), (1, prose(1, 20)), (2, prose(1, 20)), (1, prose(2, 20))]
    text = " ".join([prose(1, 20), prose(9, 7), prose(1, 20)])
    got = dc.leaks(documents(spark, [(1, text), (2, text), (3, prose(2, 20))]), spark.createDataFrame(items, BENCH))
    assert sorted((r.item, r.start, r.n_words, r.similarity) for r in got.collect()) == [(1, 0, 20, 1.0), (1, 0, 20, 1.0), (2, 0, 20, 1.0)]


def test_items_of_one_length_do_not_meet_every_window(spark, monkeypatch):
    """Pairs are made for the items that share the window's shingle, not for all of its length."""
    items = [(i, prose(900 + i, 30)) for i in range(60)]
    rows = [(i, prose(i, 20) + " " + t) for i, t in items]
    sizes = []
    real = dc.cut

    def counted(df, *by):
        out = real(df, *by)
        if out.columns == ["t1", "t2", "start", "n", "item"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(dc, "cut", counted)
    assert dc.leaks(documents(spark, rows), spark.createDataFrame(items, BENCH)).count() == 60
    assert len(sizes) == 1 and sizes[0] < 5 * 60


def test_empty_tables(spark):
    rows, items = planted()
    empty = documents(spark, [])
    assert dc.leaks(empty, spark.createDataFrame(items, BENCH)).collect() == []
    assert dc.drop_leaks(documents(spark, rows), spark.createDataFrame([], BENCH)).count() == len(rows)


def test_blocks_cover_the_radius():
    masks = dc.blocks(24)
    assert sum(m & (2**64 - 1) for m in masks) == 2**64 - 1 and len(masks) == 25


def test_no_python(spark):
    rows, items = planted()
    plan = dc.drop_leaks(documents(spark, rows), spark.createDataFrame(items, BENCH))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
