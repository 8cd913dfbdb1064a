import random

import numpy as np
import xxhash
from helpers import ODD, documents, prose, words

from crewframe.llm import near_dup as nd
from crewframe.llm.base import components


def print_of(text, width=3):
    w = words(text)
    grams = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=3):
    prints = [print_of(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted(((i, f"{p:016x}", least.get(g)) for (i, _), p, g in zip(rows, prints, group)), key=repr), group


def near(text, seed):
    w = text.split()
    w[random.Random(seed).randrange(len(w))] = "changed"
    return " ".join(w)


def table():
    base = [prose(s, 400) for s in range(6)]
    rows = [(10 + i, near(base[i % 6], i) if i > 5 else base[i]) for i in range(30)]
    return rows + [(200 + i, base[0]) for i in range(20)] + ODD


def test_equals_brute_force(spark):
    rows = table()
    got = sorted((tuple(r) for r in nd.near_duplicates(documents(spark, rows)).collect()), key=repr)
    assert got == brute(rows)[0]


def test_one_of_each_group_stays(spark):
    rows = table()
    kept = nd.keep_one(documents(spark, rows, extra=True))
    assert "m" in kept.columns and "code" in kept.columns
    _, group = brute(rows)
    assert kept.count() == len(set(group))
    expected = {min((i for (i, _), h in zip(rows, group) if h == g and i is not None), default=None) for g in set(group)}
    assert {r.doc_id for r in kept.collect()} == expected


def test_only_null_ids(spark):
    rows = [(None, "a b c"), (None, "a b c"), (None, "x y z q")]
    assert nd.keep_one(documents(spark, rows)).count() == 2
    assert [r.component_id for r in nd.near_duplicates(documents(spark, rows)).collect()] == [None] * 3


def test_empty_table(spark):
    assert nd.near_duplicates(documents(spark, [])).collect() == []
    assert nd.keep_one(documents(spark, [])).collect() == []


def test_trees_find_every_link():
    draw = np.random.default_rng(3)
    for n in (1, 2, 40, 300):
        centre = draw.integers(0, 1 << 63, 3, dtype=np.uint64)
        flips = np.array([sum(1 << int(b) for b in draw.choice(64, draw.integers(0, 5), replace=False)) for _ in range(n)], np.uint64)
        codes = np.unique(centre[draw.integers(0, 3, n)] ^ flips)
        root = nd.tree_links(codes, 3)
        linked = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3
        assert not (linked & (root[:, None] != root[None, :])).any()
        reach = linked.copy()
        for _ in range(12):
            reach = (reach.astype(int) @ reach.astype(int)) > 0
        assert (reach == (root[:, None] == root[None, :])).all()


def test_shards_hold_every_pair_within_the_radius(spark):
    draw = random.Random(5)
    codes = [draw.getrandbits(64) for _ in range(40)]
    near = [c ^ sum(1 << b for b in draw.sample(range(64), 3)) for c in codes]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(c),) for c in {*codes, *near}], "code long")
    got = {(r.u, r.v) for r in nd.link_codes(df, 3).collect()}
    assert {frozenset(map(signed, p)) for p in zip(codes, near)} <= {frozenset(p) for p in got}


def test_components_of_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 60)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(chain + star + [(7, 7)], "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(60)}}


def test_long_text_in_steps():
    h = nd.shingle_hashes(prose(9, 3000), 3)
    step, nd.STEP = nd.STEP, 100
    try:
        small = nd.simhash(h)
    finally:
        nd.STEP = step
    assert small == nd.simhash(h)


def set_of(text, width=5):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def alike(rows, least=0.8):
    """Group of each row, all pairs compared."""
    sets, group = [set_of(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if group[i] != group[j] and (a == b or len(a & b) >= least * len(a | b)):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def test_texts_alike_meet(spark):
    base = [prose(s, 300) for s in range(4)]
    rows = [(i, base[i % 4]) for i in range(8)]
    rows += [(10 + i, near(near(near(base[i % 4], i), i + 50), i + 90)) for i in range(24)]  # up to 15 shingles of 296
    rows += [(60 + i, base[0][: 300 + 250 * i]) for i in range(5)] + [(100 + i, base[0]) for i in range(30)] + ODD
    group = alike(rows)
    far = [(print_of(rows[i][1]) ^ print_of(rows[i % 4][1])).bit_count() for i in range(8, 32)]
    assert sum(d > 3 for d in far) > 3  # beyond the radius of op8
    kept = nd.keep_one_similar(documents(spark, rows, extra=True))
    assert "m" in kept.columns and "code" in kept.columns and "name" not in kept.columns
    expected = [min((i for (i, _), h in zip(rows, group) if h == g and i is not None), default=None) for g in set(group)]
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, expected))
    assert nd.keep_one_similar(documents(spark, [])).collect() == []


def templates(n, own=6, changed=10):
    """``n`` pairs of texts in one template: the texts of a pair are alike (0.82), those of two pairs are not (0.74)."""
    shared, rows = prose(77, 1010).split(), []
    for i in range(n):
        draw = random.Random(i)
        slots = draw.sample(range(0, 1000, 6), own + 2 * changed)
        for side in range(2):
            w = list(shared)
            for k in slots[:own]:
                w[k] = f"p{i}x{k}"
            for k in slots[own + side * changed :][:changed]:
                w[k] = f"s{i}x{side}x{k}"
            rows.append((2 * i + side, " ".join(w)))
    return rows


def test_pairs_in_a_template_are_not_lost(spark):
    rows = templates(100)
    group = alike(rows)
    sets = [set_of(t) for _, t in rows]
    of = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.83 > of(0, 1) >= 0.8 > of(0, 2) > 0.7 and len(set(group)) == 100
    kept = sorted(r.doc_id for r in nd.keep_one_similar(documents(spark, rows)).collect())
    assert kept == sorted(min(i for (i, _), h in zip(rows, group) if h == g) for g in set(group))


def test_large_parts_are_cut_into_groups(spark, monkeypatch):
    monkeypatch.setattr(nd, "GROUP", 8)
    rows = templates(30)
    kept = [r.doc_id for r in nd.keep_one_similar(documents(spark, rows)).collect()]
    assert len(set(alike(rows))) <= len(kept) < 36


def test_only_compared_texts_link(spark, monkeypatch):
    # every two texts are candidates; the whole texts decide
    monkeypatch.setattr(nd, "DOUBT", 2.0)
    w = prose(3, 100).split()
    rows = [(1, " ".join(w)), (2, " ".join([*w, "eins", "zwei"])), (3, " ".join(w[:75])), (4, " ".join(w[10:]))]
    got = {r.doc_id for r in nd.keep_one_similar(documents(spark, rows)).collect()}
    group = alike(rows)
    assert got == {min(i for (i, _), h in zip(rows, group) if h == g) for g in set(group)} != {1, 2, 3, 4}


def test_heavy_shards_are_parted_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(nd, "SHARD", 4)
    draw = random.Random(8)
    centres = [draw.getrandbits(64) for _ in range(3)]
    codes = {centres[i % 3] ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(4))) for i in range(150)}
    codes = sorted(codes | {draw.getrandbits(64) for _ in range(40)})
    rows = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    roots = {r.node: r.root for r in components(nd.link_codes(spark.createDataFrame(rows, "code long"), 3)).collect()}
    group = list(range(len(codes)))
    for i, a in enumerate(codes):
        for j in range(i):
            if (a ^ codes[j]).bit_count() <= 3 and group[i] != group[j]:
                new, old = group[j], group[i]
                group = [new if g == old else g for g in group]
    found = [roots.get(r[0], r[0]) for r in rows]
    for i in range(len(codes)):
        for j in range(i):
            assert (found[i] == found[j]) == (group[i] == group[j])


def test_three_partings_bound_a_shard():
    masks = nd.family_masks(3)
    for _ in range(2):
        masks = [m for fixed in masks for m in nd.family_masks(3, fixed=fixed)]
    assert len(masks) == 1000 and min(m.bit_count() for m in masks) >= 48


def test_tree_tells_pairs_that_are_near_themselves():
    rng = np.random.default_rng(5)
    codes = np.unique(np.bitwise_xor.accumulate(np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)))
    met = []
    root = nd.tree_links(codes, 3, met)
    assert all(int(codes[a] ^ codes[b]).bit_count() <= 3 for a, b in met)
    parent = list(range(len(codes)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in met:
        parent[top(a)] = top(b)
    assert len({top(x) for x in range(len(codes))}) == len(set(root.tolist()))


def test_similar_texts_meet_by_trees_alone(spark, monkeypatch):
    """The pipeline's near-dedup links SimHashes with BK-trees first; a link counts after its texts were compared."""
    words = [f"w{n}" for n in range(400)]
    near = words[:399] + ["other"]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[::-1])), (4, " ".join(words).upper())]
    none = lambda *a: nd.cut(spark.createDataFrame([], "u long, v long"))
    monkeypatch.setattr(nd, "hub_pairs", none)
    monkeypatch.setattr(nd, "open_pairs", none)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in nd.keep_one_similar(docs).collect()) == [1, 3]
