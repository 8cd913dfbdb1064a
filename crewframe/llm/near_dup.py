"""Near-duplicate texts by SimHash, linked with BK-trees and joined to components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crewframe.llm.base import components, query, read, row_key
from crewframe.session import cut, discard

BITS, SEED = 64, 42
#: codes of a shard that one tree holds before its shard is parted anew, and families of shards at most
SHARD, FAMILIES = 1 << 14, 1 << 12
#: hashes of a long text that are counted at a time
STEP = 1 << 16
#: minima of a text's shingles under as many orders, in bands of so many that must all be equal for two texts to meet
MINIMA, BAND = 120, 5
#: estimated similarity (from the last byte of each minimum) below which a pair is not compared: 5 standard errors under 0.8
DOUBT = 0.2
#: texts of a bucket that all meet; how often a larger bucket is parted anew, and by the marks of how many more minima
GROUP, FINE, FINE_MARKS = 64, 6, 8
ORDERS = np.random.default_rng(SEED).integers(1 << 63, size=(2, MINIMA), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` lower-case words, of the whole sequence if there are fewer words."""
    found = (text or "").encode().lower().split()  # bytes: A-Z only, and the six blanks of the contract
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(found))
    hashed = xxhash.xxh64_intdigest
    spans = zip(starts[: len(found) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((hashed(joined[a:b], SEED) for a, b in spans), np.uint64, len(found) - width + 1)


def simhash(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes, as a signed 64-bit number; zero for none."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), STEP):
        part = hashes[at : at + STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text, width: int = 3):
    """Column: SimHash of a text over shingles of ``width`` words; zero for a null or empty text."""

    @F.pandas_udf("long")
    def simhashed(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(shingle_hashes(t, width)) for t in texts], dtype="int64")

    return simhashed(text)


def distances(codes: np.ndarray, code: np.uint64) -> np.ndarray:
    return np.bitwise_count(codes ^ code)


def tree_links(codes: np.ndarray, radius: int, met: list | None = None) -> np.ndarray:
    """Root of each code: the first code of its component at ``radius``, by position.

    A BK-tree holds the codes: a node's children are keyed by their distance to it.  It is built and searched
    in one walk: the codes that look for neighbours travel together and follow only the edges whose distance
    is within ``radius`` of their own distance to the node, so a node is visited once for all of them.  Only one
    link per component is kept, never the pairs of a dense group.  ``met`` receives, for each two components that
    meet, one pair of positions that are within ``radius`` themselves.
    """
    root = np.arange(len(codes))
    stack = [(np.arange(len(codes)), np.arange(len(codes)))]
    while stack:
        members, seekers = stack.pop()
        node, rest = members[0], members[1:]
        away = distances(codes[seekers], codes[node]).astype(np.int16)
        near = seekers[away <= radius]
        near_roots = np.unique(root[near])
        if len(near_roots) > 1:
            if met is not None:
                firsts = near[np.unique(root[near], return_index=True)[1]]
                met.extend((int(one), int(node)) for one in firsts[root[firsts] != root[node]])
            root[np.isin(root, near_roots)] = near_roots[0]
        if not len(rest):
            continue
        key = distances(codes[rest], codes[node])
        for edge in np.unique(key):
            follow = seekers[np.abs(away - np.int16(edge)) <= radius]
            below = rest[key == edge]
            # codes of one component that reach nothing outside it have nothing to find there
            if len(follow) and not (root[follow[0]] == root[below[0]] and _one(root, follow) and _one(root, below)):
                stack.append((below, follow))
    return root


def _one(root: np.ndarray, members: np.ndarray) -> bool:
    return bool((root[members] == root[members[0]]).all())


def family_masks(radius: int, agree: int = 2, fixed: int = 0) -> list[int]:
    """The bits that a family's shards share, for each family, so that any two codes that are equal in the ``fixed`` bits and
    within ``radius`` bits share a shard.

    The other bits are cut into ``radius + agree`` blocks; at most ``radius`` blocks differ, so at least ``agree`` blocks
    are equal, and each choice of ``agree`` blocks is a family.  Two blocks give keys of some 25 of 64 bits, which keeps
    shards small where one block would not.
    """
    free = [bit for bit in range(BITS) if not fixed >> bit & 1]
    blocks = radius + agree
    edges = [round(i * len(free) / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << bit for bit in free[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return [fixed | sum(masks[i] for i in chosen) for chosen in combinations(range(blocks), agree)]


def _placed(rows: DataFrame, masks: list[list[int]], first: int) -> DataFrame:
    """(family, block, code) of the rows (parent, code) in each family of their parent; families count from ``first``."""
    signed = [[m - (1 << BITS) if m >> (BITS - 1) else m for m in group] for group in masks]
    of_parent = F.split(F.element_at(F.array(*[F.lit(",".join(map(str, g))) for g in signed]), F.col("parent") + 1), ",")
    met = rows.select("parent", "code", F.posexplode(of_parent.cast("array<long>")).alias("at", "mask"))
    family = (F.col("parent") * len(masks[0]) + F.col("at") + first).cast("int")
    return met.select(family.alias("family"), F.col("code").bitwiseAND(F.col("mask")).alias("block"), "code")


def _forest(radius: int, near: bool = False):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (family, block, code); a shard may go over the end of a batch."""

        def of(family: np.ndarray, block: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.r_[True, (family[1:] != family[:-1]) | (block[1:] != block[:-1])])
            size = np.diff(np.r_[first, len(code)])
            us, vs = [], []
            for at, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
                codes = code[at : at + n].view(np.uint64)
                met = [] if near else None
                root = tree_links(codes, radius, met)
                child = np.flatnonzero(root != np.arange(n))
                ends = (child, root[child]) if met is None else np.array(met, np.int64).reshape(-1, 2).T
                us.append(codes[ends[0]].view(np.int64)), vs.append(codes[ends[1]].view(np.int64))
            empty = [np.empty(0, np.int64)]
            return pa.record_batch(
                [pa.array(np.concatenate(us or empty)), pa.array(np.concatenate(vs or empty))], names=["u", "v"]
            )

        kept = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)]
        for batch in batches:
            part = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            kept = [np.concatenate(x) for x in zip(kept, part, strict=True)]
            if not len(kept[0]):
                continue
            changes = np.flatnonzero((kept[0] != kept[0][-1]) | (kept[1] != kept[1][-1]))
            open_shard = int(changes[-1]) + 1 if len(changes) else 0
            if open_shard:
                yield of(*[x[:open_shard] for x in kept])
                kept = [x[open_shard:] for x in kept]
        if len(kept[0]):
            yield of(*kept)

    return links


def link_codes(codes: DataFrame, radius: int, near: bool = False) -> DataFrame:
    """Forests of links between distinct codes (``code``) of at most ``radius`` differing bits: rows (u, v).

    The components of the links are those of all pairs within the radius; with ``near`` each link is itself such a pair, not
    one to the first code of the component.  Each shard's tree goes to one task
    with the shard's codes, by a shuffle: trees of a whole corpus have no size bound to broadcast under.

    A shard of more than SHARD codes is parted anew by its other bits, in the same way, so no task holds a dense cloud of
    codes: at a radius of 3 the third parting leaves 16 bits at most, so 2^16 distinct codes to a tree at most.  A wide
    radius has so many families that it stops earlier (FAMILIES).
    """
    spark = codes.sparkSession
    masks, first = [family_masks(radius)], 0
    shards = _placed(codes.select(F.lit(0).alias("parent"), "code"), masks, first)
    ready, passing = None, []
    while True:
        heavy = cut(shards.groupBy("family", "block").agg(F.count("*").alias("held")).filter(F.col("held") > SHARD))
        passing.append(heavy)
        deeper = [family_masks(radius, fixed=mask) for group in masks for mask in group]
        last = heavy.isEmpty() or len(deeper) * len(deeper[0]) > FAMILIES
        light = shards if last else shards.join(heavy, ["family", "block"], "left_anti")
        ready = light if ready is None else ready.unionByName(light)
        if last:
            break
        split = shards.join(heavy, ["family", "block"], "left_semi").select((F.col("family") - first).alias("parent"), "code")
        first += len(deeper)
        masks = deeper
        shards = cut(_placed(split, masks, first))
        passing.append(shards)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = ready.select("family", "block", "code").repartition(n, "family", "block").sortWithinPartitions("family", "block", "code")
    links = cut(placed.mapInArrow(_forest(radius, near), "u long, v long"))
    discard(spark, *passing)
    return links


def classes(prints: DataFrame, radius: int = 3) -> DataFrame:
    """``prints`` (doc_id, code) to (code, root, component_id): the component, and the smallest doc_id in it.

    Equal codes meet before anything is linked, so a large group of copies is one code.
    """
    firsts = cut(prints.groupBy("code").agg(F.min("doc_id").alias("first_id")))
    links = link_codes(firsts.select("code"), radius)
    roots = components(links)
    discard(prints.sparkSession, links)
    placed = firsts.join(roots, firsts.code == roots.node, "left").select(
        "code", "first_id", F.coalesce("root", "code").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return placed.join(least, "root").select("code", "root", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs``.

    The fingerprint is the SimHash of the shingles of ``width`` lower-case words as 16 hex digits; null, empty and
    blank texts have zero and link like any other.  Codes link at ``radius`` or fewer differing bits;
    ``component_id`` is the smallest doc_id reachable, itself included (null only if the whole component has none).
    Repeated rows come out as often as they came in; an empty table gives none.
    """
    prints = cut(docs.select("doc_id", fingerprint(F.col(text), width).alias("code")))
    found = prints.join(classes(prints, radius), "code")
    return found.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` less all but one row of each component: the one with the smallest doc_id (null ids come last).

    Rows that repeat that doc_id within the component are told apart by a hash of their columns; rows equal
    in all of them count as one.  All columns stay as they are, also ones named like those used here.
    """
    row = row_key(docs)
    prints = cut(docs.select("doc_id", row.alias("row"), fingerprint(F.col(text), width).alias("code")))
    groups = prints.join(classes(prints.select("doc_id", "code"), radius), "code")
    return _first_rows(docs, row, groups)


def _first_rows(docs: DataFrame, row, groups: DataFrame) -> DataFrame:
    """The first row of ``docs`` of each root in ``groups`` (doc_id, row, root)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = groups.groupBy("root").agg(first.alias("first")).select(F.struct("first.doc_id", "first.row").alias("key"))
    packed = docs.select(F.struct("*").alias("all"), F.struct("doc_id", row.alias("row")).alias("key"))
    return packed.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("all.*")


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash under each of MINIMA orders."""
    out = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        part = hashes[at : at + (1 << 12)]
        np.minimum(out, (ORDERS[0][:, None] * part + ORDERS[1][:, None]).min(axis=1), out=out)
    return out


SKETCH = "name long, code long, print long, n int, bands array<long>, marks binary"


def sketches(docs: DataFrame, text: str, width: int) -> DataFrame:
    """(doc_id, row, SKETCH) of each row of ``docs`` (doc_id, row, name, text): name of the set of shingles, its SimHash, its size, a value
    for each band of minima, and the last byte of each.  Texts are taken from the Arrow batch one by one."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, prints, sizes, bands, marks = [], [], [], [], []
            for t in batch.column("text"):
                hashes = np.unique(shingle_hashes(t.as_py(), width))
                least = minima(hashes)
                values = [xxhash.xxh64_intdigest(least[a : a + BAND].tobytes(), a) for a in range(0, MINIMA, BAND)]
                codes.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                prints.append(simhash(hashes))
                sizes.append(len(hashes))
                bands.append(np.array(values, np.uint64).view(np.int64))
                marks.append((least >> np.uint64(56)).astype(np.uint8).tobytes())
            made = {c: batch.column(c) for c in ("doc_id", "row", "name")}
            yield pa.RecordBatch.from_pydict(
                made | {
                    "code": pa.array(np.array(codes, np.uint64).view(np.int64)), "print": pa.array(prints, pa.int64()), "n": pa.array(sizes, pa.int32()),
                    "bands": pa.array(bands, pa.list_(pa.int64())), "marks": pa.array(marks, pa.binary()),
                }
            )

    rows = docs.select("doc_id", "row", "name", F.col(text).alias("text"))
    return rows.mapInArrow(sketched, f"doc_id {kind}, row long, {SKETCH}")


def estimate(left, right):
    """Column: similarity by the share of equal marks."""

    @F.pandas_udf("double")
    def estimated(left: pd.Series, right: pd.Series) -> pd.Series:
        a, b = (np.frombuffer(b"".join(map(bytes, m)), np.uint8).reshape(-1, MINIMA) for m in (left, right))
        return pd.Series(((a == b).mean(axis=1) - 1 / 256) * 256 / 255)

    return estimated(left, right)


def alike(pairs: DataFrame, width: int, least: float) -> DataFrame:
    """(u, v) of the ``pairs`` (u, v, t_u, t_v) whose whole texts share enough shingles.

    Texts are taken from the Arrow batch one by one, so a task holds a batch and the sets of two texts.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            kept = []
            for v, left, right in zip(batch.column("v").to_pylist(), batch.column("t_u"), batch.column("t_v"), strict=True):
                if held is None or v != last:  # rows mostly come sorted by the right text's code
                    last, held = v, np.unique(shingle_hashes(right.as_py(), width))
                own = np.unique(shingle_hashes(left.as_py(), width))
                both = len(np.intersect1d(own, held, assume_unique=True))
                kept.append(both >= least * max(1, len(own) + len(held) - both))
            yield batch.select(["u", "v"]).filter(pa.array(kept, pa.bool_()))

    return pairs.select("u", "v", "t_u", "t_v").mapInArrow(compare, "u long, v long")


def near_pairs(entries: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """(u, v, estimate): the ``pairs`` (u, v) whose sizes and marks allow for a similarity of ``least``, stored."""
    side = lambda c: entries.select(F.col("code").alias(c), F.col("n").alias(f"n_{c}"), F.col("marks").alias(f"m_{c}"))
    sized = pairs.join(side("u"), "u").join(side("v"), "v").filter(F.least("n_u", "n_v") >= least * F.greatest("n_u", "n_v"))
    near = sized.select("u", "v", estimate("m_u", "m_v").alias("estimate")).filter(F.col("estimate") >= least - DOUBT)
    return cut(near)


def print_pairs(entries: DataFrame, radius: int) -> DataFrame:
    """(u, v): every text with the first one of its SimHash, and the first texts of SimHashes that a BK-tree links."""
    spark = entries.sparkSession
    firsts = cut(entries.groupBy("print").agg(F.min("code").alias("first")))
    links = link_codes(firsts.select(F.col("print").alias("code")), radius, near=True)
    first = lambda c: firsts.select(F.col("print").alias(c), F.col("first").alias(f"f_{c}"))
    wide = links.join(first("u"), "u").join(first("v"), "v").selectExpr("greatest(f_u, f_v) u", "least(f_u, f_v) v")
    equal = entries.select("code", "print").join(firsts, "print").filter("code <> first").selectExpr("code u", "first v")
    pairs = cut(wide.unionByName(equal).distinct())
    discard(spark, firsts, links)
    return pairs


def hub_pairs(buckets: DataFrame) -> DataFrame:
    """(u, v): every text of a bucket with three of its texts, so that a large group of near copies makes rows in
    proportion and soon is one component."""
    drawn = F.min(F.struct(F.xxhash64("code", "bucket").alias("draw"), "code"))
    hubs = buckets.groupBy("bucket").agg(F.min("code").alias("a"), F.max("code").alias("b"), drawn.alias("c"))
    hubs = hubs.filter("a < b").select("bucket", F.array_distinct(F.array("a", "b", "c.code")).alias("hubs"))
    met = buckets.join(hubs, "bucket").select("code", F.explode("hubs").alias("hub")).filter("code <> hub")
    return cut(met.selectExpr("greatest(code, hub) u", "least(code, hub) v").distinct())


def open_pairs(entries: DataFrame, buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """(u, v): pairs of texts of one bucket that ``roots`` (node, root) does not link.

    Buckets whose texts are one component have none.  In the others all texts meet in groups of at most GROUP: a small bucket
    is a group, and a larger one is parted FINE times by the marks of FINE_MARKS more minima, which near texts share more
    often than others; what is still larger is sorted by further marks and cut into groups.  The sort goes over the
    whole cluster, so no bucket needs a task of its own.
    """
    spark = entries.sparkSession
    placed = buckets.join(roots.withColumnRenamed("node", "code"), "code", "left")
    placed = cut(placed.select("bucket", "band", "code", F.coalesce("root", "code").alias("root")))
    mixed = placed.groupBy("bucket", "band").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("held"))
    mixed = cut(mixed.filter("a < b").select("bucket", "band", "held"))
    members = placed.join(mixed, ["bucket", "band"]).join(entries.select("code", "marks"), "code")
    turns = F.when(F.col("held") <= GROUP, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(FINE - 1)))
    members = members.select("*", F.explode(turns).alias("turn"))
    ring = F.concat("marks", "marks")
    at = F.pmod(F.col("band") * BAND + BAND + F.col("turn") * FINE_MARKS, F.lit(MINIMA))
    part = F.when(F.col("turn") >= 0, F.substring(ring, at + 1, F.lit(FINE_MARKS)))
    # the order by which a part that is still large is cut: other marks, then the code
    further = F.substring(ring, F.pmod(at + FINE_MARKS, F.lit(MINIMA)) + 1, F.lit(MINIMA // 2))
    key = F.xxhash64("bucket", "band", "turn", part)
    parted = cut(members.select(key.alias("key"), further.alias("further"), F.struct("code", "root").alias("one")))
    sizes = cut(parted.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))
    small = parted.join(sizes.filter(F.col("size") <= GROUP), "key").groupBy("key").agg(F.collect_list("one").alias("held"))
    order = ["key", "further", "one"]
    large = parted.join(sizes.filter(F.col("size") > GROUP), "key").select(order)
    large = cut(large.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("range", "key").orderBy("further", "one"))
    # cut twice, half a group apart, so that neighbours at an edge meet as well
    edges = F.array(F.floor(place / GROUP) * 2, F.floor((place + GROUP // 2) / GROUP) * 2 + 1)
    large = large.withColumn("edges", edges).select("key", "range", "one", F.explode("edges").alias("group"))
    large = large.groupBy("key", "range", "group").agg(F.collect_list("one").alias("held"))
    each = small.select("held").unionByName(large.select("held")).select("held", F.explode("held").alias("one"))
    other = F.filter("held", lambda o: (o["code"] < F.col("one.code")) & (o["root"] != F.col("one.root")))
    pairs = each.select(F.col("one.code").alias("u"), F.explode(other).alias("other")).select("u", F.col("other.code").alias("v"))
    pairs = cut(pairs.distinct())
    discard(spark, placed, mixed, parted, sizes)
    return pairs


def similar_roots(docs: DataFrame, entries: DataFrame, text: str, width: int, least: float, radius: int) -> DataFrame:
    """(node, root) of the codes linked by pairs of texts with a similarity of ``least``, each compared in full.

    First the texts whose SimHashes BK-trees link within ``radius`` bits (see :func:`print_pairs`).  Texts of the least similarity
    differ in some ten bits, a radius at which a tree prunes nothing, so those still apart meet by bands of minima:
    each text with the hub most like it, then with its other hubs that are not yet in its component, then
    all texts of a bucket that are still apart.
    """
    spark = docs.sparkSession
    buckets = cut(entries.select("code", F.posexplode("bands").alias("band", "bucket")))

    def texts_of(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("u").alias("code")).union(pairs.select("v")).distinct().join(entries.select("code", "name"), "code")
        named = docs.select(F.xxhash64(F.col(text)).alias("name"), F.col(text).alias("text"))
        return cut(named.join(wanted, "name").select("code", "text").dropDuplicates(["code"]))

    def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        sides = [texts.select(F.col("code").alias(c), F.col("text").alias(f"t_{c}")) for c in "uv"]
        both = pairs.select("u", "v").join(sides[0], "u").join(sides[1], "v")
        return cut(alike(both, width, least))

    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r_{c}"))
        placed = pairs.join(root("u"), "u", "left").join(root("v"), "v", "left")
        return placed.filter(F.coalesce("r_u", "u") != F.coalesce("r_v", "v"))

    joined = lambda old, new: cut(components(old.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(new)))
    met = print_pairs(entries, radius)
    texts = texts_of(met)
    links = verified(met, texts)
    linked = cut(components(links))
    discard(spark, met, texts, links)

    met = hub_pairs(buckets)
    sized = near_pairs(entries, met, least)
    near = cut(apart(sized, linked).select("u", "v", "estimate"))
    texts = texts_of(near)
    best = near.groupBy("u").agg(F.max(F.struct("estimate", "v")).alias("best")).select("u", F.col("best.v").alias("v"))
    best = cut(best)
    links = verified(best, texts)
    roots = joined(linked, links)
    more = verified(apart(near.join(best, ["u", "v"], "left_anti"), roots), texts)
    wider = joined(roots, more)
    discard(spark, met, sized, near, texts, best, links, linked, roots, more)

    met = open_pairs(entries, buckets, wider)
    near = near_pairs(entries, met, least)
    texts = texts_of(near)
    last = verified(near, texts)
    out = joined(wider, last)
    discard(spark, buckets, met, near, texts, last, wider)
    return out


def keep_one_similar(docs: DataFrame, text: str = "text", width: int = 5, least: float = 0.8, radius: int = 3) -> DataFrame:
    """``docs`` less all but one row of each group of texts linked by a similarity of at least ``least``.

    The similarity is the Jaccard index of the sets of shingles of ``width`` lower-case words, a text of fewer words
    being one shingle.  Candidates have SimHashes that a BK-tree links, or share a band of minima (see :func:`similar_roots`); only pairs whose whole texts were
    compared link.  Which row stays is as in :func:`keep_one`; texts without words are one group.
    """
    row = row_key(docs)
    named = docs.select("doc_id", row.alias("row"), F.xxhash64(F.col(text)).alias("name"), F.col(text).alias("text"))
    prints = cut(sketches(named, "text", width))
    firsts = [F.first(c).alias(c) for c in ("name", "print", "n", "bands", "marks")]
    entries = cut(prints.groupBy("code").agg(*firsts))
    roots = similar_roots(docs, entries.filter("n > 0"), text, width, least, radius)
    discard(docs.sparkSession, entries)
    groups = prints.select("doc_id", "row", "code").join(roots, F.col("code") == F.col("node"), "left")
    return _first_rows(docs, row, groups.select("doc_id", "row", F.coalesce("root", "code").alias("root")))


@query("op8_simhash_near_dup")
def op8_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
