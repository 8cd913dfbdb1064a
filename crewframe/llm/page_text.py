"""Main text of web pages, found by the differences between pages with near URLs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crewframe.llm.base import query, read
from crewframe.session import cut

#: bits of the table that aligns two pages; for longer pages it is made in parts
ALIGN_BITS = 1 << 28

# What HTML says about elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math canvas object audio video select".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
CHROME_TAGS = set("head nav header footer aside form menu dialog button fieldset".split())
CHROME_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CHROME_NAMES = set(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar banner cookie cookies consent "
    "gdpr notice notices alert ad ads advert adverts advertisement adsense sponsor sponsored promo popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social comment comments disqus reply replies related "
    "recommended recommendations trending search pagination pager toolbar widget widgets skip copyright".split()
)
#: parts of a class or id that say enough wherever they stand in it, unless another part denies or only mentions them
CHROME_PARTS = set(
    "comment comments disqus sidebar cookie cookies consent gdpr advert adverts advertisement adsense sponsored breadcrumb breadcrumbs "
    "newsletter masthead topbar navbar pagination".split()
)
MENTIONS = set("no not without has have with is hide hidden".split())
CONTAINER_TAGS = {"article": 2, "main": 1}
#: whole classes or ids of an element that holds the article where no tag says so
CONTAINER_NAMES = set("article article-body article-content post-content entry-content post-body story-body main-content".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>""", re.DOTALL
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)


def evidence(tag: str, attributes: str) -> int:
    """Whether an element is no part of a page's main text: 2 by its tag, role, style, a whole class or id, or a part of one
    that says enough ("comment-list", "left-sidebar"), 1 by another part
    ("search-result", "no-sidebar"), else 0.  An article or main part is not judged by its names.
    """
    if tag in CHROME_TAGS:
        return 2
    if not attributes or tag in ("body", "html"):
        return 0
    found = 0
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return 2
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return 2
        if name == "role" and value in CHROME_ROLES:
            return 2
        if name in ("class", "id") and tag not in CONTAINER_TAGS:
            if not CHROME_NAMES.isdisjoint(value.split()):
                return 2
            for one in value.split():
                parts = set(re.split(r"[_-]+", one))
                if not CHROME_PARTS.isdisjoint(parts) and MENTIONS.isdisjoint(parts):
                    return 2
                if not CHROME_NAMES.isdisjoint(parts):
                    found = 1
    return found


def holds_article(attributes: str) -> bool:
    """Whether a class or id of an element names the article."""
    return any(
        name.lower() in ("class", "id") and not CONTAINER_NAMES.isdisjoint(value.strip("\"'").lower().split())
        for name, value in ATTRIBUTE.findall(attributes)
    )


def lines_of(html: str | None) -> list[tuple[str, int, int]]:
    """(line, container, chrome) of a page: its text by block, with white space made one blank.

    ``container`` is 2 inside an article, 1 inside a main part or an element named as the article's, else 0; ``chrome`` is the :func:`evidence`.  Scripts, styles, comments and markup give
    no line.  Tags that are not closed end with the element around them.
    """
    html = html or ""
    out: list[tuple[str, int, int]] = []
    stack: list[tuple[str, int, int]] = []  # tag, container and chrome within it
    depth: dict[str, int] = {}
    words: list[str] = []

    def end_line() -> None:
        line = " ".join(unescape("".join(words)).split()) if words else ""
        if line:
            _, container, chrome = stack[-1] if stack else ("", 0, 0)
            out.append((line, container, chrome))
        words.clear()

    at = 0
    while found := TOKEN.search(html, at):
        if found.start() > at:
            words.append(html[at : found.start()])
        at = found.end()
        closing, tag, attributes = found.group(1), found.group(2), found.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if depth.get(tag):
                if tag not in INLINE:
                    end_line()
                while True:
                    name = stack.pop()[0]
                    depth[name] -= 1
                    if name == tag:
                        break
            continue
        if tag not in INLINE:
            end_line()
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
            continue
        _, container, chrome = stack[-1] if stack else ("", 0, 0)
        if tag in CONTAINER_TAGS and not evidence(tag, attributes):
            # a form around the whole page is no reason to lose the article in it
            chrome = 0 if all(t == "form" or not evidence(t, "") for t, _, _ in stack) else chrome
            container = max(container, CONTAINER_TAGS[tag])
        else:
            chrome = max(chrome, evidence(tag, attributes))
            if attributes and tag in ("div", "section", "td") and holds_article(attributes):
                container = max(container, 1)
        stack.append((tag, container, chrome))
        depth[tag] = depth.get(tag, 0) + 1
    words.append(html[at:])
    end_line()
    return out


def line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode()) - (1 << 63)


def _rows(own: list[int], other: list[int]) -> Iterator[int]:
    """For each length of a beginning of ``other`` a row of bits: bit i is unset where entry i of ``own`` adds to the best."""
    places: dict[int, int] = {}
    for i, value in enumerate(own):
        places[value] = places.get(value, 0) | (1 << i)
    full = (1 << len(own)) - 1
    row = full
    yield row
    for value in other:
        hit = row & places.get(value, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _best(own: list[int], other: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of each beginning of ``own`` with ``other``."""
    for row in _rows(own, other):
        pass
    bits = np.frombuffer(row.to_bytes(len(own) // 8 + 1, "little"), np.uint8)
    adds = 1 - np.unpackbits(bits, bitorder="little")[: len(own)].astype(np.int64)
    return np.concatenate(([0], np.cumsum(adds)))


def common(own: list[int], other: list[int]) -> list[bool]:
    """Which entries of ``own`` belong to a longest common subsequence with ``other``.

    Bit-parallel rows over ``own``, one per entry of ``other``, then the way back.  Beyond ALIGN_BITS the rows are not held:
    ``other`` is cut in half, ``own`` where the bests of the two sides have the largest sum, and each side goes on alone.
    """
    shared = [False] * len(own)
    stack = [(0, len(own), 0, len(other))]
    while stack:
        start, a, used, b = stack.pop()
        while start < a and used < b and own[start] == other[used]:
            shared[start] = True
            start, used = start + 1, used + 1
        while a > start and b > used and own[a - 1] == other[b - 1]:
            a, b = a - 1, b - 1
            shared[a] = True
        piece, rest = own[start:a], other[used:b]
        if not piece or not rest:
            continue
        if len(rest) > 1 and len(piece) * len(rest) > ALIGN_BITS:
            half = len(rest) // 2
            sums = _best(piece, rest[:half]) + _best(piece[::-1], rest[half:][::-1])[::-1]
            at = int(sums.argmax())
            stack += [(start, start + at, used, used + half), (start + at, a, used + half, b)]
            continue
        rows = list(_rows(piece, rest))
        i, j = len(piece) - 1, len(rest)
        while i >= 0 and j > 0:
            if rows[j] >> i & 1:  # entry i adds nothing to the best with the first j
                i -= 1
            elif not rows[j - 1] >> i & 1:
                j -= 1
            else:
                shared[start + i] = True
                i, j = i - 1, j - 1
    return shared


def main_text(html: str | None, partner: list[int] | None) -> str:
    """Lines of a page that are neither chrome nor shared with ``partner``, the line hashes of a page near it.

    Lines inside the page's article (its main part, if there is no article) stay even when the partner has them:
    articles quote each other.  Of the rest, and of blocks with weak evidence of chrome anywhere, what the partner
    has goes and what is the page's own stays.  Without a partner such blocks go, and the rest of a page that has
    an article or main part.
    """
    lines = lines_of(html)
    sure = max((container for _, container, chrome in lines if not chrome), default=0)
    shared = common([line_hash(line) for line, _, _ in lines], partner) if partner else None
    kept = []
    for i, (line, container, chrome) in enumerate(lines):
        if not chrome and sure and container == sure:
            kept.append(line)
        elif chrome < 2 and not shared[i] if shared else not chrome and not sure:
            kept.append(line)
    return " ".join(kept)


def neighbours(pages: DataFrame) -> DataFrame:
    """(host, digest, partner): for each distinct page of a host the digest of the page with the nearest URL path.

    ``pages``: (host, path, digest).  Copies of a page count once, with their first path, so a page's partner is
    another page.  All pages are sorted by host and path over the cluster; only the first and last row of each
    sorted part, one pair per task, meet in one window, so a host of any size needs no task of its own.
    The nearer of the two neighbours has the path that is fewer edits away, the one before if equal.
    """
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = pages.groupBy("host", "digest").agg(F.min("path").alias("path"))
    key = ["host", "path", "digest"]
    ordered = cut(first.repartitionByRange(n, *key).select(*key, F.spark_partition_id().alias("part")))
    entry = F.struct(*key)
    within = Window.partitionBy("part").orderBy(*key)
    ends = ordered.groupBy("part").agg(F.min(entry).alias("head"), F.max(entry).alias("tail"))
    parts = Window.orderBy("part")  # one row per sorted part
    ends = ends.select("part", F.lag("tail").over(parts).alias("prior"), F.lead("head").over(parts).alias("next"))
    sided = ordered.withColumn("before", F.lag(entry).over(within)).withColumn("after", F.lead(entry).over(within))
    sided = sided.join(F.broadcast(ends), "part")  # bounded by the number of tasks
    sided = sided.withColumn("before", F.coalesce("before", "prior")).withColumn("after", F.coalesce("after", "next"))

    def apart(side: str):
        """Edits between the paths, 33 for more than 32; null if the neighbour is of another host."""
        edits = F.levenshtein(F.col("path"), F.col(f"{side}.path"), 32)
        return F.when(F.col(f"{side}.host") == F.col("host"), F.when(edits < 0, 33).otherwise(edits))

    near = sided.withColumn("b", apart("before")).withColumn("a", apart("after"))
    is_before = F.coalesce(F.col("b") <= F.coalesce("a", F.lit(34)), F.lit(False))
    partner = F.when(is_before, F.col("before.digest")).when(F.col("a").isNotNull(), F.col("after.digest"))
    return near.select("host", "digest", partner.alias("partner"))


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        lines = [[line_hash(line) for line, _, _ in lines_of(h)] for h in batch["html"]]
        yield pd.DataFrame({"host": list(batch["host"]), "digest": list(batch["digest"]), "lines": lines})


HASHES = "host string, digest string, lines array<long>"


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``: the main text of ``html`` and its code points.

    Pages are paired by URL path within their host (:func:`neighbours`); only line hashes travel between them.
    A null html or one without text gives an empty text; a null url is the host ''.  Pages without a partner
    keep all that is not chrome.  Repeated rows come out as often as they came in.  Columns of ``pages`` other
    than ``text`` and ``n_chars`` stay as they are.
    """
    where = F.lower(F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://", ""))
    host = F.regexp_extract(where, "^[^/?#]*", 0)
    path = F.regexp_replace(F.regexp_extract(where, "^[^/?#]*([^?#]*)", 1), r"(\.html?)?/*$", "")
    html = F.coalesce(F.col("html"), F.lit(""))
    digest = F.md5(html.cast("binary"))
    named = pages.select(host.alias("host"), path.alias("path"), digest.alias("digest"), html.alias("html"))
    pairs = neighbours(named.select("host", "path", "digest"))
    lines = named.select("host", "digest", "html").mapInPandas(_hashes, HASHES).dropDuplicates(["host", "digest"])
    partners = pairs.join(lines.select("host", F.col("digest").alias("partner"), "lines"), ["host", "partner"])
    partners = cut(partners.select("host", "digest", "lines"))

    @F.pandas_udf("string")
    def text(htmls: pd.Series, near: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, None if n is None else list(n)) for h, n in zip(htmls, near, strict=True)], dtype=object)

    packed = pages.select(F.struct("*").alias("all"), host.alias("host"), digest.alias("digest"))
    out = packed.join(partners, ["host", "digest"], "left").select("all", text(F.col("all.html"), F.col("lines")).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    kept = [new[c].alias(c) if c in new else F.col("all").getField(c).alias(c) for c in pages.columns]
    return out.select(*kept, *[v.alias(c) for c, v in new.items() if c not in pages.columns])


@query("op10_page_text")
def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
