"""Personal data replaced by surrogates: keyed, of the same kind and format, distinct and the same everywhere."""

from __future__ import annotations

import hashlib
import hmac
import re
import string
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewframe.llm.base import query, read, text_key
from crewframe.session import cut, discard

#: tries for an entity before the space of its format counts as used up; after that formats grow by a character
#: (an address of a private range leaves it), so an entity always finds a place
TRIES = 64

# Forms of address with the gender they tell, and the letters surrogate names are made of.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Dr": "n", "Prof": "n",
    "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f",
    "господин": "m", "госпожа": "f", "г-н": "m", "г-жа": "f",
}
SYLLABLES = {
    "latin": ("b c d f g h j k l m n p r s t v w z br dr gr kl st tr".split(), "a e i o u".split()),
    "cyrillic": ("б в г д ж з к л м н п р с т ф х ц ч ш".split(), "а е и о у".split()),
    "greek": ("β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ".split(), "α ε η ι ο".split()),
}
ENDINGS = {"latin": {"m": "n", "f": "a", "n": "el"}, "cyrillic": {"m": "н", "f": "а", "n": "ль"}, "greek": {"m": "ς", "f": "α", "n": "ω"}}

# Small words inside names, which stay, and the country calling codes of one and two digits (others have three).
PARTICLES = (
    "de", "del", "della", "der", "den", "di", "da", "das", "dos", "du", "la", "las", "le", "los", "van", "von", "zu", "ten", "ter", "y", "e",
    "al", "el", "bin", "ibn", "ben", "af", "av",
)
CALLING_CODES = {
    1: "1 7",
    2: "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98",
}

UPPER = r"[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ]"
LOWER = r"[a-zà-öø-ÿα-ωά-ώа-яё]"
PART = rf"(?:{UPPER}['’])?{UPPER}{LOWER}+(?:{UPPER}{LOWER}+)*"
PATTERNS = [
    ("SECRET", re.compile(
        r"""(?i)\b(?:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|token|password|passwd|pwd)["']?\s*(?:[:=]\s*["']?(?P<v>[A-Za-z0-9+/_.=-]{8,}+)|=\s*["']?(?P<short>[A-Za-z0-9+/_.=-]{1,7}+))"""
    )),
    ("SECRET", re.compile(r"\b(?P<v>(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9]{20,}+)\b")),
    ("EMAIL", re.compile(r"(?<![\w.+-])(?P<v>[\w.+-]++@[\w-]+(?:\.[\w-]+)+)")),
    ("IBAN", re.compile(r"\b(?P<v>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b")),
    ("IP", re.compile(r"(?<![\d.])(?P<v>(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3})(?![\d]|\.\d)")),
    ("CARD", re.compile(r"(?<![\w-])(?P<v>\d{4}([ -]?)\d{4}\2\d{4}\2\d{4}|3\d{3}([ -]?)\d{6}\3\d{5})(?![\w-])")),
    ("SSN", re.compile(r"(?<![\w-])(?P<v>\d{3}-\d{2}-\d{4})(?![\w-])")),
    ("PHONE", re.compile(
        r"(?<![\w+.-])(?P<v>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4})(?![\w-])"
    )),
    ("NAME", re.compile(
        rf"\b(?P<t>{'|'.join(map(re.escape, TITLES))})\.?[ ](?P<v>(?:(?:{UPPER}\.|{'|'.join(PARTICLES)})[ ])*+{PART}"
        rf"(?:(?:[ -](?:{UPPER}\.|{'|'.join(PARTICLES)}))*+[ -]{PART})*+)(?!\w)"
    )),
]
NEEDS = {"EMAIL": "@", "NAME": " "}
HAS_DIGIT = re.compile(r"\d")


class Mention(NamedTuple):
    start: int
    end: int
    kind: str
    value: str


def lowered(value: str) -> str:
    """Lower case, character by character; letters whose lower case is longer stay."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in value)


def code_length(digits: str) -> int:
    """Digits of the calling code that a number in international form starts with."""
    return next((n for n, codes in CALLING_CODES.items() if digits[:n] in codes.split()), 3)


def canonical(kind: str, value: str) -> str:
    """What mentions of one entity share, however they are written.  A phone number in international form keeps its sign,
    but for those of calling code 1, which are also written without it."""
    if kind in ("CARD", "SSN", "PHONE"):
        digits = re.sub(r"\D", "", value)
        if kind == "PHONE" and len(digits) == 11 and digits[0] == "1":
            return digits[1:]
        return "+" + digits if kind == "PHONE" and value[0] == "+" else digits
    if kind == "EMAIL":
        return lowered(value)
    if kind == "IBAN":
        return value.replace(" ", "")
    if kind == "IP":
        return ".".join(str(int(part)) for part in value.split("."))
    return value


def find(text: str | None) -> list[Mention]:
    """Mentions in order; where two overlap the earlier pattern holds.

    A name after a form of address also names its later mentions without one: each capitalised part of it
    is a mention wherever it stands in the text.  A name part's kind tells gender: NAME:m, NAME:f or NAME:n.
    """
    text = text or ""
    taken: list[Mention] = []
    parts: dict[str, str] = {}
    digits = HAS_DIGIT.search(text) is not None
    for kind, pattern in PATTERNS:
        if kind not in ("NAME", "EMAIL", "SECRET") and not digits or NEEDS.get(kind, "") not in text:
            continue
        for m in pattern.finditer(text):
            if kind == "NAME":
                gender = TITLES[m["t"]]
                for part in re.findall(PART, m["v"]):
                    parts[part] = gender if parts.get(part, "n") == "n" else parts[part]
            elif kind == "CARD" and luhn_sum(re.sub(r"\D", "", m["v"])):
                continue  # the sum of a card's digits is checked
            else:
                group = "short" if "short" in m.groupdict() and m["short"] else "v"
                taken.append(Mention(*m.span(group), kind, m[group]))
    if parts:
        named = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, parts), key=len, reverse=True)) + r")(?!\w)")
        taken += [Mention(*m.span(), f"NAME:{parts[m[0]]}", m[0]) for m in named.finditer(text)]
    order = sorted(range(len(taken)), key=lambda i: (taken[i].start, i))
    out, end = [], 0
    for i in order:
        if taken[i].start >= end:
            out.append(taken[i])
            end = taken[i].end
    return out


class _Digits:
    """Endless numbers below a bound from a keyed hash."""

    def __init__(self, key: bytes, *seed: str):
        self.key, self.seed, self.count, self.left = key, "\x1f".join(seed).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.new(self.key, self.seed + self.count.to_bytes(4, "big"), hashlib.sha256).digest()
            self.count += 1
        out, self.left = int.from_bytes(self.left[:4], "big") % n, self.left[4:]
        return out

    def like(self, value: str, letters: str | None = None) -> str:
        """Digits for digits, letters for letters of the same case, the rest as it is."""
        pick = lambda of: of[self.below(len(of))]
        return "".join(
            pick(string.digits) if c.isdigit() else pick(letters or string.ascii_lowercase) if "a" <= c <= "z"
            else pick((letters or string.ascii_lowercase).upper()) if "A" <= c <= "Z" else c
            for c in value
        )


def luhn_sum(digits: str) -> int:
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10


def iban_check(country: str, body: str) -> str:
    """The two check digits."""
    number = "".join(str(int(c, 36)) for c in f"{body}{country}00")
    return f"{98 - int(number) % 97:02d}"


def script_of(value: str) -> str:
    return "cyrillic" if re.search("[а-яё]", value.lower()) else "greek" if re.search("[α-ω]", value.lower()) else "latin"


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """Canonical surrogate of a canonical value: a keyed hash, so the same everywhere and by any task."""
    draw = _Digits(key, kind.split(":")[0], value, str(attempt))
    wider = max(0, attempt - TRIES + 1) // 4  # characters beyond the format
    if kind == "CARD":
        body = value[0] + draw.like(value[1:-1])
        return body + next(d for d in string.digits if luhn_sum(body + d) == 0)
    if kind == "PHONE" and value[0] == "+":
        kept = 1 + code_length(value[1:])
        return value[:kept] + draw.like(value[kept:])
    if kind == "PHONE":
        area = draw.like(value)
        return "".join(str(2 + int(c) % 8) if i % 3 == 0 and i < 4 and len(value) == 10 and c in "01" else c for i, c in enumerate(area))
    if kind == "IP":
        private = re.match(r"(?:10|127|192\.168)\.", value)
        fixed = private[0] if private and not wider else f"{1 + draw.below(223)}."
        return fixed + ".".join(str(draw.below(256)) for _ in range(4 - fixed.count(".")))
    if kind == "EMAIL":
        local, _, domain = value.rpartition("@")
        # all addresses of a domain move to one domain; its top level stays
        name, dot, top = domain.rpartition(".")
        return f"{draw.like(local)}{draw.like('a' * wider)}@{_Digits(key, 'DOMAIN', domain).like(name)}{dot}{top}"
    if kind == "IBAN":
        body = draw.like(value[4:])
        return value[:2] + iban_check(value[:2], body) + body
    if kind.startswith("NAME"):
        script = script_of(value)
        soft, open_ = SYLLABLES[script]
        stem = "".join(soft[draw.below(len(soft))] + open_[draw.below(len(open_))] for _ in range(2 + attempt // 8 + draw.below(2)))
        prefix = value[:2] if value[1:2] in "'’" else ""
        return prefix + (stem + ENDINGS[script][kind[-1]]).capitalize()
    hexadecimal = re.fullmatch("[0-9a-f]+|[0-9A-F]+", value)
    prefix = re.match("AKIA|ASIA|gh[pousr]_|sk-|", value)[0]  # tells what the secret opens
    return prefix + draw.like(value[len(prefix) :], "abcdef" if hexadecimal else None) + draw.like("a" * wider)


def render(kind: str, value: str, replaced: str) -> str:
    """The canonical surrogate in the way the mention is written."""
    if kind in ("CARD", "SSN", "PHONE"):
        digits = iter(replaced.removeprefix("+"))
        skip = len(re.sub(r"\D", "", value)) - len(replaced.removeprefix("+"))  # a country code stays
        out = []
        for c in value:
            if c.isdigit() and skip > 0:
                skip -= 1
                out.append(c)
            else:
                out.append(next(digits) if c.isdigit() else c)
        return "".join(out)
    if kind == "IBAN":
        letters = iter(replaced)
        return "".join(c if c == " " else next(letters) for c in value)
    if kind == "EMAIL" and len(value) == len(replaced):
        return "".join(b.upper() if a.isupper() and len(b.upper()) == 1 else b for a, b in zip(value, replaced, strict=True))
    return replaced


def replace(text: str | None, key: bytes, later: dict[tuple[str, str], tuple[int, str]]) -> tuple[str | None, list[str]]:
    """The text with surrogates, and the kinds replaced in order.  ``later``: attempt and kind of the entities (kind, value)
    that are not at their first attempt, or of another gender in all texts together than in this one."""
    if text is None:
        return None, []
    out, at, kinds = [], 0, []
    for start, end, kind, value in find(text):
        known = canonical(kind, value)
        attempt, whole = later.get((kind, known), (0, kind)) if later else (0, kind)
        out += [text[at:start], render(kind, value, surrogate(key, whole, known, attempt))]
        at = end
        kinds.append(kind)
    return "".join([*out, text[at:]]), kinds


def _mentions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = set()
        for text, *key in zip(batch["text"], batch["t1"], batch["t2"], strict=True):
            rows |= {(*key, m.kind, canonical(m.kind, m.value)) for m in find(text)}
        if rows:
            yield pd.DataFrame(sorted(rows), columns=["t1", "t2", "kind", "value"])


def one_gender(mentions: DataFrame) -> DataFrame:
    """(kind, value) of each entity of ``mentions`` (kind, value): a name has the gender that all texts together give it,
    none if they disagree or none tells."""
    family, gender = F.split("kind", ":")[0], F.get(F.split("kind", ":"), F.lit(1))
    told = F.collect_set(F.when(gender != "n", gender))  # two at most
    found = mentions.groupBy(family.alias("family"), "value").agg(told.alias("told"))
    whole = F.when(F.size("told") == 1, F.get("told", F.lit(0))).otherwise(F.lit("n"))
    return found.select(F.when(F.col("family") == "NAME", F.concat(F.lit("NAME:"), whole)).otherwise(F.col("family")).alias("kind"), "value")


def attempts(entities: DataFrame, key: bytes, make=surrogate) -> DataFrame:
    """``entities`` (kind, value; one kind of a family for a value) with the first attempt whose surrogate no other entity
    has: (kind, value, attempt, made), stored.

    Kinds of one family (names of any gender) share a space.  A surrogate that two entities would get stays with the smaller value; one that is
    itself an entity of the texts is not used.  Only those that lost one try again, against all that are settled, until none is left.
    """

    @F.pandas_udf("string")
    def made(kind: pd.Series, value: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([make(key, *e) for e in zip(kind, value, attempt, strict=True)], dtype=object)

    spark = entities.sparkSession
    family = F.split("kind", ":")[0].alias("family")
    all_ = cut(entities.select("kind", "value", family))
    real = all_.select("family", F.col("value").alias("made"), F.lit(True).alias("taken")).distinct()
    settled, lost, attempt = [], all_, 0
    while True:
        tried = cut(lost.withColumn("attempt", F.lit(attempt)).withColumn("made", made("kind", "value", "attempt")))
        owner = tried.groupBy("family", "made").agg(F.min("value").alias("owner"))
        judged = tried.join(owner, ["family", "made"]).withColumn("lost", F.col("owner") != F.col("value"))
        for taken in [real, *(s.select("family", "made", F.lit(True).alias("taken")) for s in settled)]:
            # few rows are tried again, and the planner knows their size
            judged = judged.join(taken, ["family", "made"], "left")
            judged = judged.withColumn("lost", F.col("lost") | F.coalesce("taken", F.lit(False))).drop("taken")
        judged = cut(judged.select("kind", "value", "family", "attempt", "made", "lost"))
        discard(spark, tried, *([lost] if attempt else []))
        settled.append(judged.filter(~F.col("lost")))
        lost = cut(judged.filter("lost").select("kind", "value", "family"))
        if lost.isEmpty():
            break
        attempt += 1
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return cut(out.select("kind", "value", "attempt", "made"))


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with every detected entity in ``text`` replaced, and ``kinds``: the kinds replaced, in order.

    Surrogates are keyed hashes of the canonical value, so a mention needs no table: equal entities get equal
    surrogates in all texts, in the format of each mention.  The entities that occur are checked for
    collisions as a distributed table; the few that need another attempt, and names whose gender other texts tell otherwise, are
    joined to the texts that mention them, and no other text moves.  Null and empty texts stay; repeated rows come out as
    often as they came in; columns of ``docs`` other than ``text`` and ``kinds`` stay, whatever their names.
    """
    spark = docs.sparkSession
    t1, t2 = text_key(F.col(text))
    texts = docs.select(t1.alias("t1"), t2.alias("t2"), F.col(text).alias("text")).filter(F.length("text") > 0)
    mentions = cut(texts.mapInPandas(_mentions, "t1 long, t2 long, kind string, value string").distinct())
    state = attempts(one_gender(mentions.select("kind", "value").distinct()), key)
    family = lambda kind: F.split(kind, ":")[0]
    whole = state.select(family("kind").alias("family"), "value", F.col("kind").alias("whole"), "attempt")
    told = mentions.withColumn("family", family("kind"))
    changed = told.join(whole, ["family", "value"]).filter((F.col("attempt") > 0) | (F.col("whole") != F.col("kind")))
    listed = F.sort_array(F.collect_set(F.struct("kind", "value", "attempt", "whole")))
    fixes = cut(changed.groupBy("t1", "t2").agg(listed.alias("fixes")))
    discard(spark, mentions, state)

    @F.pandas_udf("text string, kinds array<string>")
    def replaced(values: pd.Series, fixes: pd.Series) -> pd.DataFrame:
        rows = []
        for value, fix in zip(values, fixes, strict=True):
            later = {} if fix is None else {(f["kind"], f["value"]): (f["attempt"], f["whole"]) for f in fix}
            rows.append(replace(value, key, later))
        return pd.DataFrame(rows, columns=["text", "kinds"])

    packed = docs.select(F.struct("*").alias("all"), t1.alias("t1"), t2.alias("t2"), F.col(text).alias("text"))
    out = packed.join(fixes, ["t1", "t2"], "left").select("all", replaced("text", "fixes").alias("new"))
    new = {text: "new.text", "kinds": "new.kinds"}
    kept = [F.col(new[c]).alias(c) if c in new else F.col("all").getField(c).alias(c) for c in docs.columns]
    return out.select(*kept, *([] if "kinds" in docs.columns else [F.col("new.kinds").alias("kinds")]))


#: of the registered query only; whoever publishes texts brings a secret of their own
DEMONSTRATION_KEY = b"a key for trials"


@query("op7_surrogates")
def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for personal data."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, DEMONSTRATION_KEY).select("doc_id", "text", "kinds", F.size("kinds").cast("long").alias("n_entities"))
