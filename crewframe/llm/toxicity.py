"""Toxicity scores of a linear model trained with counterfactual identity swaps."""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crewframe.llm.base import query, read

#: Labelled rows a model is fitted on at most; the first by a hash of their id.  The rest of the labels is not needed.
SAMPLE = 10_000
#: words and openings of words that carry a weight at most
FEATURES = 4096
#: a word must stand in so many labelled texts
LEAST_TEXTS = 3
#: a word is also known by its first characters, which endings do not change
OPENINGS = (5, 7)
EDGES = string.punctuation
#: how much a changed score counts against a wrong one
FAIRNESS = 10.0

# Identity terms that swap with each other; a text that names a group must not score otherwise for it.
IDENTITY_GROUPS = [
    ["he", "she", "they"],
    ["man", "woman"],
    ["men", "women"],
    ["boy", "girl"],
    ["male", "female"],
    ["father", "mother"],
    ["black", "white", "asian", "latino"],
    ["muslim", "christian", "jewish", "hindu", "buddhist"],
    ["muslims", "christians", "jews", "hindus", "buddhists"],
    ["gay", "straight", "lesbian", "bisexual"],
    ["transgender", "cisgender"],
    ["immigrant", "native"],
    ["immigrants", "natives"],
    ["old", "young"],
    ["disabled", "able-bodied"],
    ["homme", "femme"],
    ["hommes", "femmes"],
    ["musulman", "chrétien", "juif"],
    ["mann", "frau"],
    ["männer", "frauen"],
    ["muslime", "christen", "juden"],
    ["hombre", "mujer"],
    ["hombres", "mujeres"],
    ["musulmán", "cristiano", "judío"],
]

SWAPS = {term: [o for o in group if o != term] for group in IDENTITY_GROUPS for term in group}


def word_set(text: str | None) -> set[str]:
    """Distinct words of a text in lower case, without marks at their ends."""
    return {w.strip(EDGES) for w in set((text or "").lower().split())} - {""}


def features_in(found: set[str]) -> set[str]:
    """Words, and openings of longer words marked by a blank at the end."""
    return found | {w[:k] + " " for k in OPENINGS for w in found if len(w) > k}


def features_of(text: str | None) -> list[str]:
    return sorted(features_in(word_set(text)))


def swapped_features(text: str | None) -> list[list[str]]:
    """Features of the text with its identity terms swapped, once for each alternative.

    The nth version puts the nth other term of its group in for each term, so every alternative of the largest
    group has its turn.  Words and openings of words are made anew from the swapped words.
    """
    found = word_set(text)
    named = found & SWAPS.keys()
    turns = max((len(SWAPS[t]) for t in named), default=0)
    return [
        sorted(features_in((found - named) | {SWAPS[t][turn % len(SWAPS[t])] for t in named})) for turn in range(turns)
    ]


def learns(doc_id: Column) -> Column:
    """Rows whose labels may be learned: the remainder of the id's CRC is not zero (a null id is not learned)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(words, swapped, toxic) of at most ``sample`` labelled texts: their features, and those of the swapped texts.
    Only ids travel to the texts, so no text is shuffled.

    A doc_id labelled twice is toxic if one label says so; null ids and null labels teach nothing.
    """
    ids = labels.filter(learns(F.col("doc_id")) & F.col("toxic").isNotNull())
    ids = ids.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # bounded by ``sample``

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {
                    "words": [features_of(t) for t in batch["text"]],
                    "swapped": [swapped_features(t) for t in batch["text"]], "toxic": batch["toxic"],
                }
            )

    return rows.mapInPandas(bags, "words array<string>, swapped array<array<string>>, toxic int")


def vocabulary(bags: DataFrame, size: int = FEATURES) -> list[str]:
    """The words that tell the classes apart best (chi square), and all features of the identity terms that occur."""
    n, toxic = bags.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < n:
        return []
    each = bags.select(F.explode("words").alias("word"), "toxic").groupBy("word").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("t")
    )
    expected = F.col("n") * F.lit(toxic / n)
    gain = (F.col("t") - expected) ** 2 / expected + (F.col("t") - expected) ** 2 / (F.col("n") - expected)
    each = each.withColumn("gain", F.when(F.col("word").isin(sorted(features_in(set(SWAPS)))), float("inf")).otherwise(gain))
    kept = each.filter((F.octet_length("word") <= 64) & ((F.col("n") >= LEAST_TEXTS) | (F.col("gain") == float("inf"))))
    return [r[0] for r in kept.orderBy(F.desc("gain"), "word").limit(size).select("word").collect()]


def fit(
    rows: list[np.ndarray], toxic: np.ndarray, swaps: list[tuple[int, list[int], list[int]]], size: int,
    decay: float = 1e-3, fairness: float = FAIRNESS, steps: int = 300,
) -> np.ndarray:
    """Weights of ``size`` words and a bias (last) by full-batch Adam.

    The loss is the logistic loss with the classes weighted alike, an L2 term, and ``fairness`` times the square of
    (score of the text - score of the swapped text), the mean over the texts that name a group of the mean over their swaps.  ``swaps``: row,
    features that only the text has, features that only the swapped text has.
    """
    lengths = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    out_row = np.repeat(np.arange(len(swaps)), [len(s[1]) for s in swaps])
    in_row = np.repeat(np.arange(len(swaps)), [len(s[2]) for s in swaps])
    out_at = np.array([i for s in swaps for i in s[1]], np.int64)
    in_at = np.array([i for s in swaps for i in s[2]], np.int64)
    named, turns = np.unique([s[0] for s in swaps], return_counts=True) if swaps else (np.empty(0), np.empty(0))
    part = np.concatenate([np.full(n, 1 / n) for n in turns]) / max(1, len(named)) if swaps else np.empty(0)
    share = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic == 0).sum()))
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        z = np.bincount(owner, w[flat], len(rows)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) * share
        grad = np.append(np.bincount(flat, error[owner], size), error.sum())
        grad[:-1] += decay * w[:-1]
        if swaps:
            apart = np.bincount(out_row, w[out_at], len(swaps)) - np.bincount(in_row, w[in_at], len(swaps))
            apart *= 2 * fairness * part
            grad[:-1] += np.bincount(out_at, apart[out_row], size) - np.bincount(in_at, apart[in_row], size)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> tuple[dict[str, float], float]:
    """Weights by word, and the bias.

    The texts are read on the executors; the driver gets at most ``sample`` short lists of numbers.  Without
    labels of both classes every text scores the share of toxic labels, or 0 without any.
    """
    from crewframe.session import cut, discard

    bags = cut(training_rows(docs, labels, sample))
    known = vocabulary(bags, features)
    if not known:
        n, toxic = bags.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        discard(docs.sparkSession, bags)
        return {}, 20.0 if n and toxic == n else -20.0
    place = {w: i for i, w in enumerate(known)}

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = [[place[w] for w in words if w in place] for words in batch["words"]]
            swapped = [[[place[w] for w in words if w in place] for words in turns] for turns in batch["swapped"]]
            yield pd.DataFrame({"at": at, "swapped": swapped, "toxic": batch["toxic"]})

    sparse = bags.mapInPandas(placed, "at array<int>, swapped array<array<int>>, toxic int").toPandas()
    discard(docs.sparkSession, bags)
    sparse = sparse.iloc[sorted(range(len(sparse)), key=lambda i: (list(sparse["at"][i]), sparse["toxic"][i]))]
    rows, toxic = [np.asarray(a, np.int64) for a in sparse["at"]], sparse["toxic"].to_numpy()
    swaps = []
    for number, (row, turns) in enumerate(zip(rows, sparse["swapped"], strict=True)):
        before = set(row.tolist())
        for turn in turns:
            after = set(np.asarray(turn).tolist())
            swaps.append((number, sorted(before - after), sorted(after - before)))
    weights = fit(rows, toxic, swaps, len(known))
    return dict(zip(known, weights[:-1].tolist(), strict=True)), float(weights[-1])


def scorer(weights: dict[str, float], bias: float):
    """Pandas UDF: the model's score of a text between 0 and 1; a null or empty text has the bias alone."""
    whole = frozenset(w for w in weights if not w.endswith(" "))
    opened = {k: frozenset(w[:-1] for w in weights if w.endswith(" ") and len(w) == k + 1) for k in OPENINGS}

    def logit(text: str | None) -> float:
        found = word_set(text)
        named = [weights[w] for w in whole & found]
        for k, known in opened.items():
            named += [weights[w + " "] for w in known & {w[:k] for w in found if len(w) > k}]
        return bias + math.fsum(named)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        z = np.array([logit(t) for t in texts], float)
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return score


def with_scores(docs: DataFrame, labels: DataFrame, text: str = "text", learn_from: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from 0.5 on); other columns and repeated rows stay as they are.

    The model learns from ``learn_from`` (doc_id, text; the rows of ``docs`` if not given) and ``labels`` (doc_id,
    toxic), never from rows held out by :func:`learns`.  An empty table gives an empty one.
    """
    source = learn_from if learn_from is not None else docs.select("doc_id", F.col(text).alias("text"))
    score = scorer(*train(source, labels))
    return docs.withColumn("score", score(F.col(text))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` less the rows predicted toxic; columns of ``docs`` named as the scores are kept as they came."""
    named = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    scored = named.withColumn("score", scorer(*train(docs.select("doc_id", "text"), labels))(F.col("text")))
    return scored.filter(F.col("score") < 0.5).select("row.*")


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scored.select("doc_id", F.coalesce(~learns(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
