"""Scores of a recurrent language model for whole documents."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crewframe.llm.base import query, read
from crewframe.llm.recurrent import TAILS, Trainer, Vocabulary, first_weights, log_likelihoods
from crewframe.session import cut, discard

#: most frequent words with a place of their own in the network
PLACES = 4096
#: most words whose counts every task holds, the frequent ones; counts of the others are joined
HELD = 1 << 17
#: steps of a doubling of the count at which the held words may end
STEPS = 16
#: longest word, in bytes, that is held or has a place
WORD_BYTES = 64
#: words of a piece of a training document; the state is carried within a piece
PIECE = 512
#: shares of the training documents; replicas meet after each
ROUNDS = 4
#: rows side by side in training
ROWS = 256
#: batches of pieces that wait to be put side by side with others of like length
BATCHES = 4
#: bytes of texts that are split into words at once, or one text
SPLIT = 1 << 25
#: weights of replicas that one task averages
FAN_IN = 16
END = b""


def held_out(doc_id: Column) -> Column:
    """Rows the model never learns from (a null id is learned)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def token_arrays(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, A-Z in lower case, one end after those of each text; where each text's begin, and their number."""
    # the blank put after a text gives it its end, and a blank before its first word an empty word that is none
    ended = pc.binary_join_element_wise(pc.fill_null(texts, ""), "", " ")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(ended))
    words, begins = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    first = begins[:-1]
    empty = pc.equal(pc.binary_length(words.take(pa.array(first))), 0).to_numpy(zero_copy_only=False)
    none = empty & (np.diff(begins) > 1)
    if none.any():
        keep = np.ones(len(words), bool)
        keep[first[none]] = False
        words = words.filter(pa.array(keep))
        begins[1:] -= np.cumsum(none)
    return words, begins


def tokens(text: str | None) -> pa.Array:
    """Words of one text, and one end."""
    return token_arrays(pa.array([text], pa.string()))[0]


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` with at most SPLIT bytes of their last column, the text, at once, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes, dtype=np.int64)
        first = 0
        while first < len(total):
            before = total[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(total, before + SPLIT, side="right")))
            yield batch.slice(first, last - first)
            first = last


def tail_class(word: bytes) -> int:
    """Class of a word without a place: by its last two bytes, which tell the language and often the form."""
    return zlib.crc32(word[-2:]) % TAILS


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in portions(batches):
        words, _ = token_arrays(part.column(0))
        yield pa.RecordBatch.from_arrays(words.value_counts().flatten(), ["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all of ``docs`` (text); the end is the empty word."""
    return docs.select("text").mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """What a task needs to know of the counts: the held words, the tail classes, and the totals."""

    def __init__(self, counts: DataFrame):
        self.total, self.distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        short = counts.filter(F.octet_length("word") <= WORD_BYTES)
        # where to end comes from a histogram of at most 64 x STEPS bars, so only the held words come to the driver
        bar = F.floor(F.log2("n") * STEPS)
        least, so_far = float("inf"), 0
        for number, words in sorted(short.groupBy(bar).count().collect(), reverse=True):
            so_far += words
            if so_far > HELD:
                break
            least = number
        found = short.filter(bar >= F.lit(least)).toArrow()  # columns, not a row object for each word
        words = (w.as_py().encode() for w in found.column("word"))
        held = sorted(zip(words, found.column("n").to_pylist(), strict=True), key=lambda h: (-h[1], h[0]))
        del found
        self.place = {w: i for i, (w, _) in enumerate(held[:PLACES])}
        first = np.array([n for _, n in held[:PLACES]], float)
        # sums of the words without a place, by class
        rest = counts
        if self.place:
            word, n = held[len(self.place) - 1]
            later = (F.col("n") < n) | ((F.col("n") == n) & (F.col("word") > word.decode()))
            rest = rest.filter(later | (F.octet_length("word") > WORD_BYTES))
        tail = (F.crc32(F.substring(F.col("word").cast("binary"), -2, 2)) % TAILS).cast("int").alias("tail")
        sums = rest.groupBy(tail).agg(F.sum("n"), F.count("*")).collect()
        self.tail_n, self.tail_v = np.zeros(TAILS), np.zeros(TAILS)
        for at, n, v in sums:
            self.tail_n[at], self.tail_v[at] = n, v
        self.vocabulary = Vocabulary(first, self.tail_n)
        # by place among the held words: the network's place, log10 share, and that within the tail class
        self.held = pa.array([w.decode() for w, _ in held], pa.string())
        self.ids = np.array([i if i < len(self.place) else self.tail_id(w) for i, (w, _) in enumerate(held)], np.int64)
        self.bases = np.array([self.base(n) for _, n in held])
        self.inside = np.array([0.0 if i < len(self.place) else self.in_tail(w, n) for i, (w, n) in enumerate(held)])

    def tail_id(self, word: bytes) -> int:
        return len(self.place) + tail_class(word)

    def base(self, n: float) -> float:
        return float(np.log10((n + 0.5) / (self.total + 0.5 * (self.distinct + 1))))

    def in_tail(self, word: bytes, n: float) -> float:
        """log10 share of a word within its tail class; what no training text has shares the place of one word."""
        at = tail_class(word)
        return float(np.log10((n + 0.5) / (self.tail_n[at] + 0.5 * (self.tail_v[at] + 1))))

    def indexed(self, words: pa.Array) -> np.ndarray:
        """Place of each word among the held ones, or -1."""
        return pc.fill_null(pc.index_in(words, value_set=self.held), -1).to_numpy()

    def places(self, words: pa.Array, begins: np.ndarray | None = None, indexed: np.ndarray | None = None) -> np.ndarray:
        """The network's place of each word, and the start where a text begins."""
        at = self.indexed(words) if indexed is None else indexed
        out = self.ids[at] if len(self.ids) else np.empty(len(at), np.int64)
        rare = np.flatnonzero(at < 0)
        last = pc.binary_slice(words.take(pa.array(rare)).cast(pa.binary()), -2).dictionary_encode()
        classes = np.array([self.tail_id(w) for w in last.dictionary.to_pylist()], np.int64)
        out[rare] = classes[last.indices.to_numpy()]
        return np.insert(out, [0] if begins is None else begins, self.vocabulary.start)


def training_runs(docs: DataFrame, lexicon) -> DataFrame:
    """(round, run): the places of all words of each document, in pieces of PIECE words, each with the one before it.

    The pieces of a document go to the rounds by a hash, so a long text is not learned from in one go.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon.value
        for part in portions(batches):
            words, begins = token_arrays(part.column(1))
            texts = np.split(known.places(words, begins[:-1]), begins[1:-1] + np.arange(1, len(begins) - 1))
            rounds, pieces = [], []
            for doc_id, places in zip(part.column(0).to_pylist(), texts, strict=True):
                for number, first in enumerate(range(0, len(places) - 1, PIECE)):
                    spot = zlib.crc32(f"{doc_id}/{number}".encode(), 1)
                    rounds.append(spot % ROUNDS)
                    pieces.append(places[first : first + PIECE + 1])
            if pieces:
                ends = np.cumsum([0, *map(len, pieces)])
                run = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(pieces), pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(rounds, pa.int32()), run], ["round", "run"])

    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id")
    return docs.select(ids, "text").mapInArrow(runs, "round int, run array<int>")


def _mean(weights: list[dict], shares: list[float]) -> dict[str, np.ndarray]:
    total = sum(shares) or 1.0
    return {k: sum(w[k].astype(np.float64) * (s / total) for w, s in zip(weights, shares, strict=True)).astype(np.float32) for k in weights[0]}


def learn_all(trainer: Trainer, pieces: list[np.ndarray]) -> None:
    """Every piece once, ROWS of like length side by side."""
    pieces = sorted(pieces, key=len, reverse=True)
    for at in range(0, len(pieces), ROWS):
        trainer.learn(pieces[at : at + ROWS])


def train(runs: DataFrame, lexicon, epochs: int = 1) -> dict[str, np.ndarray]:
    """Weights after ROUNDS rounds: each task trains a replica on its part of the round's runs, then replicas are averaged.

    The replicas grow with the number of tasks; they are averaged in a tree of FAN_IN, and the driver gets the
    last few.  No task holds more than FAN_IN of them.
    """
    spark = runs.sparkSession
    known = lexicon.value
    weights = first_weights(known.vocabulary)
    for number in range(ROUNDS):
        sent = spark.sparkContext.broadcast(weights)

        def replica(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            trainer = Trainer(lexicon.value.vocabulary, sent.value)
            waiting: list[np.ndarray] = []
            for batch in batches:
                waiting += [np.asarray(r, np.int64) for r in batch["run"]]
                if len(waiting) >= ROWS * BATCHES:
                    learn_all(trainer, waiting)
                    waiting = []
            learn_all(trainer, waiting)
            if trainer.tokens:
                part = TaskContext.get().partitionId()
                yield pd.DataFrame({"part": [part], "share": [float(trainer.tokens)], "weights": [pickle.dumps(trainer.weights)]})

        def merged(part: pd.DataFrame) -> pd.DataFrame:
            mean = _mean([pickle.loads(w) for w in part["weights"]], list(part["share"]))
            number = part["part"].iloc[0] // FAN_IN
            return pd.DataFrame({"part": [number], "share": [part["share"].sum()], "weights": [pickle.dumps(mean)]})

        schema = "part int, share double, weights binary"
        replicas = cut(runs.filter(F.col("round") == number).select("run").mapInPandas(replica, schema))
        while (replicas.agg(F.max("part")).first()[0] or 0) >= FAN_IN:
            after = cut(replicas.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(lambda part: merged(part), schema))
            discard(spark, replicas)
            replicas = after
        rows = replicas.orderBy("part").collect()
        if rows:
            weights = _mean([pickle.loads(r["weights"]) for r in rows], [r["share"] for r in rows])
        discard(spark, replicas)
        sent.unpersist()
    return weights


SCORED = (
    "n_tokens long, n_held long, base_held double, score_held double, words array<string>, times array<int>"
)


def score(docs: DataFrame, lexicon, weights: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, n_tokens, n_held, base_held, score_held, words, times) of each row.

    The network gives every token's class and the word within it; the share of a word without a place within its
    tail class comes from counts.  Those are held for most words; the others leave as ``words`` with ``times``.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Lexicon = lexicon.value
        for part in portions(batches):
            words, begins = token_arrays(part.column(1))
            n, sizes = part.num_rows, np.diff(begins)
            owner, at = np.repeat(np.arange(n), sizes), known.indexed(words)
            runs = np.split(known.places(words, begins[:-1], at), begins[1:-1] + np.arange(1, n))
            logs = log_likelihoods(known.vocabulary, sent.value, runs) / np.log(10)
            held, rare = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
            of = owner[held]
            base, inside = (np.bincount(of, shares[at[held]], n).astype(float) for shares in (known.bases, known.inside))
            # the other words of each text, each once with how often it is there
            other = words.take(pa.array(rare)).dictionary_encode()
            one = max(1, len(other.dictionary))
            pairs, times = np.unique(owner[rare] * one + other.indices.to_numpy(), return_counts=True)
            ends = pa.array(np.searchsorted(pairs, np.arange(n + 1) * one), pa.int32())
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(sizes), pa.array(np.bincount(of, minlength=n)), pa.array(base), pa.array(inside + logs),
                pa.ListArray.from_arrays(ends, other.dictionary.take(pa.array(pairs % one))),
                pa.ListArray.from_arrays(ends, pa.array(times, pa.int32())),
            ], ["doc_id", "n_tokens", "n_held", "base_held", "score_held", "words", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(scored, "doc_id string, " + SCORED)
    return ids.withColumn("doc_id", F.col("doc_id").cast(kind))


def log_scores(docs: DataFrame, learn: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs`` (doc_id, text).

    A token is a word (A-Z in lower case) or the end.  The model learns from the rows where ``learn`` holds: counts
    over all their words, and a network trained on all their words.  ``score`` is the log10
    probability of the whole text: the network's state goes from window to window to the text's end.
    ``base_score`` is that of counts alone.  The two are sums over the words a task holds counts of, and over the
    others, which meet their counts in a join on the word: no such word is frequent, so no key of it is hot.
    A null or empty text is one end.  Repeated rows and null ids are rows like any other; without training
    rows every word is as unknown as the next.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    learn = ~held_out(F.col("doc_id")) if learn is None else learn
    taught = docs.filter(learn)
    counts = cut(word_counts(taught))
    known = Lexicon(counts)
    lexicon = spark.sparkContext.broadcast(known)
    runs = cut(training_runs(taught, lexicon), "round")  # a round reads its own folder
    weights = train(runs, lexicon)
    discard(spark, runs)
    # stored with a row number, so that the number stays when a task runs again
    rows = cut(score(docs, lexicon, weights).withColumn("row", F.monotonically_increasing_id()))
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", "w.words", "w.times")
    found = rare.join(counts.withColumnRenamed("word", "words"), "words", "left")
    n = F.coalesce("n", F.lit(0)).cast("double")
    tail = F.crc32(F.substring(F.col("words").cast("binary"), -2, 2)) % TAILS
    size = F.array(*[F.lit(float(a + 0.5 * (b + 1))) for a, b in zip(known.tail_n, known.tail_v, strict=True)])
    base = F.log10((n + 0.5) / F.lit(float(known.total + 0.5 * (known.distinct + 1))))
    inside = F.log10((n + 0.5) / F.get(size, tail.cast("int")))
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * base).alias("base"), F.sum(F.col("times") * inside).alias("inside"),
    )
    out = rows.drop("words", "times").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens",
        (F.col("n_held") + zero("known")).cast("long").alias("n_known"), F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("base_held") + zero("base")).alias("base_score"), (F.col("score_held") + zero("inside")).alias("score"),
    )


@query("op3_language_model")
def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document."""
    return log_scores(read(spark, sf_dir, "documents").select("doc_id", "text"))
