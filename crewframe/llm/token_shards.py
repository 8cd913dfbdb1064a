"""Token ids of documents in binary shards, each a wavelet matrix in one compressed file."""

from __future__ import annotations

import io
import json
import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crewframe.llm.base import query, read, read_blobs, write_blobs
from crewframe.session import cut, discard, scratch

#: ids after which a shard is closed, at the end of a document
SHARD_IDS = 1 << 21
#: bits of a plane that are compressed together; one block is unpacked for one look at a plane
BLOCK_BITS = 1 << 15
LEVEL = 1

#: The end of every shard: documents' table at, its size, directory's size, ids, planes, bits of a block, writing task,
#: its shard, magic.
FOOTER = struct.Struct("<QQQQIIII4s")
MAGIC = b"WMT1"

DOC_SCHEMA = "part int, shard int, place long, doc_id long, local_start long, n_tokens long, ids_crc32 long"


class WaveletMatrix:
    """Builds the planes of a sequence: plane k holds bit k (from the top) of the ids, in the order that the planes
    above have left; ids with a 0 then go before those with a 1, otherwise in order."""

    def __init__(self, ids: np.ndarray):
        self.width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        self.planes = []
        kind = np.uint16 if self.width <= 16 else np.uint32
        rest = ids.astype(kind)
        for k in range(self.width - 1, -1, -1):
            bits = rest & kind(1 << k) != 0
            self.planes.append(bits)
            rest = np.concatenate((rest[np.flatnonzero(~bits)], rest[np.flatnonzero(bits)]))


def pack_shard(part: int, number: int, doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    """A shard's bytes: blocks of the planes, documents' table, directory (zeros of each plane; place and ones before
    each block), footer.  Blocks, table and directory are Zstandard frames of their own."""
    packer = zstandard.ZstdCompressor(level=LEVEL)
    out, matrix = io.BytesIO(), WaveletMatrix(ids)
    zeros, places, ones = [], [], []
    for bits in matrix.planes:
        total = 0
        for at in range(0, len(bits), BLOCK_BITS):
            block = bits[at : at + BLOCK_BITS]
            places.append(out.tell())
            ones.append(total)
            total += int(np.count_nonzero(block))
            out.write(packer.compress(np.packbits(block).tobytes()))
        zeros.append(len(bits) - total)
    docs_at = places_end = out.tell()
    known = np.array([i is not None for i in doc_ids], bool)
    named = np.array([0 if i is None else i for i in doc_ids], "<i8")
    table = packer.compress(struct.pack("<Q", len(sizes)) + known.tobytes() + named.tobytes() + np.array(sizes, "<u8").tobytes())
    directory = packer.compress(np.array([*zeros, *places, places_end, *ones], "<u8").tobytes())
    out.write(table)
    out.write(directory)
    out.write(FOOTER.pack(docs_at, len(table), len(directory), len(ids), matrix.width, BLOCK_BITS, part, number, MAGIC))
    return out.getvalue()


class TokenShard:
    """Reads a shard: single ids, counts and places of an id by rank and select, documents, or everything.

    Only the directory is read at first; each look at a plane unpacks one block of it.
    """

    def __init__(self, file):
        self.file = file
        file.seek(-FOOTER.size, io.SEEK_END)
        head = FOOTER.unpack(file.read(FOOTER.size))
        docs_at, docs_size, size, self.n, self.width, self.block_bits, self.part, self.number, magic = head
        if magic != MAGIC:
            raise ValueError("no token shard")
        self.docs_span = (docs_at, docs_size)
        numbers = np.frombuffer(zstandard.decompress(self._at(docs_at + docs_size, size)), "<u8").astype(np.int64)
        self.blocks = -(-self.n // self.block_bits)
        split = self.width + self.width * self.blocks
        self.zeros, self.places = numbers[: self.width], numbers[self.width : split + 1]
        self.ones = numbers[split + 1 :].reshape(self.width, self.blocks)
        self.unpacked: dict[tuple[int, int], np.ndarray] = {}

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def __len__(self) -> int:
        return self.n

    def _block(self, plane: int, block: int) -> np.ndarray:
        bits = self.unpacked.get((plane, block))
        if bits is None:
            k = plane * self.blocks + block
            raw = zstandard.decompress(self._at(int(self.places[k]), int(self.places[k + 1] - self.places[k])))
            width = min(self.block_bits, self.n - block * self.block_bits)
            bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=width)
            if len(self.unpacked) >= 8 * self.width:
                self.unpacked.clear()
            self.unpacked[plane, block] = bits
        return bits

    def _plane(self, plane: int) -> np.ndarray:
        """All bits of a plane, from one read."""
        a, b = plane * self.blocks, (plane + 1) * self.blocks
        raw, out = self._at(int(self.places[a]), int(self.places[b] - self.places[a])), np.empty(self.n, bool)
        for k in range(self.blocks):
            part = raw[self.places[a + k] - self.places[a] : self.places[a + k + 1] - self.places[a]]
            here = out[k * self.block_bits : (k + 1) * self.block_bits]
            here[:] = np.unpackbits(np.frombuffer(zstandard.decompress(part), np.uint8), count=len(here))
        return out

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first ``i`` bits."""
        if i >= self.n:
            return self.n - int(self.zeros[plane])
        block, rest = divmod(i, self.block_bits)
        return int(self.ones[plane, block]) + int(self._block(plane, block)[:rest].sum())

    def _find(self, plane: int, bit: int, j: int) -> int:
        """Place of the ``j``-th bit (from 0) of that kind; it is there."""
        before = self.ones[plane] if bit else np.arange(self.blocks) * self.block_bits - self.ones[plane]
        block = int(np.searchsorted(before, j, side="right")) - 1
        bits = self._block(plane, block)
        return block * self.block_bits + int(np.flatnonzero(bits == bit)[j - int(before[block])])

    def __getitem__(self, i: int) -> int:
        """The id at a place."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.width):
            block, rest = divmod(i, self.block_bits)
            bit, ones = int(self._block(k, block)[rest]), self._ones(k, i)
            value = value << 1 | bit
            i = int(self.zeros[k]) + ones if bit else i - ones
        return value

    def _span(self, symbol: int, i: int) -> tuple[int, int]:
        """Where the ids equal to ``symbol`` among the first ``i`` lie below the last plane: [start, end)."""
        if symbol < 0 or symbol >> self.width:
            return 0, 0
        a, b = 0, min(max(i, 0), self.n)
        for k in range(self.width):
            low, high = self._ones(k, a), self._ones(k, b)
            if symbol >> (self.width - 1 - k) & 1:
                a, b = int(self.zeros[k]) + low, int(self.zeros[k]) + high
            else:
                a, b = a - low, b - high
        return a, b

    def rank(self, symbol: int, i: int | None = None) -> int:
        """How often ``symbol`` stands among the first ``i`` ids, or in the shard."""
        a, b = self._span(symbol, self.n if i is None else i)
        return b - a

    def select(self, symbol: int, j: int) -> int:
        """Place of the ``j``-th ``symbol``, counted from 0."""
        a, b = self._span(symbol, self.n)
        if not 0 <= j < b - a:
            raise IndexError(j)
        at = a + j
        for k in range(self.width - 1, -1, -1):
            one = symbol >> (self.width - 1 - k) & 1
            at = self._find(k, one, at - int(self.zeros[k]) if one else at)
        return at

    def docs(self) -> tuple[list[int | None], np.ndarray]:
        """Ids of the documents, and their sizes in tokens."""
        raw = zstandard.decompress(self._at(*self.docs_span))
        (n,) = struct.unpack_from("<Q", raw)
        known = np.frombuffer(raw, bool, n, 8)
        named = np.frombuffer(raw, "<i8", n, 8 + n)
        sizes = np.frombuffer(raw, "<u8", n, 8 + 9 * n).astype(np.int64)
        return [int(i) if k else None for i, k in zip(named, known, strict=True)], sizes

    def ids(self) -> np.ndarray:
        """All ids in order: from the last plane up, each undoes its parting of zeros and ones."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        rest = np.zeros(self.n, kind)
        for k in range(self.width - 1, -1, -1):
            bits, above = self._plane(k), np.empty(self.n, kind)
            zeros = int(self.zeros[k])
            above[np.flatnonzero(~bits)] = rest[:zeros]
            above[np.flatnonzero(bits)] = rest[zeros:] | kind(1 << (self.width - 1 - k))
            rest = above
        return rest.astype(np.uint32)


#: pieces of text whose ids a Python worker remembers at most, and characters of such a piece
PIECES, PIECE_CHARS = 3 << 19, 48
#: where a text may be cut: before a blank, and around a line's end, that a word or an ASCII mark follows
LINE, CUT = re.compile(r"\n(?=[!-~\w])"), re.compile(r" (?=[!-~\w])")
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: letters below have been letters since long, so all versions of Unicode agree on them
SURE = "\u0530"
TOKEN_ID = attrgetter("id")


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: the visible ones themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)) - set(shown))
    return {b: 256 + i for i, b in enumerate(hidden)}


class Pieces(dict):
    """Little-endian ids of a piece that stands behind ``lead``, encoded by the library when first asked for.

    Pieces asked for since the last time that half of PIECES were held, and those before it, are remembered.
    """

    def __init__(self, made, lead: str, tails: Pieces | None = None):
        super().__init__()
        self.made, self.model, self.lead, self.tails, self.letters = made, made.model, lead, tails, byte_letters()
        self.named_lead, self.older = lead.translate(self.letters), {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = self._encoded(piece)
        if len(piece) <= PIECE_CHARS:
            if len(self) >= PIECES // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found

    def _encoded(self, piece: str) -> bytes:
        core = piece.rstrip(MARKS) if self.tails is not None else ""
        if not (core.isalpha() and (core.isascii() or max(core) < SURE)):
            return whole(self.made, self.lead + piece)
        if len(core) < len(piece):  # the library's pattern parts a word from the marks behind it
            return self[core] + self.tails[piece[len(core) :]]
        named = core if core.isascii() else core.encode().decode("latin-1").translate(self.letters)
        return array("I", map(TOKEN_ID, self.model.tokenize(self.named_lead + named))).tobytes()


def whole(made, text: str) -> bytes:
    return array("I", made.encode(text, add_special_tokens=False).ids).tobytes()


class Encoder:
    """Ids of texts, each what the library gives for the whole text.

    A byte-level vocabulary with the common pattern of words never merges over a place where LINE or CUT may cut, so each piece
    is encoded once and remembered.  Texts that hold an added token, and other vocabularies, are encoded whole.
    """

    def __init__(self, path: str, special_as_text: bool):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.made = Tokenizer.from_file(path)
        self.made.encode_special_tokens = special_as_text
        with open(path) as file:
            rules = json.load(file)
        split = rules.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in rules.get("added_tokens", [])]
        same = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.by_piece = (
            all(split.get(k) == v for k, v in same.items())
            and not rules.get("normalizer") and not rules.get("truncation") and not rules.get("padding")
            and rules["model"]["type"] == "BPE" and not rules["model"].get("dropout") and array("I").itemsize == 4
            and sys.byteorder == "little"
        )
        if self.by_piece:
            tails = Pieces(self.made, "")
            self.first, self.later = Pieces(self.made, "", tails), Pieces(self.made, " ", tails)
            self.line_end = whole(self.made, "\n")

    def __call__(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids of a whole text, of an empty one for null."""
        text = text or ""
        if not self.by_piece or any(token in text for token in self.added):
            return np.array(self.made.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        lines = []
        for line in LINE.split(text):
            pieces = line.split()
            if " ".join(pieces) != line:  # more than single blanks between words
                pieces = CUT.split(line)
            first = self.first[pieces[0]] if line and pieces[0] else b""
            lines.append(first + b"".join(map(self.later.__getitem__, pieces[1:])))
        return self.line_end.join(lines)


@cache
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    return Encoder(path, special_as_text)


def write_shards(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, special_as_text: bool = False, shard_ids: int = SHARD_IDS
) -> None:
    """Write the ids of every text of ``docs`` (doc_id, text) in ascending doc_id order to shards below ``path``.

    Texts are sorted over the cluster before they are encoded, each once; a task writes its range in shards of about
    ``shard_ids``, so its memory is bounded by a shard and the longest text.  Null ids come first; rows that
    share an id are ordered by a hash of their text, equal rows are kept each; a null text is an empty one, and a
    document without tokens is its end.  Without rows nothing is written that holds a shard.  ``tokenizer``: path of a
    file of the tokenizers library, the same on every executor.  Strings of special tokens are read as the library does
    by default, or as ordinary text.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        encoded, end = encoder(tokenizer, special_as_text), struct.pack("<I", end_id)
        names, runs, held = [], [], 0

        def done() -> pa.RecordBatch:
            blob = pack_shard(part, number, names, [len(r) // 4 for r in runs], np.frombuffer(b"".join(runs), "<u4"))
            return pa.RecordBatch.from_pydict({"content": pa.array([blob], pa.binary())})

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names.append(doc_id)
                runs.append(encoded(text.as_py()) + end)
                held += len(runs[-1]) // 4
                if held >= shard_ids:
                    yield done()
                    number, names, runs, held = number + 1, [], [], 0
        if names:
            yield done()

    # the last key deals out rows that are alike
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    write_blobs(laid.mapInArrow(shards, "content binary"), path, MAGIC)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            shard = TokenShard(io.BytesIO(content.as_buffer()))
            names, sizes = shard.docs()
            ids, ends = shard.ids().astype("<u4"), np.cumsum(sizes)
            starts = ends - sizes
            crcs = [zlib.crc32(ids[a:b].data) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(names)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([shard.part] * n, pa.int32()), "shard": pa.array([shard.number] * n, pa.int32()),
                    "place": pa.array(range(n), pa.int64()), "doc_id": pa.array(names, pa.int64()),
                    "local_start": pa.array(starts), "n_tokens": pa.array(sizes), "ids_crc32": pa.array(crcs, pa.int64()),
                }
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the shards below ``path``, from all ids read back: (doc_id, start, n_tokens, ids_crc32, part,
    shard, place).  ``start``: ids of all documents before it; ``part``, ``shard``: its file, ``place``: its row there.

    Starts within a shard are in its file; those of shards are running sums in two steps, over the shards of a
    writing task and over the tasks.
    """
    found = cut(read_blobs(spark, path).mapInArrow(_documents, DOC_SCHEMA))
    shards = found.groupBy("part", "shard").agg(F.sum("n_tokens").alias("held"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("held").alias("held"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per writing task
    parts = parts.select("part", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("ahead"))
    shards = shards.withColumn("before", F.coalesce(F.sum("held").over(inside), F.lit(0))).drop("held").join(parts, "part")
    start = (F.col("ahead") + F.col("before") + F.col("local_start")).alias("start")
    return found.join(shards, ["part", "shard"]).select("doc_id", start, "n_tokens", "ids_crc32", "part", "shard", "place")


def occurrences(spark: SparkSession, path: str, symbol: int) -> DataFrame:
    """(part, shard, place): every place of an id, found by rank and select in each shard's file."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                shard = TokenShard(io.BytesIO(content.as_buffer()))
                found = [shard.select(symbol, j) for j in range(shard.rank(symbol))]
                n = len(found)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([shard.part] * n, pa.int32()), "shard": pa.array([shard.number] * n, pa.int32()),
                        "place": pa.array(found, pa.int64()),
                    }
                )

    return read_blobs(spark, path).mapInArrow(places, "part int, shard int, place long")


#: appended to each document by the query's contract
END_ID = 2


@query("op13_token_shards")
def op13_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written to shards and read back."""
    from public_tokenizers import path as vocabulary

    path = scratch(spark, "tokens")
    write_shards(read(spark, sf_dir, "documents").select("doc_id", "text"), path, vocabulary("byte_bpe_50k.json"), END_ID)
    out = read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
    discard(spark, path)
    return out
