import io
import random
import zlib

import numpy as np
import pytest
from helpers import ODD, documents, prose
from public_tokenizers import path as vocabulary
from tokenizers import Tokenizer

from crewframe.llm import token_shards as ts

FILE = vocabulary("byte_bpe_50k.json")


def shard_of(ids, **kw):
    return ts.TokenShard(io.BytesIO(ts.pack_shard(3, 4, kw.get("names", [7]), kw.get("sizes", [len(ids)]), np.array(ids, np.uint32))))


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (17, 2), (1000, 5), (70_000, 50_257), (33_000, 1 << 31)])
def test_wavelet_matrix_equals_the_plain_sequence(n, top):
    draw = random.Random(n)
    ids = [draw.randrange(top) if draw.random() < 0.7 else min(2, top - 1) for _ in range(n)]
    shard = shard_of(ids)
    assert (len(shard), shard.part, shard.number) == (n, 3, 4) and shard.ids().tolist() == ids
    for symbol in {*draw.sample(ids, min(n, 5)), 0, 2, top, top * 4 + 1}:
        places = [i for i, x in enumerate(ids) if x == symbol]
        assert shard.rank(symbol) == len(places)
        for i in [0, 1, n // 2, n, n + 9]:
            assert shard.rank(symbol, i) == sum(p < i for p in places)
        for j in draw.sample(range(len(places)), min(4, len(places))):
            assert shard.select(symbol, j) == places[j]
        with pytest.raises(IndexError):
            shard.select(symbol, len(places))
    for i in draw.sample(range(n), min(n, 40)):
        assert shard[i] == ids[i]
    with pytest.raises(IndexError):
        shard[n]


def test_one_look_reads_a_small_part_of_the_file():
    draw = random.Random(1)
    ids = [draw.randrange(50_257) for _ in range(600_000)]
    raw = ts.pack_shard(0, 0, [1], [len(ids)], np.array(ids, np.uint32))

    class Counted(io.BytesIO):
        got = 0

        def read(self, n=-1):
            out = super().read(n)
            self.got += len(out)
            return out

    file = Counted(raw)
    assert ts.TokenShard(file)[300_000] == ids[300_000] and file.got < len(raw) / 8


def test_compressed_and_damaged():
    raw = ts.pack_shard(0, 0, [None, 5], [3, 2], np.array([9, 9, 2, 9, 2], np.uint32))
    assert ts.TokenShard(io.BytesIO(raw)).docs()[0] == [None, 5]
    with pytest.raises(ValueError):
        ts.TokenShard(io.BytesIO(raw[:-1]))
    assert len(ts.pack_shard(0, 0, [1], [100_000], np.full(100_000, 2, np.uint32))) < 5_000


def brute(rows):
    made, out, start = Tokenizer.from_file(FILE), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = made.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_documents_equal_brute_force_and_the_shards_go_on_from_each_other(spark, tmp_path):
    rows = [(i * 37 % 1009, prose(i, i % 60) + " ÄÖ数\U0001f600\x00"[: i % 6]) for i in range(400)]
    rows += [(5000 + i, "the same text") for i in range(300)] + [(9000, None), (9001, ""), (9002, prose(3, 20_000))]
    ts.write_shards(documents(spark, rows), str(tmp_path / "t"), FILE, 2, shard_ids=2_000)
    got = ts.read_documents(spark, str(tmp_path / "t"))
    assert got.select("part", "shard").distinct().count() > 8
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == brute(rows)
    ends = ts.occurrences(spark, str(tmp_path / "t"), 2)
    assert ends.count() >= len(rows)


def test_odd_rows(spark, tmp_path):
    ts.write_shards(documents(spark, ODD, extra=True), str(tmp_path / "t"), FILE, 2)
    got = [tuple(r) for r in ts.read_documents(spark, str(tmp_path / "t")).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    want = brute(ODD)
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in want)
    assert sorted(r[0] or 0 for r in got) == sorted(r[0] or 0 for r in want)
    by_start = sorted(got, key=lambda r: r[1])
    assert [r[1] for r in by_start] == [sum(r[2] for r in by_start[:k]) for k in range(len(got))]
    assert [r[0] for r in by_start] == [r[0] for r in want]


def test_empty_table_and_compression_of_text_files(spark, tmp_path):
    ts.write_shards(documents(spark, []), str(tmp_path / "none"), FILE, 2)
    assert ts.read_documents(spark, str(tmp_path / "none")).collect() == []
    spark.conf.set("mapreduce.output.fileoutputformat.compress", "true")
    try:
        ts.write_shards(documents(spark, [(1, "a b")]), str(tmp_path / "packed"), FILE, 2)
    finally:
        spark.conf.unset("mapreduce.output.fileoutputformat.compress")
    assert ts.read_documents(spark, str(tmp_path / "packed")).count() == 1


def test_strings_of_special_tokens():
    text = "a <|endoftext|> b"
    plain = np.frombuffer(ts.encoder(FILE)(text), "<u4")
    assert 50256 in plain and ts.encoder(FILE)(None) == b""
    assert 50256 not in np.frombuffer(ts.encoder(FILE, True)(text), "<u4")


def test_pieces_equal_the_whole_text():
    made, encoded, draw = Tokenizer.from_file(FILE), ts.Encoder(FILE, False), random.Random(9)
    assert encoded.by_piece
    parts = [
        " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u180e", "\u200b", "\x00", "a", "The", "word",
        "don't", "'s", "'", "we'LL", "''", "1", "23", "½", "²", "x2", "été", "ß", "ſ", "İ", "Ж", "ա", "數", "か", "e\u0301", "\U0001f600", "\U00010400", "ª",
        "Ⅷ", "٣", "!", "...", "word,", "(see)", "$$$", "a-b", "_", "<|", "|>", "http://x.y/z?q=1", "ﬁ", "\u0e40", "\ud7ff", "ǅ", "ʰ", "\u0345",
    ]
    for n in range(6_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(1, 12)))
        assert np.frombuffer(encoded(text), "<u4").tolist() == made.encode(text, add_special_tokens=False).ids, repr(text)


def test_remembered_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(ts, "PIECES", 10)
    made, encoded = Tokenizer.from_file(FILE), ts.Encoder(FILE, False)
    text = prose(1, 2_000) + " " + "x" * 500
    assert np.frombuffer(encoded(text), "<u4").tolist() == made.encode(text, add_special_tokens=False).ids
    assert len(encoded.later) <= 5 and len(encoded.later.older) <= 5 and "x" * 500 not in encoded.later


def test_another_kind_of_vocabulary_is_encoded_whole():
    other = vocabulary("word_bpe_49k.json")
    encoded = ts.Encoder(other, False)
    assert not encoded.by_piece
    assert np.frombuffer(encoded("Two  words"), "<u4").tolist() == Tokenizer.from_file(other).encode("Two  words", add_special_tokens=False).ids
