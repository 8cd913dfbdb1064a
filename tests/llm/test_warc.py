import hashlib
import io
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from crewframe.llm import warc

PAGE = "page_id long, url string, html string"


def rows():
    draw = random.Random(4)
    big = "".join(draw.choices("abcdef <>é", k=700_000))
    out = [(i, f"http://h/{i}", "<p>" + "same page " * 30) for i in range(9, 3, -1)]
    out += [(20, None, None), (21, "u\r\nX: y", ""), (22, "http://h/ü", "short"), (23, "http://h", "short"), (24, "b", big), (25, "b", big)]
    return out + [(30, "x", "a\r\n\r\nb" * 40), (None, "n", "<p>" + "same page " * 30), (4, "again", "<p>" + "same page " * 30)]


def expected(rows):
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 100 and i is not None:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, u, h in rows:
        p = (h or "").encode()
        refers = first.get(p) if first.get(p) != i else None
        out.append((i, u, len(p), hashlib.sha256(p).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "a")
    pages = spark.createDataFrame(rows(), PAGE).withColumn("digest", F.lit("clash")).repartition(3)
    warc.write_archive(pages, path)
    back = warc.read_archive(spark, path)
    got = sorted((tuple(r)[:6] for r in back.collect()), key=repr)
    assert got == expected(rows())
    wanted = back.filter("page_id in (30, 24)")
    bodies = {r.page_id: warc.parse_record(bytes(r.record))[1].decode() for r in warc.fetch(spark, path, wanted).collect()}
    assert bodies == {30: "a\r\n\r\nb" * 40, 24: rows()[10][2]}
    # any Zstandard reader gets the plain records, in one file each
    for file in (tmp_path / "a").glob("part-*"):
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(file.read_bytes()), read_across_frames=True).read()
        assert plain.startswith(b"WARC/1.1\r\n") and plain.endswith(b"\r\n\r\n")


def test_bundle_is_seekable(monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 500)
    writer = warc.BundleWriter()
    records = [warc.record_bytes(i, "u", bytes([i]) * (i * 40), "d", None) for i in range(30)]
    for i, record in enumerate(records):
        writer.add(i, record)
    content = writer.finish()
    reader = warc.BundleReader(io.BytesIO(content))
    assert len(reader.frames) > 10
    assert [r[-1] for r in reader.records()] == records
    number, frame, offset, length = reader.index[17]
    assert reader.record(frame, offset, length) == records[17]


def test_damage_is_found(spark, tmp_path):
    writer = warc.BundleWriter()
    writer.add(1, warc.record_bytes(1, "u", b"body", "0" * 64, None))
    (tmp_path / "part-0").write_bytes(writer.finish())
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, str(tmp_path)).collect()


def test_empty_table(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], PAGE), str(tmp_path / "e"))
    assert warc.read_archive(spark, str(tmp_path / "e")).collect() == []
