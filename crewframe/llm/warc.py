"""WARC archives as seekable Zstandard bundles."""

from __future__ import annotations

import hashlib
import io
import json
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewframe.llm.base import query, read
from crewframe.session import cut, scratch

#: equal payloads shorter than this are written each time
LEAST_SHARED = 100
#: uncompressed bytes of records per frame, and compressed bytes per bundle, after which a new one is begun
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 8 << 20
LEVEL = 3

# Fixed values of the seekable Zstandard format: two kinds of skippable frames and the footer's magic number.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

RECORD_SCHEMA = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "bundle string, frame int, offset long, length long"
)


def page_uri(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def page_of(uri: str) -> int | None:
    name = uri.strip("<>").removeprefix("urn:page:")
    return int(name) if name else None


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record.  A revisit (``refers_to`` given) has headers only and names the full payload's size."""
    revisit = refers_to is not None
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{page_uri(page_id)}>"),
        ("WARC-Target-URI", json.dumps(url)[1:-1] if url is not None else None),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Refers-To", f"<{page_uri(refers_to)}>" if revisit else None),
        ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html"),
        ("Content-Length", "0" if revisit else str(len(payload))),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + (b"" if revisit else payload) + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of a record; raises ValueError on anything that is no whole record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    length = int(headers["Content-Length"])
    if version != "WARC/1.1" or rest[length:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return headers, rest[:length]


class BundleWriter:
    """Frames of records, then a skippable frame with the record index, then the seek table.

    Any Zstandard reader gets the plain WARC file; the index maps each record to (frame, offset in the frame's
    plain bytes, length), so one frame is read for one record.
    """

    def __init__(self):
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.out, self.table, self.index, self.frame = io.BytesIO(), [], [], bytearray()

    def add(self, record_id: int | None, record: bytes) -> None:
        if self.frame and len(self.frame) + len(record) > FRAME_BYTES:
            self._close_frame()
        self.index.append((record_id, len(self.table), len(self.frame), len(record)))
        self.frame += record

    def _close_frame(self) -> None:
        packed = self.packer.compress(bytes(self.frame))
        self.out.write(packed)
        self.table.append((len(packed), len(self.frame)))
        self.frame = bytearray()

    @property
    def full(self) -> bool:
        return self.out.tell() + len(self.frame) >= BUNDLE_BYTES

    def finish(self) -> bytes:
        if self.frame:
            self._close_frame()
        index = json.dumps(self.index, separators=(",", ":")).encode()
        index = self.packer.compress(index)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        # the index is an entry of the seek table too, with no plain bytes, so that the sizes add up to its place
        entries = [*self.table, (len(index) + 8, 0)]
        body = b"".join(struct.pack("<II", *e) for e in entries) + struct.pack("<IBI", len(entries), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(body)) + body)
        return self.out.getvalue()


class BundleReader:
    """Reads one record of a seekable file without touching the other frames."""

    def __init__(self, file):
        self.file = file
        n, _, magic = struct.unpack("<IBI", self._at(-9, 9, io.SEEK_END))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table at the end")
        size = n * 8 + 9
        table = self._at(-size, n * 8, io.SEEK_END)
        sizes = [struct.unpack_from("<II", table, i * 8) for i in range(n)]
        self.frames, at = [], 0
        for packed, _ in sizes:
            self.frames.append((at, packed))
            at += packed
        start, packed = self.frames.pop()
        self.index = json.loads(zstandard.decompress(self._at(start + 8, packed - 8)))

    def _at(self, place: int, n: int, whence: int = io.SEEK_SET) -> bytes:
        self.file.seek(place, whence)
        return self.file.read(n)

    def frame(self, number: int) -> bytes:
        return zstandard.decompress(self._at(*self.frames[number]))

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]

    def records(self) -> Iterator[tuple[int | None, int, int, int, bytes]]:
        """(record id, frame, offset, length, bytes) in order; each frame is unpacked once."""
        number, plain = None, b""
        for record_id, frame, offset, length in self.index:
            if frame != number:
                number, plain = frame, self.frame(frame)
            yield record_id, frame, offset, length, plain[offset : offset + length]


def with_firsts(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, digest and ``refers_to``: the smallest page_id that has the same
    payload of at least LEAST_SHARED bytes, null for that page itself and for payloads of its own.

    Copies combine before the shuffle, and only digests that repeat go into the join, whose page side adaptive
    execution splits where one payload is a large part of all.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digests = pages.select("page_id", payload.alias("p")).filter(F.octet_length("p") >= LEAST_SHARED)
    firsts = digests.select("page_id", F.sha2("p", 256).alias("digest")).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")
    )
    firsts = cut(firsts.filter((F.col("n") > 1) & F.col("first").isNotNull()).drop("n"))
    out = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    out = out.join(firsts, "digest", "left")
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.withColumn("refers_to", F.when(other, F.col("first"))).drop("first")


def _bundles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    writer = BundleWriter()

    def done() -> pd.DataFrame:
        return pd.DataFrame({"content": [writer.finish()]})

    for batch in batches:
        for page_id, url, payload, digest, refers_to in zip(
            *(batch[c] for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True
        ):
            page_id = None if pd.isna(page_id) else int(page_id)
            refers_to = None if pd.isna(refers_to) else int(refers_to)
            writer.add(page_id, record_bytes(page_id, url, bytes(payload), digest, refers_to))
            if writer.full:
                yield done()
                writer = BundleWriter()
    if writer.index:
        yield done()


def write_archive(pages: DataFrame, path: str) -> None:
    """Write every row of ``pages`` (page_id, url, html) as a WARC record in bundles below ``path``.

    One file holds one bundle.  Spark's text writer puts them there byte for byte, so they are committed like any
    output, on any store, whatever executors are lost: the row is the bundle less the last four bytes, and those,
    the same for each, are the separator that the writer adds.
    A null html is an empty payload; null ids and urls are kept as null; repeated rows are repeated records.
    """
    ids = with_firsts(pages.select("page_id", "url", "html"))
    ids = ids.withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    bundles = ids.mapInPandas(_bundles, "content binary")
    end = struct.pack("<I", SEEKABLE_MAGIC)
    body = F.expr(f"substring(content, 1, octet_length(content) - {len(end)})").cast("string").alias("value")
    out = bundles.select(body).write.option("lineSep", end.decode("latin-1")).option("encoding", "ISO-8859-1")
    out.option("maxRecordsPerFile", 1).text(path)


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
    for batch in batches:
        for name, content in zip(batch["bundle"], batch["content"], strict=True):
            rows = []
            for record_id, frame, offset, length, record in BundleReader(io.BytesIO(content)).records():
                head, body = parse_record(record)
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                size = int(head["WARC-Payload-Length"])
                revisit = head["WARC-Type"] == "revisit"
                if page_of(head["WARC-Record-ID"]) != record_id:
                    raise ValueError(f"record {record_id} of {name} is not where the index says")
                if not revisit and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
                    raise ValueError(f"payload of record {record_id} of {name} is damaged")
                url = head.get("WARC-Target-URI")
                url = None if url is None else json.loads(f'"{url}"')
                refers = page_of(head["WARC-Refers-To"]) if revisit else None
                rows.append((record_id, url, size, digest, head["WARC-Type"], refers, name, frame, offset, length))
            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record of an archive: what its headers say, checked against its payload, and where it lies.

    Raises if a record is damaged or not where the index says.  A folder without bundles gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.filter("length > 0").select(F.element_at(F.split("path", "/"), -1).alias("bundle"), "content")
    return files.mapInPandas(_records, RECORD_SCHEMA)


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(page_id, record) of ``wanted`` rows of :func:`read_archive` (bundle, frame, offset, length, page_id).

    Only the bundles named are opened, and in them only the frames that hold a wanted record.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("bundle"), "content")

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content, places in zip(batch["content"], batch["places"], strict=True):
                reader = BundleReader(io.BytesIO(content))
                got = [(p["page_id"], reader.record(p["frame"], p["offset"], p["length"])) for p in places]
                yield pd.DataFrame(got, columns=["page_id", "record"]).astype({"page_id": "Int64"})

    places = wanted.groupBy("bundle").agg(F.collect_list(F.struct("page_id", "frame", "offset", "length")).alias("places"))
    return files.join(places, "bundle").select("content", "places").mapInPandas(records, "page_id long, record binary")


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""


@query("op1_warc", SQL)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back."""
    path = scratch(spark, "warc")
    write_archive(read(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
