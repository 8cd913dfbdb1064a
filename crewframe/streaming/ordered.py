"""Per-key processing in event-time order on a stream.

Micro-batches bring rows in any order.  Rows wait in state, in buckets of event time, until the watermark has
passed their bucket, then each meets the row of its key before it.  Keys are dealt into shards, and a shard's bucket is one entry of
state with one timer, so a batch or a timer costs by shards and rows and not by keys.  Rows behind the watermark are dropped by the
engine and counted (:func:`crewframe.streaming.landing.late_rows`).
"""

from __future__ import annotations

import json
import sys
from collections import defaultdict

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: rows of one entry of a bucket
PART_ROWS = 4096
#: shards that keys are dealt into; a stream's first start fixes them
SHARDS = 4096


class InOrder(StatefulProcessor):
    """Calls ``step(last, row)`` on the (at, tie, *fields) rows of each key of a shard in (at, tie) order.

    ``step`` returns (new last row, output row or None); rows are plain tuples.  A bucket's rows are written as they
    arrive, in parts of their own, and read once, when its timer fires; rows of other buckets are not touched.  The last row
    is kept for each key by itself, and only keys with rows in the bucket are looked up.
    """

    def __init__(self, keys: list[str], fields: list[str], field_types: str, output: list[str], step, bucket_micros: int):
        if bucket_micros % 1000 or bucket_micros <= 0:
            raise ValueError("a bucket is a whole number of milliseconds")
        self.keys, self.fields, self.types, self.output, self.step = keys, fields, field_types, output, step
        self.whole = [part.split(" ")[1] == "long" for part in field_types.split(", ")]
        self.width = bucket_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        named = [part.split(" ") for part in self.types.split(", ")] + [(key, "string") for key in self.keys]
        columns = ", ".join(f"{name} array<{kind}>" for name, kind in named)
        self.waiting = handle.getMapState("waiting", "bucket long, part long", columns)
        self.parts = handle.getMapState("parts", "bucket long", "held long")
        self.last = handle.getMapState("last", "name string", self.types)

    def _columns(self, pdf: pd.DataFrame):
        """The columns as lists of plain values, missing ones as None."""
        for name, whole in zip(self.fields, self.whole, strict=True):
            values = pdf[name].tolist()
            if whole:
                # a missing long comes as zero and is marked, as pandas has no whole numbers with gaps
                yield [None if gap else int(v) for v, gap in zip(values, pdf[gap_of(name)].tolist(), strict=True)]
            else:
                yield [None if gap else v for v, gap in zip(values, pdf[name].isna().tolist(), strict=True)]
        for name in self.keys:
            yield [v if isinstance(v, str) else None for v in pdf[name].tolist()]

    def handleInputRows(self, key, rows, timerValues):
        """Only note the rows; each bucket's timer serves them once the watermark has passed it."""
        arrived = defaultdict(list)
        for pdf in rows:
            for row in zip(*self._columns(pdf), strict=True):
                arrived[row[0] // self.width].append(row)
        for bucket, held in arrived.items():
            known = self.parts.getValue((bucket,))
            n = known[0] if known else 0
            if not n:
                self.handle.registerTimer((bucket + 1) * self.width // 1000)
            for at in range(0, len(held), PART_ROWS):
                self.waiting.updateValue((bucket, n), tuple(map(list, zip(*held[at : at + PART_ROWS], strict=True))))
                n += 1
            self.parts.updateValue((bucket,), (n,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Timers of a shard fire in the order of their buckets."""
        bucket = expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.width - 1
        rows, width = defaultdict(list), len(self.fields)
        for part in range(self.parts.getValue((bucket,))[0]):
            for row in zip(*self.waiting.getValue((bucket, part)), strict=True):
                rows[row[width:]].append(row[:width])
            self.waiting.removeKey((bucket, part))
        self.parts.removeKey((bucket,))
        out = []
        for own, held in rows.items():
            held.sort(key=lambda r: (r[0], r[1] is None, r[1]))
            name = (json.dumps(own),)
            known = self.last.getValue(name)
            last = tuple(known) if known is not None else None
            if last is not None and held[0][0] < last[0]:
                raise RuntimeError("a bucket was served before an earlier one")
            for row in held:
                last, made = self.step(last, row)
                if made is not None:
                    out.append((*own, *made))
            if last is not None:
                self.last.updateValue(name, last)
            if len(out) >= PART_ROWS:
                yield self._made(out)
                out = []
        if out:
            yield self._made(out)

    def _made(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[*self.keys, *self.output], dtype=object)

    def close(self) -> None:
        pass


def gap_of(name: str) -> str:
    # no leading underscore: the worker names such columns by their place
    return f"gap_of_{name}"


def in_order(
    stream: DataFrame, keys: list[str], fields: list[str], field_types: str, output: list[str], output_types: str, step,
    bucket_seconds: float, shards: int = SHARDS,
) -> DataFrame:
    """Apply ``step`` per key in event order; ``fields`` start with microseconds and a tie-breaker.

    Rows wait until the watermark has passed the end of their bucket of ``bucket_seconds``: narrow ones come out sooner, wide ones
    need fewer timers; a bucket of one shard is sorted in memory.  Start the result with
    :func:`crewframe.streaming.landing.append_to`, or set the RocksDB state store yourself.
    """
    # the driver's own Python worker, which prepares a stateful operator, gets no files: send the code itself
    for module in {InOrder.__module__, step.__module__}:
        cloudpickle.register_pickle_by_value(sys.modules[module])
    processor = InOrder(keys, fields, field_types, output, step, round(bucket_seconds * 1000) * 1000)
    kinds = dict(part.split(" ") for part in output_types.split(", "))
    longs = [name for name, kind in (part.split(" ") for part in field_types.split(", ")) if kind == "long"]
    # keys travel as text, longs without gaps: pandas would make floats of whole numbers with gaps
    dealt = stream.withColumns(
        {key: F.col(key).cast("string") for key in keys}
        | {name: F.coalesce(name, F.lit(0)).cast("long") for name in longs} | {gap_of(name): F.col(name).isNull() for name in longs}
        | {"shard": F.pmod(F.xxhash64(*[F.col(key).cast("string") for key in keys]), F.lit(shards))}
    )
    plain = ", ".join(f"{name} {'string' if name in keys else kind}" for name, kind in kinds.items())
    found = dealt.groupBy("shard").transformWithStateInPandas(processor, plain, "append", "EventTime")
    return found.select(*[F.col(name).cast(kind).alias(name) for name, kind in kinds.items()])
