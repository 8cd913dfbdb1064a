"""Stateless watches on landed records, and the sink the streams share."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from crewframe.operators import privacy, quality
from crewframe.operators.mapping import Mapping
from crewframe.session import scratch

STATE_PARTITIONS = "spark.sql.shuffle.partitions"
#: settings that hold while a stream starts
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # sessions of a key are merged before the shuffle
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


class LateRows(StreamingQueryListener):
    """Adds up the rows that each run of a stream drops behind its watermark: one number for a run, whatever its batches."""

    def __init__(self):
        self.changed, self.rows, self.ended = threading.Condition(), {}, set()

    def onQueryStarted(self, event) -> None:
        with self.changed:
            self.rows.setdefault(str(event.runId), 0)

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        dropped = sum(state.numRowsDroppedByWatermark for state in event.progress.stateOperators)
        with self.changed:
            self.rows[run] = self.rows.get(run, 0) + dropped

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        """Comes after the progress of every batch."""
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()

    def total(self, run: str, wait: float | None) -> int:
        with self.changed:
            if wait is not None and not self.changed.wait_for(lambda: run in self.ended, wait):
                raise TimeoutError(f"the end of run {run} was not reported within {wait} s")
            return self.rows.get(run, 0)


def late_listener(spark: SparkSession) -> LateRows:
    """The session's counter, added at its first use."""
    context = spark.sparkContext
    if getattr(context, "_crewframe_late", None) is None:
        context._crewframe_late = LateRows()
        spark.streams.addListener(context._crewframe_late)
    return context._crewframe_late


def append_to(stream: DataFrame, path: str, checkpoint: str, each=None, state_partitions: int | None = None):
    """Write every micro-batch below ``path`` in a folder of its own number.

    A batch that is replayed after a failure overwrites its own folder, so nothing is written
    twice.  ``each`` maps the batch to what is stored.  The first start fixes the number of state partitions for
    ever: ``state_partitions`` says how many, the session's shuffle partitions if not given.  The session's settings
    are as before when the stream has started.
    """

    def store(batch: DataFrame, number: int) -> None:
        rows = each(batch) if each else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    spark = stream.sparkSession
    late_listener(spark)
    wanted = STREAM_CONF | ({STATE_PARTITIONS: str(state_partitions)} if state_partitions else {})
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def run_to_end(
    stream: DataFrame, name: str, each=None, state_partitions: int | None = None, late: str | None = None
) -> DataFrame:
    """Drain what has landed and return the stored rows; ``late`` names a column with the rows that came too late."""
    spark = stream.sparkSession
    base = scratch(spark, name)
    running = append_to(stream, f"{base}/rows", f"{base}/checkpoint", each, state_partitions)
    running.awaitTermination()
    rows = spark.read.option("basePath", f"{base}/rows").parquet(f"{base}/rows").drop("batch")
    return rows if late is None else rows.withColumn(late, F.lit(late_rows(running)).cast("long"))


def late_rows(running, wait: float = 60.0) -> int:
    """Rows this run of the stream dropped because they came behind the watermark, over all its batches so far; of
    a run that has ended, all of them."""
    return late_listener(SparkSession.active()).total(str(running.runId), None if running.isActive else wait)


def drift_events(stream: DataFrame, mapping: Mapping, order: str, keys: list[str], name: str) -> DataFrame:
    """Drift events of each micro-batch, merged per field: counts add up, the first sample stays."""
    found = run_to_end(stream, name, lambda batch: quality.unmapped_counts(batch, mapping, order, keys))
    return quality.drift_as_events(found, mapping.entity, keys)


def masked_stream(stream: DataFrame, column: str, secret: str, tenant: str = "tenant_id") -> DataFrame:
    """Masked rows; a projection, so it needs no state."""
    return privacy.mask_text(stream, column, secret, tenant)


def stream_vault(stream: DataFrame, column: str, secret: str, name: str, tenant: str = "tenant_id") -> DataFrame:
    """Vault rows of a masked stream: each micro-batch stores its distinct rows, equal ones of all batches are one."""
    return run_to_end(stream, name, lambda batch: privacy.vault(batch, column, secret, tenant)).distinct()


def rejection_stream(stream: DataFrame) -> DataFrame:
    """Rejection events; a projection as well."""
    return quality.diagnose_rejections(stream)
