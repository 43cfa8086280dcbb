"""Import jobs as streams: their states with a fallback timer, and their records into a bank, each batch once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from qforge.operators import bank
from qforge.storage import Version, committed

STATE = "started long, done long, failed long, events long, fired boolean, error string"
UPDATE = "job string, status string, progress int, events long, fallback boolean, error string"
PROGRESS = {"queued": 10, "processing": 40, "failed": 65, "completed": 100}
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def status_of(started: int, done: int, failed: int, fired: bool) -> str:
    return "failed" if failed else "completed" if done else "processing" if started or fired else "queued"


class Jobs(StatefulProcessor):
    """Counts of a job's events, and a timer from when it is queued: if it still is when that ends, the job is to be processed without waiting on, which is said once.

    Counts and timers are in the state store, so both outlive a restart.
    """

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE)

    def _said(self, key: tuple, fallback: bool) -> pd.DataFrame:
        started, done, failed, events, fired, error = self.state.get()
        status = status_of(started, done, failed, fired)
        return pd.DataFrame([(key[0], status, PROGRESS[status], events, fallback, error)], columns=[c.split()[0] for c in UPDATE.split(", ")])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        new = not self.state.exists()
        started, done, failed, events, fired, error = (0, 0, 0, 0, False, None) if new else self.state.get()
        for b in rows:
            started, done, failed, events = started + int((b["kind"] == "started").sum()), done + int((b["kind"] == "done").sum()), failed + int((b["kind"] == "failed").sum()), events + len(b)
            said = b.loc[b["kind"] == "failed", "error"].dropna()
            error = error or (said.iloc[0] if len(said) else None)
        self.state.update((started, done, failed, events, fired, error))
        if status_of(started, done, failed, fired) != "queued":
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        elif new:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        yield self._said(key, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        started, done, failed, events, fired, error = self.state.get()
        if status_of(started, done, failed, fired) == "queued":
            self.state.update((started, done, failed, events, True, error))
            yield self._said(key, True)

    def close(self) -> None:
        pass


def job_updates(events: DataFrame, job: str, kind: Column, error: Column | None = None, wait_ms: int = 5000) -> DataFrame:
    """(job, status, progress, events, fallback, error) of a stream of events, a row for each job of a batch, and one with fallback for each job still queued after ``wait_ms``.

    ``kind`` is started, done, failed or anything else. Failed beats completed beats processing, in whatever order events come; the first error that a failed event tells stays. Events without a job
    are left out. The session has to keep states in RocksDB (``with_states``).
    """
    rows = events.select(F.col(job).cast("string").alias("job"), F.coalesce(kind, F.lit("")).alias("kind"), (error if error is not None else F.lit(None).cast("string")).alias("error")).filter("job is not null")
    return rows.groupBy("job").transformWithStateInPandas(Jobs(wait_ms), UPDATE, "Update", "ProcessingTime")


def with_states(spark: SparkSession) -> SparkSession:
    """The session, set to keep the states of streams in RocksDB, as timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def updates_at(updates: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Write the updates of a stream, all that is new as one batch, and return all that were written. A batch is a folder, overwritten if the batch is replayed.

    One batch, as with timers of processing time a query that runs to the end of what there is never finds an end.
    """
    spark = updates.sparkSession
    updates.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{path}/batch={n}")).option("checkpointLocation", checkpoint).trigger(once=True).start().awaitTermination()
    return spark.read.schema(UPDATE).parquet(path)


def latest_updates(updates: DataFrame) -> DataFrame:
    """Of updates that were written, the last of each job: the one with most events, a fallback after what it followed."""
    return updates.groupBy("job").agg(F.max_by(F.struct("status", "progress", "events", "error"), F.struct("events", "fallback")).alias("u"), F.bool_or("fallback").alias("fallback")).select("job", "u.*", "fallback")


def inserted(incoming: DataFrame, key: str, *order: str) -> Callable[[DataFrame | None], tuple[DataFrame, dict[str, int]]]:
    """A change that inserts rows and ignores those whose key the bank has; of equal incoming keys the first."""

    def change(table: DataFrame | None) -> tuple[DataFrame, dict[str, int]]:
        base = incoming.limit(0) if table is None else table
        new = bank.insert_ignoring_conflicts(base, incoming, key, *order)
        came, got = incoming.count(), new.count()
        return base.unionByName(new), {"inserted": got, "skipped": came - got}

    return change


def replaced(incoming: DataFrame, key: str, active: str, *order: str) -> Callable[[DataFrame | None], tuple[DataFrame, dict[str, int]]]:
    """A change that replaces the bank's active rows by the incoming ones."""

    def change(table: DataFrame | None) -> tuple[DataFrame, dict[str, int]]:
        base = incoming.withColumn(active, F.lit(True)).limit(0) if table is None else table
        after, counts = bank.replace_bank(base, incoming, key, active, *order)
        return after.select(*base.columns), {k: int(v or 0) for k, v in counts.first().asDict().items()}

    return change


def into_bank(stream: DataFrame, root: str, name: str, checkpoint: str, change: Callable[[DataFrame], Callable[[DataFrame | None], tuple[DataFrame, dict[str, int]]]], stream_id: str, told: Callable[[Version], None] | None = None) -> None:
    """Run a stream to the end of what there is, each batch applied to a published bank by ``change``, once: a batch that is replayed after a crash finds itself in the bank's ledger.

    ``told`` hears of each version that a batch left. The batch is kept while it is counted, joined and written.
    """

    def commit(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            version = committed(batch.sparkSession, root, name, change(batch), stream_id, number)
        finally:
            batch.unpersist()
        if told:
            told(version)

    stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
