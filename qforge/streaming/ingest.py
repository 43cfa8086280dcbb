"""Incremental imports: files that arrive are taken up once, and their jobs move through queued, processing and completed or failed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ingest(spark: SparkSession, source: str, schema: StructType, checkpoint: str, sink: str, transform: Callable[[DataFrame], DataFrame], glob: str = "*.parquet") -> DataFrame:
    """Take up all files that are new since the last call, transformed, and return all rows of the sink. The file sink and the checkpoint make it exactly-once."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", 64).parquet(source)
    query = transform(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(sink)


def job_states(events: DataFrame, job: str, at: str, kind: str, started: str, done: str, failed: str) -> DataFrame:
    """(job, status, progress, events): the state each job's events leave it in. Failed beats completed beats processing; progress is 10, 40, 65 or 100."""
    c = events.groupBy(F.col(job).alias("job")).agg(
        F.count("*").alias("events"), F.count_if(F.col(kind) == started).alias("s"), F.count_if(F.col(kind) == done).alias("d"), F.count_if(F.col(kind) == failed).alias("f"), F.max(at).alias("last_at")
    )
    status = F.when(F.col("f") > 0, "failed").when(F.col("d") > 0, "completed").when(F.col("s") > 0, "processing").otherwise("queued")
    progress = F.when(status == "completed", 100).when(status == "failed", 65).when(status == "processing", 40).otherwise(10)
    return c.select("job", status.alias("status"), progress.alias("progress"), "events", "last_at")


def overdue(states: DataFrame, now: DataFrame, seconds: int) -> DataFrame:
    """Jobs of ``job_states`` that are still queued ``seconds`` after their last event: to be processed without waiting on. now: one row with the time."""
    return states.filter("status = 'queued'").join(F.broadcast(now.select(F.col("now").alias("_now")))).filter(F.col("last_at") < F.col("_now") - F.make_dt_interval(secs=F.lit(seconds))).drop("_now")


def uncached(pages: DataFrame, cache: DataFrame, *key: str) -> DataFrame:
    """Pages whose output is missing: what a resumed run still has to do."""
    return pages.join(cache.select(*key).distinct(), list(key), "left_anti")
