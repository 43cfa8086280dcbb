"""Shared helpers of the corpus operators: scratch tables in the shared folder, and names that cannot clash."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What this Python worker keeps from task to task, by the operator that keeps it.
_KEPT: dict[str, dict] = {}

#: Bytes that Python's bytes.split() and the contracts agree on as white space: 0x09-0x0D and 0x20.
WORD = r"[^\x20\x09-\x0D]+"


def kept_by(operator: str) -> dict:
    """What an operator keeps in this Python worker, which Spark reuses over tasks. What other operators have left here goes, so that a worker never holds more than one operator's."""
    for other in [k for k in _KEPT if k != operator]:
        del _KEPT[other]
    return _KEPT.setdefault(operator, {})


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent and Spark runs in one process (tests, local mode) a local folder is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner free the shuffle files of finished jobs: it does so once the driver has collected their handles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()

