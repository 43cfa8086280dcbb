"""The driver's tables, and the roles they play for the question bank's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bank records: labels are audit verdicts, missing where a document was not audited."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    status = F.when(F.col("n_chars") < 200, "needs_user_review").when(F.col("n_chars") > 20000, "needs_repair").otherwise("ready")
    return docs.join(labels, "doc_id", "left").withColumn("status", status)


#: The same, in DuckDB.
AUDITED = "(SELECT d.*, l.quality, l.toxic, CASE WHEN n_chars < 200 THEN 'needs_user_review' WHEN n_chars > 20000 THEN 'needs_repair' ELSE 'ready' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
