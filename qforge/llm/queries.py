"""One query for each corpus operator, with production parameters, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from qforge.llm import conversations, decontaminate, extraction, importance, langid, licenses, mixing, neighbours, oracles, secrets, simhash, substrings, tokens, warc
from qforge.llm.common import scratch


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch(spark, "warc"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.importance(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op3_token_binary": op3_token_binary,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_secret_scan": op10_secret_scan,
    "op6_source_mixing": op6_source_mixing,
    "op4_substring_dedup": op4_substring_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_language_id": op8_language_id,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op2_warc_derivatives": op2_warc_derivatives,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_html_extraction": op12_html_extraction,
    "op13_conversation_repair": op13_conversation_repair,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op4_substring_dedup": oracles.SUBSTRINGS,
    "op9_benchmark_decontamination": oracles.DECONTAMINATION,
    "op10_secret_scan": oracles.SECRETS,
    "op11_importance_resampling": oracles.IMPORTANCE,
    "op13_conversation_repair": oracles.CONVERSATIONS,
}
