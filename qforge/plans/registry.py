"""All registered queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from qforge.plans import analytics_queries, bank_queries, layout_queries, parse_queries, text_queries

_PARTS = (analytics_queries, bank_queries, text_queries, parse_queries, layout_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: q for part in _PARTS for k, q in part.SQL.items()}
FLAGSHIP = "weak_subtopics"
