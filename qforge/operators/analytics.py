"""Scores, weak subtopics, histories and summaries. One pass over the rows each, counts by condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qforge.functions import text as X


def missed(answers: DataFrame, correct: Column, flagged: Column, scope_id: Column, active_scope: DataFrame, key: str = "scope_id") -> DataFrame:
    """Answered wrongly, not flagged, and in scope: without a scope id, or with one of the active ones. Unanswered rows are not missed."""
    active = active_scope.select(F.col(key).alias("_active")).distinct()
    rows = answers.withColumn("_scope", scope_id).join(F.broadcast(active) if _is_small(active) else active, F.col("_scope") == F.col("_active"), "left")
    in_scope = F.col("_scope").isNull() | F.col("_active").isNotNull()
    return rows.filter((correct == False) & ~flagged & in_scope).drop("_scope", "_active")  # noqa: E712


def _is_small(df: DataFrame, rows: int = 100_000) -> bool:
    return df.limit(rows + 1).count() <= rows


def weak_subtopics(rows: DataFrame, tags: Column, miss: Column) -> DataFrame:
    """tag, miss_count, total_questions, miss_rate (rounded percent): each tag of each row counts once. Null tags are none."""
    each = rows.select(F.explode(tags).alias("tag"), miss.alias("miss"))
    return each.groupBy("tag").agg(F.count_if("miss").alias("miss_count"), F.count("*").alias("total_questions")).withColumn("miss_rate", X.percent(F.col("miss_count"), F.col("total_questions")))


def by_weakness(weak: DataFrame) -> DataFrame:
    """Worst rate first; ties by misses, then by tag."""
    return weak.orderBy(F.desc("miss_rate"), F.desc("miss_count"), "tag")


def right(correct: Column, given: Column) -> Column:
    """Given answers are as many as the correct ones, and the same as a set; no answer is an empty one."""
    given = F.coalesce(given, F.array().cast("array<int>"))
    return (F.size(correct) == F.size(given)) & (F.size(F.array_except(correct, given)) == 0) & (F.size(F.array_except(given, correct)) == 0)


def session_scores(answers: DataFrame, session: str, correct: Column, given: Column) -> DataFrame:
    """session, questions, correct, score (rounded percent)."""
    return answers.groupBy(session).agg(F.count("*").alias("questions"), F.count_if(right(correct, given)).alias("correct")).withColumn("score", X.percent(F.col("correct"), F.col("questions")))


def history_page(sessions: DataFrame, completed_at: str, key: str, page: int = 1, limit: int = 20) -> DataFrame:
    """One page of completed sessions, newest first, ties by key: a bounded top-k, not a full sort."""
    return sessions.filter(F.col(completed_at).isNotNull()).orderBy(F.desc(completed_at), key).offset((page - 1) * limit).limit(limit)


def history_total(sessions: DataFrame, completed_at: str) -> DataFrame:
    return sessions.agg(F.count(completed_at).alias("total"))


STATUSES = ("ready", "auto_repaired", "needs_repair", "needs_user_review", "unresolved")


def status_summary(rows: DataFrame, status: Column, *by: str) -> DataFrame:
    """total, a count for each status, manual_review_rate and repair_debt_rate (4 places, 0 if empty)."""
    rate = lambda n: F.round(F.coalesce(F.try_divide(F.col(n).cast("double"), F.col("total")), F.lit(0.0)), 4)
    counts = [F.count_if(status == s).alias(s) for s in STATUSES]
    out = rows.groupBy(*by).agg(F.count("*").alias("total"), *counts)
    return out.withColumns({"manual_review_rate": rate("needs_user_review"), "repair_debt_rate": rate("needs_repair")})


def extraction_report(rows: DataFrame, status: Column, duplicate: Column, answered: Column, *by: str, expected: DataFrame | None = None) -> DataFrame:
    """``status_summary`` with duplicates (records that repeat another) and unmatched (records without an answer). With ``expected``, rows of ``by``, a source without records has zeros."""
    more = rows.groupBy(*by).agg(F.count_if(duplicate).alias("duplicates"), F.count_if(~answered).alias("unmatched"))
    out = status_summary(rows, status, *by).join(more, list(by))
    return out if expected is None else expected.select(*by).distinct().join(out, list(by), "left").fillna(0)


def usable_by_item(bank: DataFrame, item: str, usable: Column) -> DataFrame:
    return bank.groupBy(item).agg(F.count_if(usable).alias("usable"), F.count("*").alias("total"))


def progress(questions: DataFrame, session: str, answered: Column, wanted: Column) -> DataFrame:
    """current and total questions of a session, whether it is complete, and how many are pending."""
    out = questions.groupBy(session).agg(F.count_if(answered).alias("current"), F.max(wanted).alias("total"))
    return out.withColumns({"complete": F.col("current") >= F.col("total"), "pending": F.greatest(F.lit(0), F.col("total") - F.col("current"))})


def shared_explanation(explanations: Column) -> Column:
    """The one explanation of all options, if at least two have one and all of those are equal."""
    kept = F.filter(explanations, lambda e: F.coalesce(e, F.lit("")) != "")
    return F.when((F.size(kept) >= 2) & (F.size(F.array_distinct(kept)) == 1), F.get(kept, F.lit(0)))
