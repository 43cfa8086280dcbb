"""Quizzes from a bank: scope filters, hybrid fill, retries, and what a player gets to see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWERS = ("correct_answers", "user_answers", "is_correct", "explanations")


def in_filter(scope_id: Column, tags: Column, wanted: list[str]) -> Column:
    """Whether the scope id or any tag is wanted, in any case. Nothing wanted: everything passes; null tags are none."""
    if not wanted:
        return F.lit(True)
    low = [w.lower() for w in wanted]
    tagged = F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.coalesce(F.lower(t).isin(low), F.lit(False)))
    return F.coalesce(F.lower(scope_id).isin(low), F.lit(False)) | tagged


def hybrid_fill(wanted: Column, selected: Column) -> Column:
    """How many questions the generator has to add to those of the bank."""
    return F.greatest(F.lit(0), wanted - selected)


def retry(missed: DataFrame, session: Column, drop: tuple[str, ...] = ("bank_id", "user_answers", "is_correct")) -> DataFrame:
    """Missed rows as the rows of a new session: unanswered, and without a link to the bank. They can be missed again."""
    return missed.withColumn("session_id", session).drop(*drop)


def on_the_wire(rows: DataFrame) -> DataFrame:
    """Rows without what would give the answers away."""
    return rows.drop(*ANSWERS)


def results(rows: DataFrame, session: str = "session_id") -> DataFrame:
    """Answered rows with all answer columns, in order of position."""
    return rows.orderBy(session, "position")


def fallback_item(given: Column, known: Column, planned: Column) -> Column:
    """The given scope item if the scope has it, else the first planned one, else null."""
    return F.when(F.coalesce(F.array_contains(known, given), F.lit(False)), given).otherwise(F.get(planned, F.lit(0)))


def option_explanations(options: Column, correct: Column, explanation: Column) -> Column:
    """The one explanation of a record for each of its options, marked right or wrong."""
    return F.transform(options, lambda o, i: F.struct(o["id"].alias("optionId"), F.array_contains(correct, i).alias("isCorrect"), F.coalesce(explanation, F.lit("")).alias("explanation")))


def in_locale_order(text: Column, locale: str = "UNICODE") -> Column:
    """A sort key that compares as a locale does: letters before case, accents after letters."""
    return F.collate(text, locale)
