"""Documents as ordered lines: contexts, look-ahead, answer keys, paragraphs, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qforge.functions import text as X


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no from 1, line): texts split at line ends. A null text has no lines."""
    return docs.select(key, F.posexplode(F.split(text, "\r?\n")).alias("p", "line")).select(key, (F.col("p") + 1).alias("line_no"), "line")


def filled(rows: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """Adds the last value that is not null, up to and with this row."""
    frame = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(frame))


def ahead(rows: DataFrame, key: str, order: str, mark: Column, n: int, name: str) -> DataFrame:
    """Adds whether one of the next n rows is marked."""
    frame = Window.partitionBy(key).orderBy(order).rowsBetween(1, n)
    return rows.withColumn(name, F.coalesce(F.bool_or(mark).over(frame), F.lit(False)))


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 30, most: int = 200) -> DataFrame:
    """(key, line_start, line_end, content): runs of lines that are not blank, white space collapsed, of ``least`` characters; the first ``most`` of a document."""
    each = lines(docs, key, text).withColumn("blank", X.trimmed(F.col("line")) == "")
    running = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    island = each.withColumn("island", F.sum(F.when(F.col("blank"), 1).otherwise(0)).over(running)).filter(~F.col("blank"))
    out = island.groupBy(key, "island").agg(
        F.min("line_no").alias("line_start"),
        F.max("line_no").alias("line_end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", X.collapsed(F.col("line")).alias("t")))), lambda x: x["t"]), "\n").alias("content"),
    )
    nth = F.row_number().over(Window.partitionBy(key).orderBy("line_start"))
    return out.filter(F.length("content") >= least).withColumn("n", nth).filter(F.col("n") <= most).select(key, "line_start", "line_end", "content")


def outside(spans: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Spans (line_start, line_end) that overlap no range (start, stop) of the same document."""
    r = ranges.select(F.col(key).alias("_k"), F.col("start").alias("_a"), F.col("stop").alias("_b"))
    return spans.join(r, (F.col(key) == F.col("_k")) & (F.col("line_start") <= F.col("_b")) & (F.col("_a") <= F.col("line_end")), "left_anti")


def near(all_lines: DataFrame, spots: DataFrame, key: str, before: int, after: int) -> DataFrame:
    """Lines from ``before`` lines before a spot (start, stop) to ``after`` after it; one row a line and spot."""
    s = spots.select(F.col(key).alias("_k"), "start", "stop")
    return all_lines.join(s, (F.col(key) == F.col("_k")) & F.col("line_no").between(F.col("start") - before, F.col("stop") + after)).drop("_k")


def keyed(questions: DataFrame, answers: DataFrame, contexts: Column, key: list[str], number: str = "number") -> DataFrame:
    """Left join to the answer key on the first of ``contexts`` (an array, best first) that has the question's number. ``key`` names a question; answers: context, number, label, one row each.

    Contexts are tried one after another, each only by the questions that have found nothing so far; a question is shuffled once for each context that it tries. Questions are read once more, for how many that may be.
    """
    columns, ctxs = questions.columns, F.coalesce(F.array_distinct(F.array_compact(contexts)), F.array().cast("array<string>"))
    most = questions.agg(F.max(F.size(ctxs))).first()[0] or 0
    found = answers.filter("label is not null").groupBy(F.col("context").alias("_at"), F.col(number).alias("_no")).agg(F.min("label").alias("_label"))
    none = F.lit(None).cast("string")
    out, left = questions.filter(F.size(ctxs) == 0).select(*columns, none.alias("label"), none.alias("matched_context")), questions.filter(F.size(ctxs) > 0)
    for i in range(most):
        met = left.withColumn("_ctx", F.get(ctxs, F.lit(i))).join(found, (F.col("_ctx") == F.col("_at")) & (F.col(number) == F.col("_no")), "left")
        # one value of both sides of the join, else Spark would shuffle what goes on by itself
        over = F.coalesce("_label", F.when(F.size(ctxs) <= i + 1, ""))
        out = out.union(met.filter(over.isNotNull()).select(*columns, F.col("_label").alias("label"), F.when(F.col("_label").isNotNull(), F.col("_ctx")).alias("matched_context")))
        left = met.filter(over.isNull()).select(*columns)
    return out
