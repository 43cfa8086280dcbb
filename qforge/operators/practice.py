"""Practice tests end to end: parsed questions meet their answer key and become records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qforge.functions import text as X
from qforge.operators import parse as P
from qforge.operators.bank import keep_first

#: Bytes of test texts whose questions one task takes: records are some thirty times as large, and all the more than what a shuffle makes of such texts.
TASK_BYTES = 4 << 20


def joined(questions: DataFrame, answers: DataFrame, *keys: str) -> DataFrame:
    """Questions with label and explanation of the answer with their number; without one both are null."""
    return questions.join(answers.select(*keys, "number", "label", "explanation"), [*keys, "number"], "left")


def record_flags(options: Column, label: Column) -> Column:
    """Names of the defects, in a fixed order."""
    ids = F.transform(options, lambda o: o["id"])
    rules = [(F.size(options) != 4, "missing_or_extra_options"), (label.isNull(), "no_answer_label"), (label.isNotNull() & ~F.array_contains(ids, label), "answer_label_not_in_options")]
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for rule, name in rules]))


def finalized(rows: DataFrame) -> DataFrame:
    """Records of (test, portion, number, prompt, options, label, explanation): id, question (a placeholder for an empty prompt), labels, tags, correct, flags, actions, status, confidence, content_hash."""
    test = F.concat(F.lit("Practice Test "), F.col("test").cast("string"))
    options = F.filter("options", lambda o: o["text"] != "")
    rows = rows.withColumn("options", options).withColumn("question", F.when(F.coalesce("prompt", F.lit("")) != "", F.col("prompt")).otherwise(F.concat(F.lit("("), test, F.lit(" "), F.col("portion"), F.lit(" #"), F.col("number").cast("string"), F.lit(")"))))
    at = F.array_position(F.transform("options", lambda o: o["id"]), F.col("label")).cast("int") - 1
    rows = rows.withColumns({
        "id": F.concat_ws("-", F.lit("pt"), F.col("test").cast("string"), F.lower("portion"), F.col("number").cast("string")),
        "labels": F.array(test, F.col("portion"), F.concat(F.lit("National Portion "), F.col("test").cast("string")), F.col("portion")),
        "tags": F.array(test, F.col("portion")),
        "correct": F.when(at >= 0, F.array(at)).otherwise(F.array().cast("array<int>")),
        "flags": record_flags(F.col("options"), F.col("label")),
        "content_hash": X.exact_hash(F.col("question"), F.col("options")),
        "explanation": F.when(F.col("explanation") != "", F.col("explanation")),
    })
    sound = F.size("flags") == 0
    actions = F.transform("flags", lambda f: F.struct(F.concat(F.lit("manual_review_"), f).alias("type"), F.lit("pending").alias("status")))
    return rows.withColumns({"status": F.when(sound, "ready").otherwise("needs_user_review"), "confidence": F.when(sound, 1.0).otherwise(0.5), "actions": actions}).drop("prompt")


def tasks(docs: DataFrame, text: str = "text") -> int:
    """How many tasks records of texts are dealt to."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def records(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(test, portion, text) of question files and of answer-key files to records; of records with one hash the first by test, portion and number stays. Questions are read once more for their size."""
    key, n = F.struct("test", "portion").alias("k"), tasks(questions)
    q, a = (f(files.select(key, "text"), "k").repartition(n, "k", "number") for f, files in ((P.practice_questions, questions), (P.practice_answers, answers)))
    rows = finalized(joined(q, a, "k").select("k.*", "number", "prompt", "options", "label", "explanation"))
    return keep_first(rows, "content_hash", "test", "portion", "number")
