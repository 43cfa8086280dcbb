"""What an import leaves behind: resets, corrections, suggestions, notes, batches and flags, as new versions of tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qforge.functions import text as X
from qforge.operators.bank import patched
from qforge.operators.lines import lines
from qforge.operators.scope import context_text


def reset(tables: Mapping[str, DataFrame], topics: DataFrame, what: str) -> dict[str, DataFrame]:
    """Tables without the topics' history (sessions and their rows), questions (the bank and its chunks), or all of that."""
    gone = topics.select("topic_id").distinct()
    scope = {"history": {"sessions", "questions"}, "questions": {"material_questions", "chunks"}}
    names = scope["history"] | scope["questions"] | {"jobs", "suggestions"} if what == "all" else scope[what]
    return {n: t.join(gone, "topic_id", "left_anti") if n in names else t for n, t in tables.items()}


def to_chunks(questions: DataFrame, ids: DataFrame, kind: str = "context") -> tuple[DataFrame, DataFrame]:
    """(chunks made of the questions named, bank with those questions inactive and unresolved)."""
    named = ids.select("id").distinct()
    chunks = questions.join(named, "id", "left_semi").select(F.concat(F.lit("chunk-"), "id").alias("id"), F.lit(kind).alias("kind"), F.col("question").alias("content"))
    hit = questions.join(named.withColumn("_hit", F.lit(True)), "id", "left")
    on = F.col("_hit").isNotNull()
    return chunks, hit.withColumns({"active": F.when(on, False).otherwise(F.col("active")), "reviewStatus": F.when(on, "unresolved").otherwise(F.col("reviewStatus"))}).drop("_hit")


def corrected(questions: DataFrame, bank: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, bank) with the answers of verdicts that correct a question (id, answers, explanation), and of the bank record it came from."""
    source = verdicts.join(questions.select("id", "bank_id"), "id").filter("bank_id is not null").select(F.col("bank_id").alias("id"), "answers", "explanation")
    once = source.groupBy("id").agg(F.min(F.struct("answers", "explanation")).alias("v")).select("id", "v.*")
    return patched(questions, verdicts, "id", "answers", "explanation"), patched(bank, once, "id", "answers", "explanation")


def decided(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pending suggestions with their decisions; others stay as they are."""
    d = decisions.select("id", F.col("status").alias("_to"))
    return suggestions.join(d, "id", "left").withColumn("status", F.when((F.col("status") == "pending") & F.col("_to").isNotNull(), F.col("_to")).otherwise(F.col("status"))).drop("_to")


def definition_suggested(chunks: DataFrame, by: str, order: str, content: str, most: int = 4000) -> DataFrame:
    """(by, type, instructions): the definition chunks of a topic, joined by blank lines and cut."""
    return context_text(chunks, by, order, content, most).select(by, F.lit("definition").alias("type"), F.col("context").alias("instructions"))


def approved_definitions(topics: DataFrame, suggestions: DataFrame, key: str = "topic_id", most: int = 4000) -> DataFrame:
    """Topics whose instructions go on with those of their approved definition suggestions, in order of id; cut to ``most`` characters."""
    new = suggestions.filter("status = 'approved' and type = 'definition'").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "instructions"))), lambda x: x["instructions"]), "\n\n").alias("_new"))
    joined = topics.join(new, key, "left")
    return joined.withColumn("instructions", F.when(F.col("_new").isNull(), F.col("instructions")).otherwise(with_notes(F.col("instructions"), F.col("_new"), most))).drop("_new")


def approved_scope(current: DataFrame, suggestions: DataFrame, key: str = "topic_id", title: str = "title") -> DataFrame:
    """(key, title, origin): a topic's scope items with those of its approved scope suggestions (rows of key, status, type, title), by normalised title; what is there stays."""
    norm = F.lower(F.trim(F.col(title)))
    new = suggestions.filter("status = 'approved' and type = 'scope'").groupBy(key, norm.alias("_k")).agg(F.min(title).alias("_new"))
    old = current.groupBy(key, norm.alias("_k")).agg(F.min(title).alias("_old"))
    return old.join(new, [key, "_k"], "full_outer").select(key, F.coalesce("_old", "_new").alias(title), F.when(F.col("_old").isNotNull(), "current").otherwise("suggested").alias("origin"))


def with_notes(notes: Column, added: Column, most: int = 4000) -> Column:
    return F.substring(F.concat_ws("\n\n", F.when(notes != "", notes), F.when(added != "", added)), 1, most)


def suggested_scope(chunks: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """(key, chapter, item, line): items of structure chunks under the chapter heading before them, the first of each title (in any case)."""
    parts = chunks.select(key, F.struct(order).alias("o"), content)
    each = lines(parts.select(F.struct(key, "o").alias("k"), content), "k", content).select(F.col(f"k.{key}").alias(key), F.col("k.o").alias("o"), "line_no", X.collapsed(F.col("line")).alias("line")).filter("line <> ''")
    plain = F.col("line").rlike("(?i)^(syllabus|table of contents|contents|outline|objectives?)$")
    heading = F.when(plain, "Imported structure").when(F.col("line").rlike(r"(?i)^(chapter|unit|lesson|module|section)\b"), F.regexp_replace("line", r":\s*$", ""))
    so_far = Window.partitionBy(key).orderBy("o", "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("h", heading).withColumn("chapter", F.coalesce(F.last("h", ignorenulls=True).over(so_far), F.lit("Imported structure"))).filter("h is null")
    title = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("line", r"^[-*•]\s*", ""), r"^\d+[.)]\s*", ""), r"(?i)^[ivx]+[.)]\s+", ""))
    each = each.withColumn("item", title).filter(F.length("item") >= 4)
    first = each.groupBy(key, "chapter", F.lower("item").alias("_k")).agg(F.min(F.struct("o", "line_no", "item")).alias("f"))
    return first.select(key, "chapter", "f.item", F.col("f.line_no").alias("line"))


def flag_outcome(status: Column, verdict_ok: Column, changed: Column) -> Column:
    """upheld, corrected or failed for a flag whose verification ran; pending stays."""
    return F.when(status != "pending", status).when(~verdict_ok, "failed").when(changed, "corrected").otherwise("upheld")


def orphaned(flags: DataFrame, running: DataFrame, key: str) -> DataFrame:
    """Pending flags that no verification holds: to be queued again."""
    return flags.filter("status = 'pending'").join(running.select(key).distinct(), key, "left_anti")


def summary_merged(previous: Column, new: Column) -> Column:
    """Key-wise merge of two maps; the new one's values stay."""
    old = F.map_filter(previous, lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(F.coalesce(old, F.create_map().cast("map<string,string>")), new)


def settled_size(sessions: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Sessions with the number of rows they really have."""
    n = rows.groupBy(key).agg(F.count("*").cast("int").alias("_n"))
    return sessions.join(n, key, "left").withColumn("question_count", F.coalesce("_n", F.lit(0))).drop("_n")


def audit_gate(bank: DataFrame, by: str, status: Column, audited: Column) -> DataFrame:
    """(by, passes, unaudited): whether all servable records of a group have a verdict, and how many lack one."""
    due = X.servable(status) & ~audited
    return bank.groupBy(by).agg((F.count_if(due) == 0).alias("passes"), F.count_if(due).alias("unaudited"))


def fully_audited(bank: DataFrame, audited: Column) -> bool:
    """The gate of an import: no servable record without a verdict."""
    return bank.filter(X.servable(F.col("reviewStatus")) & ~audited).isEmpty()
