"""What an audit sends and gets: items, batches of exact size, prompts for language models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qforge.functions import schema as S
from qforge.operators.sampling import draw_key
from qforge.sources.external import asked
from qforge.storage import settled


def batches(rows: DataFrame, key: str, size: int, seed: str = "batch") -> DataFrame:
    """Adds batch and n: batches of exactly ``size`` rows (the last may have fewer) in hash order of the key, n from 1 within its batch.

    A row's place is its place among the rows of its bucket of the hash plus the rows of the buckets before, so no task sorts more than a bucket of about 64,000 rows.
    """
    digits = max(1, len(f"{max(1, rows.count() // 65_536):x}"))
    keyed = rows.withColumn("_h", draw_key(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, digits))
    sizes = keyed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))  # a row a bucket: 16 ** digits at most
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1
    placed = keyed.join(before, "_b").withColumn("_at", place)
    return placed.withColumns({"batch": F.floor(F.col("_at") / size), "n": (F.col("_at") % size + 1).cast("int")}).drop("_h", "_b", "_before", "_at")


def item(n: Column, question: Column, options: Column, labels: Column, explanation: Column) -> Column:
    """An audit item as JSON: its number, question, options by label, keyed answer and explanation (null if empty)."""
    by_label = F.map_from_entries(F.transform(options, lambda o: F.struct(o["id"], o["text"])))
    said = F.when(explanation != "", explanation)
    return F.to_json(F.struct(n.alias("n"), question.alias("question"), by_label.alias("options"), F.array_join(labels, ",").alias("keyedAnswer"), said.alias("explanation")), {"ignoreNullFields": "false"})


def requests(items: DataFrame, batch: str, n: str, json: str, instructions: str) -> DataFrame:
    """(batch, prompt): one request for each batch, its items as a JSON array in order."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n, json))), lambda x: x[json]), ",")
    return items.groupBy(batch).agg(F.concat(F.lit(instructions), F.lit("\n["), listed, F.lit("]")).alias("prompt"))


def generation_prompt(topic: Column, count: Column, choices: int, multiple: bool, context: Column, instructions: Column, plan: Column, wanted: Column, existing: Column) -> Column:
    """A request for new questions; parts that are null, empty or zero are left out. plan: array of struct(id, title, count)."""
    part = lambda value, text: F.when(value, text)
    kind = "several correct answers are possible" if multiple else "exactly one answer is correct"
    head = F.concat(F.lit("Write "), count.cast("string"), F.lit(' exam questions on "'), topic, F.lit(f'": {choices} choices each (A to {chr(64 + choices)}), {kind}, with an explanation for each choice, one to three tags and the scope item.'))
    lines = F.array_join(F.transform(plan, lambda p: F.concat(F.lit("- "), p["count"].cast("string"), F.lit(" for "), p["id"], F.lit(": "), p["title"])), "\n")
    return F.concat_ws(
        "\n\n", head,
        part(context != "", F.concat(F.lit("Scope:\n"), context)), part(instructions != "", F.concat(F.lit("Instructions:\n"), instructions)), part(F.size(plan) > 0, F.concat(F.lit("Plan:\n"), lines)),
        part(F.size(wanted) > 0, F.concat(F.lit("Only these topics: "), F.array_join(wanted, ", "))), part(existing > 0, F.concat(F.lit("Do not repeat the "), existing.cast("string"), F.lit(" questions that exist."))),
        F.lit('Answer in JSON: {"questions": [{"content", "options": [{"id", "text"}], "correctAnswers": [index from 0], "scopeItemId", "explanations": [{"optionId", "isCorrect", "explanation"}], "subtopicTags"}]}'),
    )


def topic_prompt(asked: Column) -> Column:
    """A request to say what subject a learner means."""
    return F.concat(F.lit("A learner wants to practise for an exam and names its subject in their own words. Say which subject is meant; if several could be, ask one short question and list up to five of them.\n\nThe words: "), F.coalesce(asked, F.lit("")), F.lit('\n\nAnswer in JSON: {"needsClarification": true or false, "clarification": question, "suggestedTopics": [subject], "interpretation": {"title", "description"}}'))


def format_prompt(description: Column) -> Column:
    """A request to say what form the questions of an exam have."""
    return F.concat(F.lit("Say how the questions of this exam are set: how many choices a question has (2 to 10) and whether several can be right, and why.\n\nThe exam: "), F.coalesce(description, F.lit("")), F.lit('\n\nAnswer in JSON: {"choicesCount": number, "isMultiSelect": true or false, "rationale": text}'))


def scope_prompt(description: Column) -> Column:
    """A request to list what an exam covers."""
    return F.concat(F.lit("List what this exam covers, as chapters with items in the order in which they are best learnt.\n\nThe exam: "), F.coalesce(description, F.lit("")), F.lit('\n\nAnswer in JSON: {"chapters": [{"title", "items": [{"title", "details"}]}]}'))


#: Requests about an exam that take one text, with the shape of their replies.
REQUESTS = {"topic": (topic_prompt, S.TOPIC), "format": (format_prompt, S.FORMAT), "scope": (scope_prompt, S.SCOPE)}


def answered(rows: DataFrame, key: str, text: Column, kind: str, call: Callable[[object], str | None], in_flight: int = 1) -> DataFrame:
    """(key, value, errors) of one of the REQUESTS, made of each row's text: the reply in its shape, or where it departs from it; a call that failed is an error of its own."""
    build, shape = REQUESTS[kind]
    replies = asked(rows.select(key, build(text).alias("request")), key, "request", call, in_flight=in_flight)
    got = replies.select(key, "error", S.validated(F.col("reply"), shape).alias("r"))
    return got.select(key, "r.value", F.when(F.col("error").isNotNull(), F.array(F.concat(F.lit(": "), "error"))).otherwise(F.col("r.errors")).alias("errors"))


#: What generated questions look like.
GENERATED = "struct<questions:array<struct<content:string,options:array<struct<id:string,text:string>>,correctAnswers:array<int>,scopeItemId:string,explanations:array<struct<optionId:string,isCorrect:boolean,explanation:string>>,subtopicTags:array<string>>>>"


def generated(reply: Column, choices: int) -> Column:
    """The questions of a reply that have all their choices and answers that point to them; none if it is no such JSON. Text around the outermost braces is passed over."""
    parsed = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), GENERATED)["questions"]
    sound = lambda q: (F.size(q["options"]) == choices) & (F.size(q["correctAnswers"]) > 0) & F.forall(q["correctAnswers"], lambda i: (i >= 0) & (i < choices)) & (q["content"] != "")
    return F.filter(F.coalesce(parsed, F.array().cast(GENERATED[len("struct<questions:") : -1])), lambda q: F.coalesce(sound(q), F.lit(False)))


def sections(heads: DataFrame, key: str = "doc_id", most: int = 3000) -> DataFrame:
    """(key, start, section, source, text): what a section classifier gets, from the lines of ``parse.headed``: the lines under each heading of questions, cut to ``most`` characters."""
    source = F.when(F.col("section.kind") == "exam", "exam_question").when(F.col("section.kind") == "samples", "example_question").otherwise("chapter_question")
    body = heads.filter("section.kind in ('quiz', 'exam', 'samples')").select(key, F.col("section.start").alias("start"), source.alias("source"), "line_no", "line", F.col("heading").isNotNull().alias("is_head"))
    before = F.sum(F.when(~F.col("is_head"), F.length("line") + 1).otherwise(0)).over(Window.partitionBy(key, "start").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    body = body.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("is_head") | (F.col("before") < most + 1))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_head"), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    return body.groupBy(key, "start", "source").agg(F.max(F.when(F.col("is_head"), F.col("line"))).alias("section"), F.substring(text, 1, most).alias("text")).select(key, "start", "section", "source", "text")


def classified(sections: DataFrame, call: Callable[[object], str | None], key: str = "doc_id", first: int = 20, in_flight: int = 1) -> tuple[DataFrame, DataFrame]:
    """(replies, counts) of a section classifier that is asked about the ``first`` sections of each document: (key, start, reply, error), and (key, classified, failed) of every document with sections."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("start"))
    asks = sections.withColumn("_n", nth).filter(F.col("_n") <= first).select(F.struct(key, "start").alias("at"), F.to_json(F.struct("section", "source", "text")).alias("request"))
    asks = asks.withColumn("id", F.to_json("at"))
    replies = settled(asked(asks, "id", "request", call, in_flight=in_flight), "classified")
    told = settled(asks.join(replies, "id").select("at.*", "reply", "error"), "sections")
    counts = told.groupBy(key).agg(F.count_if(F.col("error").isNull()).alias("classified"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return told, sections.select(key).distinct().join(counts, key, "left").fillna(0, ["classified", "failed"])
