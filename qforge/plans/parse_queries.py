"""Parsers and imports on texts and pages that are composed from the driver's tables, so that SQL knows what has to come out."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qforge.functions import schema as S
from qforge.functions import text as X
from qforge.operators import audits as A
from qforge.operators import merge as MG
from qforge.operators import parse as P
from qforge.operators import practice as PR
from qforge.operators import repair_engine as R
from qforge.plans.tables import table
from qforge.sources import pages as PG
from qforge.storage import current, settled, shared_path
from qforge.streaming import ingest as I
from qforge.streaming import jobs as J

SQL: dict[str, str] = {}

_KEY = "pmod(o_orderkey, 4)"


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """The orders of a customer, numbered from 1; a quiz has 40 numbers at most, so each 40 orders are a document."""
    w = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = table(spark, d, "orders").withColumn("r", w)
    return rows.withColumns({"doc_id": F.concat_ws("-", "o_custkey", F.floor(F.col("r") / 40).cast("string")), "number": (F.col("r") % 40 + 1).cast("int")})


def _documents(spark: SparkSession, d: str) -> DataFrame:
    rows = _numbered(spark, d)
    letter = F.get(F.array(*map(F.lit, "ABCD")), F.expr(_KEY).cast("int"))
    question = F.format_string("%d. Which priority does order number %d have?\nA. %s first\nB. %s second\nC. %s third\nD. %s fourth\nline", "number", "o_orderkey", *["o_orderpriority"] * 4)
    answer = F.format_string("%d. %s Because of order %d.", "number", letter, "o_orderkey")
    parts = rows.groupBy("doc_id", "o_custkey").agg(F.array_sort(F.collect_list(F.struct("number", question.alias("q"), answer.alias("a")))).alias("p"))
    lines = lambda f: F.array_join(F.transform("p", lambda x: x[f]), "\n")
    return parts.select("doc_id", F.concat_ws("\n", F.concat(F.lit("Chapter 7: Orders of "), "o_custkey"), F.lit("Chapter Quiz"), lines("q"), F.lit("**Answer Key**"), lines("a")).alias("text"))


_ROWS = "(SELECT *, o_custkey || '-' || r // 40 AS doc_id, r % 40 + 1 AS number, 'ABCD'[o_orderkey % 4 + 1] AS label FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r FROM orders))"


def parse_questions(spark: SparkSession, d: str) -> DataFrame:
    got = R.records(settled(_documents(spark, d), "quizzes"))
    return got.select("doc_id", "number", "prompt", F.array_join(F.transform("options", lambda o: o["text"]), "|").alias("options"), "label", "explanation", "status", "confidence")


SQL["parse_questions"] = f"""SELECT doc_id, number::int AS number, 'Which priority does order number ' || o_orderkey || ' have?' AS prompt, o_orderpriority || ' first|' || o_orderpriority || ' second|' || o_orderpriority || ' third|' || o_orderpriority || ' fourth line' AS options,
 label, 'Because of order ' || o_orderkey || '.' AS explanation, 'ready' AS status, 1.0::double AS confidence FROM {_ROWS}"""


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    """Quizzes most of whose questions have no number, each fifth one that leaps ahead, options set twice; keys of letters alone, with a number where the questions had one; a header that runs on all pages."""
    rows = _numbered(spark, d).withColumn("leap", F.when(F.col("number") % 5 == 3, F.col("number") + 2 * F.floor(F.col("number") / 10).cast("int")))
    letter = F.get(F.array(*map(F.lit, "ABCD")), F.expr(_KEY).cast("int"))
    head = F.concat(F.coalesce(F.concat(F.col("leap").cast("string"), F.lit(". ")), F.lit("")), F.format_string("Which priority does order number %d have?", "o_orderkey"))
    question = F.concat(head, F.format_string("\nA. wrong at first\nA. %s first\nB. %s second\nQuizzes of the House\nC. %s third\nD. %s fourth\nline", *["o_orderpriority"] * 4))
    answer = F.when(F.col("leap").isNotNull(), F.format_string("%d. %s Because of order %d.", "leap", letter, "o_orderkey")).otherwise(letter)
    parts = rows.groupBy("doc_id", "o_custkey").agg(F.array_sort(F.collect_list(F.struct("number", question.alias("q"), answer.alias("a")))).alias("p"))
    lines = lambda f: F.array_join(F.transform("p", lambda x: x[f]), "\n")
    return parts.select("doc_id", F.concat_ws("\n", F.concat(F.lit("Chapter 7: Orders of "), "o_custkey"), F.lit("Chapter Quiz"), lines("q"), F.lit("Answer Key"), lines("a")).alias("text"))


def parse_unnumbered(spark: SparkSession, d: str) -> DataFrame:
    got = R.records(settled(_mixed(spark, d), "mixed"), running_header="^Quizzes of the House$")
    return got.select("doc_id", "seq", "number", "prompt", F.array_join(F.transform("options", lambda o: o["text"]), "|").alias("options"), "label", "explanation", "status")


# A question's number is its own, or that after the largest so far: the place plus the furthest that any number before it leapt ahead of its place.
SQL["parse_unnumbered"] = f"""SELECT doc_id, number::int AS seq, n::int AS number, 'Which priority does order number ' || o_orderkey || ' have?' AS prompt, o_orderpriority || ' first|' || o_orderpriority || ' second|' || o_orderpriority || ' third|' || o_orderpriority || ' fourth line' AS options,
 label, CASE WHEN leap IS NULL THEN '' ELSE 'Because of order ' || o_orderkey || '.' END AS explanation, 'ready' AS status
FROM (SELECT *, coalesce(leap, number + greatest(0, coalesce(max(leap - number) OVER (PARTITION BY doc_id ORDER BY number), 0))) AS n FROM (SELECT *, CASE WHEN number % 5 = 3 THEN number + 2 * (number // 10) END AS leap FROM {_ROWS}))"""


def sample_questions(spark: SparkSession, d: str) -> DataFrame:
    """Sample questions, without numbers: an answer after the options, a wrapped line in lower case, a next question that is an option alone, and material that ends the section."""
    rows = _numbered(spark, d)
    letter = F.get(F.array(*map(F.lit, "ABCD")), F.expr(_KEY).cast("int"))
    q = F.format_string("Which priority does order number %d have?\nA. %s\nB. two\nC. three\nD. four\n%s Because of order %d\nwhich goes on in lower case", "o_orderkey", "o_orderpriority", letter, "o_orderkey")
    q = F.concat(q, F.when(F.col("number") % 7 == 0, "\nA. an option alone\nB. and another").otherwise(""), F.when(F.col("number") == 30, "\nKey point: no question comes after this").otherwise(""))
    parts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", q.alias("q")))).alias("p"))
    text = F.concat(F.lit("Sample Questions\n"), F.array_join(F.transform("p", lambda x: x["q"]), "\n"))
    docs = settled(parts.select("doc_id", text.alias("text")), "samples")
    got = P.questions(P.headed(docs))
    return got.select("doc_id", "number", "source", "prompt", F.array_join(F.transform("options", lambda o: o["text"]), "|").alias("options"), F.col("inline_label").alias("label"), F.col("inline_explanation").alias("explanation"))


# Before an option alone the wrapped line has no upper-case line ahead of the next option, so it starts a question, whose options the next one sets again; without a next one it keeps its two.
_WRAPPED = "which goes on in lower case"
SQL["sample_questions"] = f"""SELECT doc_id, number::int AS number, 'example_question' AS source, CASE WHEN number % 7 = 1 AND number > 1 THEN '{_WRAPPED}' ELSE 'Which priority does order number ' || o_orderkey || ' have?' END AS prompt, o_orderpriority || '|two|three|four' AS options, label,
 'Because of order ' || o_orderkey || CASE WHEN number % 7 = 0 THEN '' ELSE ' {_WRAPPED}' END AS explanation FROM {_ROWS} WHERE number <= 30
UNION ALL SELECT doc_id, (max(number) + 1)::int, 'example_question', '{_WRAPPED}', 'an option alone|and another', NULL, '' FROM {_ROWS} GROUP BY doc_id HAVING max(number) % 7 = 0 AND max(number) < 30"""


def parse_practice(spark: SparkSession, d: str) -> DataFrame:
    """Practice tests as OCR leaves them: drifted labels, a separator, two questions on one line."""
    rows = _numbered(spark, d)
    q = F.format_string("%d. Which order is number %d?\n-----\nA. %s\nBb. second\nCc) third\nD. fourth", "number", "o_orderkey", "o_orderpriority")
    parts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", q.alias("q")))).alias("p"))
    got = P.practice_questions(settled(parts.select("doc_id", F.array_join(F.transform("p", lambda x: x["q"]), " ").alias("text")), "tests"))
    return got.select("doc_id", "number", "prompt", F.array_join(F.transform("options", lambda o: o["text"]), "|").alias("options"))


SQL["parse_practice"] = f"SELECT doc_id, number::int AS number, 'Which order is number ' || o_orderkey || '?' AS prompt, o_orderpriority || '|second|third|fourth' AS options FROM {_ROWS}"


def parse_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = _numbered(spark, d)
    letter = F.get(F.array(*map(F.lit, "ABCD")), F.expr(_KEY).cast("int"))
    a = F.when(F.col("number") % 3 == 0, F.format_string("%d.\n%s) Order %d.", "number", letter, "o_orderkey")).when(F.col("number") % 3 == 1, F.format_string("%d. | %s) Order %d.", "number", letter, "o_orderkey")).otherwise(F.format_string("%d. Order %d.\nsee above", "number", "o_orderkey"))
    parts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", a.alias("a")))).alias("p"))
    return P.practice_answers(settled(parts.select("doc_id", F.array_join(F.transform("p", lambda x: x["a"]), "\n").alias("text")), "keys"))


SQL["parse_answers"] = f"SELECT doc_id, number::int AS number, CASE WHEN number % 3 = 2 THEN NULL ELSE label END AS label, 'Order ' || o_orderkey || CASE WHEN number % 3 = 2 THEN '. see above' ELSE '.' END AS explanation FROM {_ROWS}"


def damaged_records(spark: SparkSession, d: str) -> DataFrame:
    """Quizzes as OCR leaves them: options run into the prompt, an option that swallowed the next question, a second question within a prompt, which then finds the options before it."""
    rows = _numbered(spark, d)
    letter = F.get(F.array(*map(F.lit, "ABCD")), F.expr(_KEY).cast("int"))
    options = [F.concat("o_orderpriority", F.lit(f" {w}")) for w in ("first", "second", "third", "fourth")]
    inline = F.concat(F.lit(" A. "), options[0], F.lit(" B. "), options[1], F.lit(" C. "), options[2], F.lit(" D. "), options[3])
    listed = F.concat(*[F.concat(F.lit(f"\n{o}. "), t) for o, t in zip("ABCD", options, strict=True)])
    head = F.format_string("%d. Which priority does order number %d have?", "number", "o_orderkey")
    q = F.concat(head, F.when(F.col("number") % 4 == 1, F.concat(inline, listed)).when(F.col("number") % 4 == 2, F.concat(listed, F.lit(" 99. Which one is next"))).when(F.col("number") % 4 == 3, F.concat(F.lit(" 77. What else is there to know?"), listed)).otherwise(listed))
    answer = F.format_string("%d. %s Because of order %d.", "number", letter, "o_orderkey")
    parts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", q.alias("q"), answer.alias("a")))).alias("p"))
    lines = lambda f: F.array_join(F.transform("p", lambda x: x[f]), "\n")
    text = F.concat_ws("\n", F.lit("Chapter 7: Orders"), F.lit("Chapter Quiz"), lines("q"), F.lit("Answer Key"), lines("a"))
    got = R.records(settled(parts.select("doc_id", text.alias("text")), "damaged"))
    applied = F.array_join(F.transform(F.filter("actions", lambda a: a["status"] == "applied"), lambda a: a["type"]), ",")
    return got.select("doc_id", "number", "prompt", F.array_join(F.transform("options", lambda o: o["text"]), "|").alias("options"), "label", "status", applied.alias("applied"), F.array_join("labels", "|").alias("labels"), F.array_join("tags", "|").alias("tags"),
        (F.col("id") == F.concat(F.lit("material-"), F.substring("content_hash", 1, 16), F.lit("-"), F.col("seq"))).alias("has_id"))


SQL["damaged_records"] = f"""SELECT doc_id, number::int AS number, 'Which priority does order number ' || o_orderkey || ' have?' AS prompt, o_orderpriority || ' first|' || o_orderpriority || ' second|' || o_orderpriority || ' third|' || o_orderpriority || ' fourth' AS options, label,
 CASE WHEN number % 4 = 0 THEN 'ready' ELSE 'auto_repaired' END AS status, CASE number % 4 WHEN 1 THEN 'resegment_prompt_and_options' WHEN 2 THEN 'trim_swallowed_option_text' WHEN 3 THEN 'split_merged_numbered_questions' ELSE '' END AS applied, 'chapter_question|Orders' AS labels, 'Orders' AS tags, true AS has_id FROM {_ROWS}
UNION ALL SELECT doc_id, 77, 'What else is there to know?', p || ' first|' || p || ' second|' || p || ' third|' || p || ' fourth 99. Which one is next ' || number || '. Which priority does order number ' || o_orderkey || ' have? 77. What else is there to know?', NULL, 'needs_repair',
 'split_merged_numbered_questions,recover_options_from_source_context', 'chapter_question|Orders', 'Orders', true FROM (SELECT *, lag(o_orderpriority) OVER (PARTITION BY doc_id ORDER BY number) AS p FROM {_ROWS}) WHERE number % 4 = 3"""


def practice_records(spark: SparkSession, d: str) -> DataFrame:
    """Practice tests end to end: questions, some with three options only, meet answers, some missing."""
    rows = _numbered(spark, d).withColumns({"test": F.col("o_custkey").cast("int"), "portion": F.when(F.substring_index("doc_id", "-", -1) == "0", "National").otherwise("State")})
    rows = rows.filter("doc_id like '%-0' or doc_id like '%-1'")
    letter = F.get(F.array(*map(F.lit, "ABCD")), F.expr(_KEY).cast("int"))
    q = F.concat(F.format_string("%d. Which order is number %d?\nA. one\nB. two\nC. three", "number", "o_orderkey"), F.when(F.col("number") % 5 > 0, "\nD. four").otherwise(""))
    a = F.when(F.col("number") % 3 > 0, F.format_string("%d. %s) Order %d.", "number", letter, "o_orderkey"))
    parts = rows.groupBy("test", "portion").agg(F.array_sort(F.collect_list(F.struct("number", q.alias("q"), a.alias("a")))).alias("p"))
    lines = lambda f: F.array_join(F.transform("p", lambda x: x[f]), "\n")
    parts = settled(parts.select("test", "portion", *[lines(f).alias(f) for f in "qa"]), "practice")
    got = PR.records(parts.select("test", "portion", F.col("q").alias("text")), parts.select("test", "portion", F.col("a").alias("text")))
    return got.select("id", "question", F.size("options").alias("n_options"), "label", F.array_join("flags", ",").alias("flags"), "status", "confidence", F.array_join("correct", ",").alias("correct"), "explanation", F.array_join("tags", "|").alias("tags"), F.size("actions").alias("n_actions"))


SQL["practice_records"] = f"""SELECT *, CASE WHEN flags = '' THEN 'ready' ELSE 'needs_user_review' END AS status, CASE WHEN flags = '' THEN 1.0::double ELSE 0.5::double END AS confidence, CASE WHEN flags = '' THEN 0 ELSE len(string_split(flags, ',')) END::int AS n_actions
FROM (SELECT 'pt-' || o_custkey || '-' || lower(portion) || '-' || number AS id, 'Which order is number ' || o_orderkey || '?' AS question, CASE WHEN number % 5 > 0 THEN 4 ELSE 3 END AS n_options, l AS label,
 concat_ws(',', CASE WHEN number % 5 = 0 THEN 'missing_or_extra_options' END, CASE WHEN l IS NULL THEN 'no_answer_label' END, CASE WHEN number % 5 = 0 AND l = 'D' THEN 'answer_label_not_in_options' END) AS flags,
 CASE WHEN l IS NULL OR (number % 5 = 0 AND l = 'D') THEN '' ELSE (o_orderkey % 4)::varchar END AS correct, CASE WHEN l IS NOT NULL THEN 'Order ' || o_orderkey || '.' END AS explanation, 'Practice Test ' || o_custkey || '|' || portion AS tags
 FROM (SELECT *, CASE WHEN doc_id LIKE '%-0' THEN 'National' ELSE 'State' END AS portion, CASE WHEN number % 3 > 0 THEN label END AS l FROM {_ROWS}) WHERE doc_id LIKE '%-0' OR doc_id LIKE '%-1')"""


def section_texts(spark: SparkSession, d: str) -> DataFrame:
    """What a section classifier is sent of each quiz."""
    return A.sections(P.headed(settled(_documents(spark, d), "quizzes"))).select("doc_id", "section", "source", "text")


SQL["section_texts"] = f"""SELECT doc_id, 'Chapter Quiz' AS section, 'chapter_question' AS source, left(string_agg(number || '. Which priority does order number ' || o_orderkey || ' have?' || chr(10) || 'A. ' || o_orderpriority || ' first' || chr(10) || 'B. ' || o_orderpriority || ' second' || chr(10) || 'C. ' || o_orderpriority || ' third' || chr(10)
 || 'D. ' || o_orderpriority || ' fourth' || chr(10) || 'line', chr(10) ORDER BY number), 3000) AS text FROM {_ROWS} GROUP BY doc_id"""


def section_replies(spark: SparkSession, d: str) -> DataFrame:
    """How many sections of each document a classifier, here one that fails on texts of odd length, has replied to."""

    def classifier(request: str) -> str:
        if len(json.loads(request)["text"]) % 2:
            raise ConnectionError("busy")
        return "quiz"

    _, counts = A.classified(A.sections(P.headed(settled(_documents(spark, d), "quizzes"))), classifier, in_flight=4)
    return counts.select("doc_id", "classified", "failed")


SQL["section_replies"] = f"SELECT doc_id, (length(text) % 2 = 0)::int::bigint AS classified, (length(text) % 2)::bigint AS failed FROM ({SQL['section_texts']})"


def merged_bank(spark: SparkSession, d: str) -> DataFrame:
    """Customers as questions of two banks: exact copies, near copies, copies whose answers disagree, and audits, found by fingerprint, that fail some of the first bank's."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    k = F.col("k").cast("string")
    question = F.concat(F.lit("Which clerk signs the deed of customer "), k, F.lit(" about lot "), k * 7 + 1, F.lit(" in town "), k * 13 + 2, F.lit(" before year "), k * 17 + 3)
    options = F.array(*[F.struct(F.lit(o).alias("id"), F.concat(k, F.lit(f" {w}")).alias("text")) for o, w in zip("ABCD", ("grantors sign it", "notaries read this", "heirs at law object", "nobody cares much"), strict=True)])
    said = F.lit("because the first and final deed says so")

    def bank(rows: DataFrame, no: int, q: Column, right: Column) -> DataFrame:
        rows = rows.select("k", F.lit(no).alias("bank_no"), q.alias("question"), options.alias("options"), right.cast("int").alias("right"))
        return rows.select(
            F.concat_ws("-", F.lit(no), "k").alias("id"), F.col("k").cast("int").alias("seq"), "bank_no", "question", "options", said.alias("explanation"), F.lit("ready").alias("status"), F.array().cast("array<string>").alias("flags"),
            F.array().cast("array<struct<type:string,status:string>>").alias("actions"), F.array(F.get(F.array(*map(F.lit, "ABCD")), F.col("right"))).alias("labels"), F.array("right").alias("correct"), X.exact_hash(F.col("question"), F.col("options")).alias("content_hash"), F.lit(True).alias("trusted"), F.lit(False).alias("failed"),
        )

    right = F.col("k") % 4
    first = bank(c, 0, question, right)
    near = bank(c.filter("k % 3 > 0"), 1, F.concat(question, F.when(F.col("k") % 3 == 1, "").otherwise(" now")), F.when(F.col("k") % 5 == 0, (F.col("k") + 1) % 4).otherwise(right))
    audits = first.filter("seq % 6 = 5").select(X.fingerprint(F.col("question"), F.col("options"), F.col("labels"), F.col("explanation")).alias("fingerprint"), F.lit(True).alias("failed"))
    known = spark.createDataFrame([(w,) for w in "which clerk signs the deed customer about lot town before year now first grantors sign notaries read this heirs law object nobody cares much because and final says".split()], "word string")
    out, _ = MG.merged(first.unionByName(near), known, audits)
    return out.select("id", "status", F.array_join("flags", ",").alias("flags"), "removed")


# Copies with one hash go before anything else; of a near pair the second bank's stays only if the audit has failed the first's; both are considered for a dispute unless just one has passed.
SQL["merged_bank"] = """SELECT CASE WHEN k % 3 = 2 AND k % 6 = 5 THEN '1-' || k ELSE '0-' || k END AS id, CASE WHEN k % 3 = 2 AND k % 5 = 0 AND k % 6 <> 5 THEN 'needs_user_review' ELSE 'ready' END AS status,
 CASE WHEN k % 3 = 2 AND k % 5 = 0 AND k % 6 <> 5 THEN 'model_audit_key_disputed' ELSE '' END AS flags, CASE WHEN k % 3 = 2 THEN 1 ELSE 0 END::bigint AS removed FROM (SELECT c_custkey AS k FROM customer)"""


def ingest_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events taken up by a stream, then the state they leave each user's job in."""
    path = shared_path(spark, "ingest")
    events = table(spark, d, "events")
    taken = I.ingest(spark, d, events.schema, f"{path}/state", f"{path}/rows", lambda s: s.select("event_id", "ts", "user_id", "event_type"), glob="events.parquet")
    return I.job_states(taken, "user_id", "ts", "event_type", "click", "purchase", "error").select(F.col("job").alias("user_id"), "status", "progress", "events")


SQL["ingest_stream"] = """SELECT user_id, CASE WHEN f > 0 THEN 'failed' WHEN p > 0 THEN 'completed' WHEN c > 0 THEN 'processing' ELSE 'queued' END AS status, CASE WHEN f > 0 THEN 65 WHEN p > 0 THEN 100 WHEN c > 0 THEN 40 ELSE 10 END AS progress, events
FROM (SELECT user_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS f, count(*) FILTER (WHERE event_type = 'purchase') AS p, count(*) FILTER (WHERE event_type = 'click') AS c FROM events GROUP BY user_id)"""

def job_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same states, kept by a stateful stream with timers; no job waits long enough for its fallback."""
    path = shared_path(spark, "jobs")
    events = J.with_states(spark).readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    kind = F.when(F.col("event_type") == "click", "started").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed")
    updates = J.job_updates(events, "user_id", kind, F.lit("it failed"), wait_ms=3_600_000)
    got = J.latest_updates(J.updates_at(updates, f"{path}/updates", f"{path}/state"))
    return got.select(F.col("job").cast("long").alias("user_id"), "status", "progress", "events", "error", "fallback")


SQL["job_stream"] = """SELECT user_id, CASE WHEN f > 0 THEN 'failed' WHEN p > 0 THEN 'completed' WHEN c > 0 THEN 'processing' ELSE 'queued' END AS status, CASE WHEN f > 0 THEN 65 WHEN p > 0 THEN 100 WHEN c > 0 THEN 40 ELSE 10 END AS progress, events, CASE WHEN f > 0 THEN 'it failed' END AS error, false AS fallback
FROM (SELECT user_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS f, count(*) FILTER (WHERE event_type = 'purchase') AS p, count(*) FILTER (WHERE event_type = 'click') AS c FROM events WHERE user_id IS NOT NULL GROUP BY user_id)"""


def bank_stream(spark: SparkSession, d: str) -> DataFrame:
    """Orders streamed into a bank that takes the first of each customer; the stream loses its checkpoint and starts again, and another replaces the bank's active rows of some customers."""
    root = shared_path(spark, "bank")
    orders = spark.readStream.schema(table(spark, d, "orders").schema).option("pathGlobFilter", "orders.parquet").parquet(d).select("o_custkey", "o_orderkey", (F.col("o_custkey") % 3 == 0).alias("active"))
    for n in (1, 2):
        J.into_bank(orders, root, "orders", f"{root}/state-{n}", lambda b: J.inserted(b, "o_custkey", "o_orderkey"), "orders")
    late = orders.filter("o_custkey % 4 = 1").withColumn("o_orderkey", -F.col("o_orderkey"))
    J.into_bank(late, root, "orders", f"{root}/state-late", lambda b: J.replaced(b, "o_custkey", "active", "o_orderkey"), "late")
    return current(spark, root, "orders")


SQL["bank_stream"] = """SELECT o_custkey, min(o_orderkey) AS o_orderkey, false AS active FROM orders WHERE o_custkey % 3 <> 0 AND o_custkey % 4 <> 1 GROUP BY o_custkey
UNION ALL SELECT o_custkey, min(-o_orderkey), true FROM orders WHERE o_custkey % 4 = 1 GROUP BY o_custkey"""

def validated_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies with questions, sound and unsound in several places, as a model gives them."""
    k = F.col("o_orderkey") % 7
    answers = F.when(k == 1, "[1.5]").when(k == 2, "[-1, 0]").when(k == 6, "[2.0]").otherwise("[0, 1]")
    tail = F.when(k == 3, "").otherwise(', "subtopicTags": ["x"]')
    text = F.when(k == 4, "7").otherwise(F.concat(F.lit('"'), "o_orderpriority", F.lit('"')))
    q = F.concat(F.lit('{"content": '), text, F.lit(', "extra": {"a": 1}, "options": [{"id": "A", "text": "yes"}, {"id": "B"'), F.when(k == 5, "").otherwise(', "text": "no"'), F.lit('}], "correctAnswers": '), answers, F.lit(', "explanations": [{"optionId": "A", "isCorrect": '), F.when(k == 5, '"yes"').otherwise("true"), F.lit(', "explanation": "e"}], "scopeItemId": null'), tail, F.lit("}"))
    reply = F.when(k == 0, F.lit("I can't do that")).otherwise(F.concat(F.lit('Here: {"questions": ['), q, F.lit("]} done")))
    got = table(spark, d, "orders").select("o_orderkey", S.validated(reply, S.QUESTIONS).alias("r"))
    one = F.get("r.value.questions", F.lit(0))
    return got.select("o_orderkey", F.array_join("r.errors", "; ").alias("errors"), one["content"].alias("content"), F.array_join(F.transform(one["correctAnswers"], lambda x: x.cast("string")), ",").alias("correct"), F.size(one["options"]).alias("n_options"))


SQL["validated_replies"] = """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN ': no JSON' WHEN 1 THEN 'questions[0].correctAnswers[0]: no whole number' WHEN 2 THEN 'questions[0].correctAnswers[0]: number under 0' WHEN 3 THEN 'questions[0].subtopicTags: no value'
 WHEN 4 THEN 'questions[0].content: no text' WHEN 5 THEN 'questions[0].options[1].text: no value; questions[0].explanations[0].isCorrect: no truth value' ELSE '' END AS errors, CASE WHEN o_orderkey % 7 = 6 THEN o_orderpriority END AS content,
 CASE WHEN o_orderkey % 7 = 6 THEN '2' END AS correct, CASE WHEN o_orderkey % 7 = 6 THEN 2 END::int AS n_options FROM orders"""


def columned_pages(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pages of two columns, or of one, read by an engine that is a stub: an image is the JSON of its words."""

    def read(image: bytes) -> list:
        return json.loads(image)

    def crop(image: bytes, start: int | None, stop: int | None) -> bytes:
        return json.dumps([w for w in json.loads(image) if (start is None or w["left"] >= start) and (stop is None or w["right"] <= stop)]).encode()

    rows = _numbered(spark, d).withColumn("two", F.col("o_custkey") % 2 == 0)
    word = lambda line, left, right, side: F.struct(line.cast("int").alias("line_id"), F.lit(left).cast("double").alias("left"), F.lit(right).cast("double").alias("right"), (F.col("number") * 40.0).alias("top"), (F.col("number") * 40.0 + 20).alias("bottom"), F.concat(F.lit(side), "number", F.lit(" "), "o_orderkey").alias("text"))
    words = F.when(F.col("two"), F.array(word(2 * F.col("number"), 0.0, 300.0, "left"), word(2 * F.col("number") + 1, 500.0, 800.0, "right"))).otherwise(F.array(word(F.col("number"), 0.0, 800.0, "line")))
    sheets = rows.withColumn("w", words).groupBy("doc_id").agg(F.to_json(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("number", "w"))), lambda x: x["w"]))).cast("binary").alias("image"))
    return PG.page_texts(sheets, ["doc_id"], read, crop).select("doc_id", "text", "engine")


SQL["columned_pages"] = f"""SELECT doc_id, CASE WHEN two AND n >= 3 THEN a || chr(10) || b WHEN two THEN c ELSE d END AS text, CASE WHEN two AND n >= 3 THEN 'columns' ELSE 'bands' END AS engine
FROM (SELECT doc_id, any_value(o_custkey) % 2 = 0 AS two, count(*) AS n, string_agg('left' || number || ' ' || o_orderkey, chr(10) ORDER BY number) AS a, string_agg('right' || number || ' ' || o_orderkey, chr(10) ORDER BY number) AS b,
 string_agg('left' || number || ' ' || o_orderkey || ' right' || number || ' ' || o_orderkey, chr(10) ORDER BY number) AS c, string_agg('line' || number || ' ' || o_orderkey, chr(10) ORDER BY number) AS d FROM {_ROWS} GROUP BY doc_id)"""

QUERIES = {f.__name__: f for f in (parse_questions, parse_unnumbered, sample_questions, parse_practice, parse_answers, damaged_records, practice_records, section_texts, ingest_stream, job_stream, bank_stream, validated_replies, columned_pages, section_replies, merged_bank)}
