"""Quiz, audit, import and record queries on the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qforge.functions import text as X
from qforge.operators import analytics as A
from qforge.operators import audits as D
from qforge.operators import bank as B
from qforge.operators import imports as M
from qforge.operators import quizzes as Q
from qforge.operators import repair_engine as R
from qforge.operators import sampling as S
from qforge.operators import scope as C
from qforge.operators import verdicts as V
from qforge.plans.tables import AUDITED, audited, table
from qforge.sources import external as E
from qforge.sources import readers as I
from qforge.storage import current, published, shared_path, write_json
from qforge.streaming import ingest as G

SQL: dict[str, str] = {}
_SPACE = X.SPACE


def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.filter(Q.in_filter(F.col("source"), F.array("lang"), ["SRC1", "En"])).select("doc_id")


SQL["scope_filter"] = "SELECT doc_id FROM documents WHERE coalesce(lower(source) IN ('src1', 'en'), false) OR coalesce(lower(lang) IN ('src1', 'en'), false)"


def _questions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("bank_id"), F.concat(F.lit("part "), "l_partkey").alias("content"), (F.col("l_suppkey") % 4).cast("string").alias("correct_answers"),
        F.when(F.col("l_tax") > 0, (F.col("l_partkey") % 4).cast("string")).alias("user_answers"), F.when(F.col("l_tax") > 0, F.col("l_suppkey") % 4 == F.col("l_partkey") % 4).alias("is_correct"), "l_linenumber",
    )
    return B.numbered(rows, "session_id", "l_linenumber", "bank_id", "correct_answers")


_QUESTIONS = """(SELECT l_orderkey AS session_id, l_partkey AS bank_id, 'part ' || l_partkey AS content, (l_suppkey % 4)::varchar AS correct_answers, CASE WHEN l_tax > 0 THEN (l_partkey % 4)::varchar END AS user_answers,
 CASE WHEN l_tax > 0 THEN l_suppkey % 4 = l_partkey % 4 END AS is_correct, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, (l_suppkey % 4)::varchar) AS position FROM lineitem)"""


def quiz_wire(spark: SparkSession, d: str) -> DataFrame:
    """What a player sees of a session: no answers."""
    return Q.on_the_wire(_questions(spark, d)).drop("l_linenumber", "bank_id")


SQL["quiz_wire"] = f"SELECT session_id, content, position FROM {_QUESTIONS}"


def quiz_results(spark: SparkSession, d: str) -> DataFrame:
    return Q.results(_questions(spark, d)).select("session_id", "position", "correct_answers", "user_answers", "is_correct")


SQL["quiz_results"] = f"SELECT session_id, position, correct_answers, user_answers, is_correct FROM {_QUESTIONS}"


def retry_quiz(spark: SparkSession, d: str) -> DataFrame:
    missed = _questions(spark, d).filter(F.col("is_correct") == False)  # noqa: E712  unanswered is not missed
    again = Q.retry(missed, F.concat(F.lit("retry-"), "session_id"))
    return B.with_ids(again, "session_id", "position").select("id", "session_id", "content", "correct_answers")


SQL["retry_quiz"] = f"SELECT left(sha256('retry-' || session_id || chr(31) || position), 32) AS id, 'retry-' || session_id AS session_id, content, correct_answers FROM {_QUESTIONS} WHERE is_correct = false"


def hybrid_fill(spark: SparkSession, d: str) -> DataFrame:
    drawn = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") != "R").alias("selected"))
    return drawn.withColumn("generated", Q.hybrid_fill(F.lit(5), F.col("selected")))


SQL["hybrid_fill"] = "SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag <> 'R') AS selected, greatest(0, 5 - count(*) FILTER (WHERE l_returnflag <> 'R')) AS generated FROM lineitem GROUP BY l_orderkey"


def fallback_item(spark: SparkSession, d: str) -> DataFrame:
    given = F.when(F.col("o_orderkey") % 7 != 0, F.substring("o_orderpriority", 1, 1))
    return table(spark, d, "orders").select("o_orderkey", Q.fallback_item(given, F.array(F.lit("1"), F.lit("3")), F.when(F.col("o_orderstatus") != "P", F.array("o_orderstatus"))).alias("item"))


SQL["fallback_item"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 AND left(o_orderpriority, 1) IN ('1', '3') THEN left(o_orderpriority, 1) WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS item FROM orders"


def _options(*texts: Column) -> Column:
    return F.array(*[F.struct(F.lit(o).alias("id"), t.alias("text")) for o, t in zip("ABCD", texts, strict=False)])


def option_explanations(spark: SparkSession, d: str) -> DataFrame:
    each = Q.option_explanations(_options(F.col("o_orderpriority"), F.col("o_orderstatus")), F.array((F.col("o_orderkey") % 2).cast("int")), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")))
    return table(spark, d, "orders").select("o_orderkey", F.explode(each).alias("e")).select("o_orderkey", "e.*")


SQL["option_explanations"] = "SELECT o_orderkey, o AS optionId, (o = 'A') = (o_orderkey % 2 = 0) AS isCorrect, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority ELSE '' END AS explanation FROM orders, (SELECT unnest(['A', 'B']) AS o)"


def locale_order(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("p_brand").orderBy("p_size", Q.in_locale_order(F.col("p_name")), "p_partkey")
    return table(spark, d, "part").select("p_partkey", F.row_number().over(order).alias("place"))


SQL["locale_order"] = "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_name, p_partkey)::int AS place FROM part"


def usable_layer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.usable_text_layer(F.col("text")).alias("usable"))


SQL["usable_layer"] = f"SELECT doc_id, length(regexp_replace(text, '[{_SPACE}]', '', 'g')) >= 50 AS usable FROM documents"


def audit_items(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("o_orderstatus") != "O", F.concat(F.lit('said "'), "o_orderstatus", F.lit('"')))
    item = D.item(F.lit(1), F.concat(F.lit("Order "), "o_orderkey"), _options(F.col("o_orderpriority"), F.col("o_orderstatus")), F.array(F.lit("A"), F.lit("B")), said)
    return table(spark, d, "orders").select("o_orderkey", item.alias("item"))


SQL["audit_items"] = """SELECT o_orderkey, '{"n":1,"question":"Order ' || o_orderkey || '","options":{"A":"' || o_orderpriority || '","B":"' || o_orderstatus || '"},"keyedAnswer":"A,B","explanation":' || CASE WHEN o_orderstatus <> 'O' THEN '"said \\"' || o_orderstatus || '\\""' ELSE 'null' END || '}' AS item FROM orders"""


def audit_batches(spark: SparkSession, d: str) -> DataFrame:
    return D.batches(table(spark, d, "documents").select("doc_id"), "doc_id", 10)


SQL["audit_batches"] = "SELECT doc_id, (r - 1) // 10 AS batch, ((r - 1) % 10 + 1)::int AS n FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256(doc_id || '|batch'), doc_id) AS r FROM documents)"


def audit_requests(spark: SparkSession, d: str) -> DataFrame:
    rows = D.batches(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 8).withColumn("item", F.to_json(F.struct("n", "o_orderkey")))
    return D.requests(rows, "batch", "n", "item", "Judge each item.")


SQL["audit_requests"] = """SELECT (r - 1) // 8 AS batch, 'Judge each item.' || chr(10) || '[' || string_agg('{"n":' || ((r - 1) % 8 + 1) || ',"o_orderkey":' || o_orderkey || '}', ',' ORDER BY r) || ']' AS prompt
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY sha256(o_orderkey || '|batch'), o_orderkey) AS r FROM orders) GROUP BY (r - 1) // 8"""


def content_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth order is repaired; of those some are stale, some have two equal texts, some miss their target."""
    o = table(spark, d, "orders")
    bank = o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("Order "), "o_orderkey").alias("question"), _options(*[F.concat("o_orderpriority", F.lit(x)) for x in " a, b, c, d".split(",")]).alias("options"), F.array(F.lit("A")).alias("labels"),
        F.array(F.lit(0)).alias("correct"), F.lit("").alias("explanation"), F.lit("x").alias("content_hash"), F.lit("needs_repair").alias("status"), F.array(F.lit("no_answer_label")).alias("flags"), F.array().cast("array<struct<type:string,status:string,note:string>>").alias("actions"),
    )
    k = F.col("o_orderkey")
    repairs = o.filter(k % 5 == 0).select(
        F.when(k % 15 == 0, F.concat(F.lit("gone-"), k)).otherwise(k.cast("string")).alias("id"), F.when(k % 25 == 0, "old").otherwise("now").alias("fingerprint"), F.lit("source").alias("kind"), F.concat(F.lit("Mended "), k).alias("question"),
        _options(F.lit("one"), F.when(k % 35 == 0, " ONE").otherwise("two"), F.lit("three"), F.lit("four")).alias("options"), F.array(F.lit("C")).alias("labels"), F.lit("because").alias("explanation"), F.lit("seen").alias("note"), F.lit("[]").alias("evidence"),
    )
    out, problems = B.content_repaired(bank, repairs, F.lit("now"))
    out = out.select("id", "question", "status", F.element_at("correct", 1).alias("correct"), F.size("actions").alias("n_actions"), "content_hash")
    return out.join(problems.withColumn("id", F.regexp_replace("id", "^gone-", "")), "id", "left")


SQL["content_repairs"] = """SELECT *, CASE WHEN status = 'auto_repaired' THEN 'Mended ' ELSE 'Order ' END || id AS question, CASE WHEN status = 'auto_repaired' THEN 2 ELSE 0 END AS correct, CASE WHEN status = 'auto_repaired' THEN 1 ELSE 0 END AS n_actions,
 CASE WHEN status = 'auto_repaired' THEN sha256('Mended ' || id || chr(10) || 'A.one' || chr(10) || 'B.two' || chr(10) || 'C.three' || chr(10) || 'D.four') ELSE 'x' END AS content_hash
FROM (SELECT *, CASE WHEN k % 5 = 0 AND problem IS NULL THEN 'auto_repaired' ELSE 'needs_repair' END AS status FROM (SELECT o_orderkey AS k, o_orderkey::varchar AS id,
 CASE WHEN o_orderkey % 5 <> 0 THEN NULL WHEN o_orderkey % 15 = 0 THEN 'missing' WHEN o_orderkey % 25 = 0 THEN 'stale' WHEN o_orderkey % 35 = 0 THEN 'same_texts' END AS problem FROM orders))"""
SQL["content_repairs"] = SQL["content_repairs"].replace("SELECT *, CASE WHEN status", "SELECT id, status, problem, CASE WHEN status", 1)


def answer_demotion(spark: SparkSession, d: str) -> DataFrame:
    at = F.when(F.col("l_tax") > 0, F.array((F.col("l_suppkey") % 6).cast("int"))).otherwise(F.array().cast("array<int>"))
    status = F.when(F.col("l_returnflag") == "R", "ready").when(F.col("l_returnflag") == "A", "auto_repaired").otherwise("needs_repair")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", B.demoted(status, at, F.array(*map(F.lit, "ABCD"))).alias("status"))


SQL["answer_demotion"] = "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag NOT IN ('R', 'A') THEN 'needs_repair' WHEN l_tax > 0 AND l_suppkey % 6 < 4 THEN CASE WHEN l_returnflag = 'R' THEN 'ready' ELSE 'auto_repaired' END ELSE 'needs_user_review' END AS status FROM lineitem"


def stale_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Labels of toxic documents are of an older version, and so due again."""
    verdicts = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "v1").otherwise("v2").alias("version"))
    return B.stale(table(spark, d, "documents"), verdicts, "v2", key="doc_id").select("doc_id")


SQL["stale_verdicts"] = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic IS DISTINCT FROM 1)"


def last_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Of an order's items as verdicts the last one counts."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey")
    return B.latest_verdicts(rows, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "l_returnflag")


SQL["last_verdict"] = "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_returnflag DESC, l_partkey DESC, l_suppkey DESC) = 1"


def _outcome() -> Column:
    return B.audit_outcome(F.col("status"), F.col("quality").isNotNull(), F.col("quality") == 1, F.lit(True), F.when(F.col("toxic") == 1, "wrong").otherwise("correct"), F.col("doc_id") % 2 == 0, F.col("lang") == "en", F.col("n_chars") % 3 > 0)


def audit_counts(spark: SparkSession, d: str) -> DataFrame:
    return B.outcome_counts(audited(spark, d).withColumn("outcome", _outcome()))


SQL["audit_counts"] = f"""SELECT count(*) FILTER (WHERE o NOT IN ('not_servable', 'unaudited')) AS audited, count(*) FILTER (WHERE o = 'unaudited') AS unaudited, count(*) FILTER (WHERE o = 'structure') AS structure, count(*) FILTER (WHERE o = 'key_disputed') AS key_disputed,
 count(*) FILTER (WHERE o = 'explanation_dropped') AS explanation_dropped FROM (SELECT CASE WHEN status <> 'ready' THEN 'not_servable' WHEN quality IS NULL THEN 'unaudited' WHEN quality <> 1 THEN 'structure'
 WHEN toxic = 1 AND doc_id % 2 <> 0 THEN 'key_disputed' WHEN n_chars % 3 = 0 AND lang = 'en' THEN 'explanation_dropped' ELSE 'clean' END AS o FROM {AUDITED})"""


def shared_explanation(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus"))).alias("e"))
    return said.select("o_custkey", A.shared_explanation(F.col("e")).alias("shared"))


SQL["shared_explanation"] = "SELECT o_custkey, CASE WHEN count(e) >= 2 AND count(DISTINCT e) = 1 THEN min(e) END AS shared FROM (SELECT o_custkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS e FROM orders) GROUP BY o_custkey"


def order_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Countdown, score band, answer toggle and a verdict's failure."""
    k, two = F.col("o_orderkey"), F.array(F.lit(1), F.lit(2))
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        "o_orderkey", X.countdown(k % 4000).alias("countdown"), X.score_band(k % 101).alias("band"), F.array_join(X.toggled(two, (k % 4).cast("int"), k % 3 != 0), ",").alias("answers"),
        X.verdict_fails(s != "P", k % 5 != 0, F.when(k % 11 == 0, "wrong").otherwise("correct")).alias("fails"),
    )


SQL["order_scalars"] = """SELECT o_orderkey, (o_orderkey % 4000 // 60) || ':' || lpad((o_orderkey % 4000 % 60)::varchar, 2, '0') AS countdown, CASE WHEN o_orderkey % 101 >= 70 THEN 'high' WHEN o_orderkey % 101 >= 50 THEN 'middle' ELSE 'low' END AS band,
 CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 4)::varchar WHEN o_orderkey % 4 = 1 THEN '2' WHEN o_orderkey % 4 = 2 THEN '1' ELSE '1,2,' || o_orderkey % 4 END AS answers, o_orderstatus = 'P' OR o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 AS fails FROM orders"""


def text_scalars(spark: SparkSession, d: str) -> DataFrame:
    """File names, long tokens, cut texts, section kinds and review reasons."""
    t, first = F.col("text"), F.get(F.split("text", "\n"), F.lit(0))
    labels = F.when(F.col("lang") == "en", F.array(F.lit("A"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "documents").select(
        "doc_id", X.safe_file_name(F.substring(t, 1, 60)).alias("file_name"), F.size(X.long_tokens(t)).alias("tokens"), X.short(F.when(F.col("doc_id") % 9 != 0, t), 30).alias("short"),
        X.section_kind(F.concat(F.when(F.col("doc_id") % 3 == 0, "Sample Exam ").when(F.col("doc_id") % 3 == 1, "sample questions ").otherwise(""), first)).alias("section"), X.review_reason(labels, F.split("source", "1")).alias("reason"),
    )


SQL["text_scalars"] = f"""SELECT doc_id, regexp_replace(left(text, 60), '[^a-zA-Z0-9._-]', '_', 'g') AS file_name, len(list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9]', ' ', 'g'), ' +'), lambda x: length(x) > 2))) AS tokens,
 left(regexp_replace(CASE WHEN doc_id % 9 <> 0 THEN text ELSE '' END, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g'), 30) AS short, CASE doc_id % 3 WHEN 0 THEN 'exam_question' WHEN 1 THEN 'example_question' ELSE 'chapter_question' END AS section,
 CASE WHEN lang IS DISTINCT FROM 'en' THEN 'Missing answer' WHEN len(string_split(source, '1')) <> 4 THEN 'Expected four answer options' ELSE 'Low confidence OCR extraction' END AS reason FROM documents"""


def upper_medians(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(X.upper_median(F.collect_list("l_quantity")).alias("median"))


SQL["upper_medians"] = "SELECT l_orderkey, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] AS median FROM lineitem GROUP BY l_orderkey"


def settled_sizes(spark: SparkSession, d: str) -> DataFrame:
    sessions = table(spark, d, "orders").select(F.col("o_orderkey").alias("s"), F.lit(5).alias("question_count"))
    return M.settled_size(sessions, table(spark, d, "lineitem").filter("l_tax > 0").select(F.col("l_orderkey").alias("s")), "s")


SQL["settled_sizes"] = "SELECT o_orderkey AS s, count(l_orderkey)::int AS question_count FROM orders LEFT JOIN (SELECT l_orderkey FROM lineitem WHERE l_tax > 0) ON o_orderkey = l_orderkey GROUP BY o_orderkey"


def merged_summaries(spark: SparkSession, d: str) -> DataFrame:
    old = F.map_from_entries(F.array(F.struct(F.lit("priority").alias("k"), F.col("o_orderpriority").alias("v")), F.struct(F.lit("status").alias("k"), F.col("o_orderstatus").alias("v"))))
    m = M.summary_merged(F.when(F.col("o_orderkey") % 3 > 0, old), F.create_map(F.lit("status"), F.lit("new")))
    return table(spark, d, "orders").select("o_orderkey", m["priority"].alias("priority"), m["status"].alias("status"))


SQL["merged_summaries"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS priority, 'new' AS status FROM orders"


def import_gate(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose servable documents all have a verdict."""
    return M.audit_gate(audited(spark, d), "source", F.col("status"), F.col("quality").isNotNull())


SQL["import_gate"] = f"SELECT source, bool_and(status <> 'ready' OR quality IS NOT NULL) AS passes, count(*) FILTER (WHERE status = 'ready' AND quality IS NULL) AS unaudited FROM {AUDITED} GROUP BY source"


def chunks_from_questions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("question"), F.lit(True).alias("active"), F.lit("ready").alias("reviewStatus"))
    toxic = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))
    chunks, rest = M.to_chunks(docs, toxic)
    return rest.select("id", "active", "reviewStatus").union(chunks.select("id", F.lit(None).cast("boolean"), "kind"))


SQL["chunks_from_questions"] = """WITH t AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) SELECT doc_id::varchar AS id, doc_id NOT IN (FROM t) AS active, CASE WHEN doc_id IN (FROM t) THEN 'unresolved' ELSE 'ready' END AS reviewStatus FROM documents
UNION ALL SELECT 'chunk-' || doc_id, NULL, 'context' FROM documents WHERE doc_id IN (FROM t)"""


def scoped_reset(spark: SparkSession, d: str) -> DataFrame:
    """What stays of each table when the topics of some customers are reset in history only."""
    topic = (F.col("o_custkey") % 10).alias("topic_id")
    orders = table(spark, d, "orders").select(topic, F.col("o_orderkey").alias("k"))
    tables = {"sessions": orders, "questions": table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("k")).select("topic_id", "l_orderkey"), "chunks": orders, "material_questions": orders}
    left = M.reset(tables, spark.range(3, 6).select(F.col("id").alias("topic_id")), "history")
    out = [t.groupBy("topic_id").agg(F.count("*").alias("n")).withColumn("name", F.lit(name)) for name, t in left.items()]
    return out[0].union(out[1]).union(out[2]).union(out[3])


SQL["scoped_reset"] = """WITH s AS (SELECT o_custkey % 10 AS topic_id, o_orderkey FROM orders) SELECT topic_id, count(*) AS n, name FROM (SELECT topic_id, 'sessions' AS name FROM s WHERE topic_id NOT IN (3, 4, 5)
 UNION ALL SELECT topic_id, 'questions' FROM lineitem JOIN s ON l_orderkey = o_orderkey WHERE topic_id NOT IN (3, 4, 5) UNION ALL SELECT topic_id, unnest(['chunks', 'material_questions']) FROM s) GROUP BY topic_id, name"""


def suggestion_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Pending suggestions are decided; what definitions were approved goes to the topic's instructions."""
    o = table(spark, d, "orders")
    s = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("topic_id"), F.when(F.col("o_orderstatus") == "P", "rejected").otherwise("pending").alias("status"), F.lit("definition").alias("type"), F.col("o_orderpriority").alias("instructions"))
    decided = M.decided(s, o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit("approved").alias("status")))
    topics = table(spark, d, "customer").select(F.col("c_custkey").alias("topic_id"), F.col("c_mktsegment").alias("instructions"))
    return M.approved_definitions(topics, decided)


SQL["suggestion_decisions"] = """SELECT c_custkey AS topic_id, left(c_mktsegment || coalesce(chr(10) || chr(10) || i, ''), 4000) AS instructions FROM customer LEFT JOIN (SELECT o_custkey, string_agg(o_orderpriority, chr(10) || chr(10) ORDER BY o_orderkey) AS i
 FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 3 = 0 GROUP BY o_custkey) ON c_custkey = o_custkey"""


def approved_scopes(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    current_items = part.filter("p_size < 20").select(F.col("p_brand").alias("topic_id"), F.col("p_name").alias("title"))
    s = part.select(F.col("p_brand").alias("topic_id"), F.when(F.col("p_size") % 2 == 0, "approved").otherwise("pending").alias("status"), F.lit("scope").alias("type"), F.upper("p_name").alias("title"))
    return M.approved_scope(current_items, s)


SQL["approved_scopes"] = """SELECT coalesce(a.topic_id, b.topic_id) AS topic_id, coalesce(c, s) AS title, CASE WHEN c IS NOT NULL THEN 'current' ELSE 'suggested' END AS origin FROM (SELECT p_brand AS topic_id, lower(trim(p_name)) AS k, min(p_name) AS c FROM part WHERE p_size < 20 GROUP BY 1, 2) a
 FULL JOIN (SELECT p_brand AS topic_id, lower(trim(p_name)) AS k, min(upper(p_name)) AS s FROM part WHERE p_size % 2 = 0 GROUP BY 1, 2) b ON a.topic_id = b.topic_id AND a.k = b.k"""


def verdict_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on returned items correct the question and the bank record it came from; here the bank."""
    q = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_partkey").alias("bank_id"), F.lit("old").alias("answers"), F.lit("").alias("explanation"), "l_returnflag", "l_suppkey")
    verdicts = q.filter("l_returnflag = 'R'").groupBy("id").agg(F.concat(F.lit("s"), F.min("l_suppkey")).alias("answers"), F.lit("seen").alias("explanation"))
    bank = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("old").alias("answers"), F.lit("").alias("explanation"))
    return M.corrected(q.groupBy("id", "answers", "explanation").agg(F.min("bank_id").alias("bank_id")), bank, verdicts)[1]


SQL["verdict_corrections"] = """WITH q AS (SELECT l_orderkey || '-' || l_linenumber AS id, min(l_partkey) AS bank_id, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1), v AS (SELECT l_orderkey || '-' || l_linenumber AS id, 's' || min(l_suppkey) AS answers FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT p_partkey AS id, coalesce(a, 'old') AS answers, CASE WHEN a IS NULL THEN '' ELSE 'seen' END AS explanation FROM part LEFT JOIN (SELECT bank_id, min(answers) AS a FROM v JOIN q USING (id) GROUP BY bank_id) ON p_partkey = bank_id"""


def appended_notes(spark: SparkSession, d: str) -> DataFrame:
    added = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("")
    return table(spark, d, "orders").select("o_orderkey", M.with_notes(F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderpriority")), added, 12).alias("notes"))


SQL["appended_notes"] = "SELECT o_orderkey, left(concat_ws(chr(10) || chr(10), CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END), 12) AS notes FROM orders"


def soft_deletes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.lit(True).alias("active"), F.lit(None).cast("timestamp").alias("archived_at"))
    gone = B.soft_deleted(docs, F.col("doc_id") % 10 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return B.excluded(gone, table(spark, d, "labels").filter("toxic = 1"), "doc_id")


SQL["soft_deletes"] = "SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AS active, CASE WHEN doc_id % 10 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS archived_at FROM documents"


def scope_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Structure chunks made of parts: a chapter for each size, with its names as items."""
    chunk = F.concat(F.lit("Chapter "), "p_size", F.lit(":\n- "), "p_name", F.lit("\n2. "), "p_name", F.lit(" again"))
    return M.suggested_scope(table(spark, d, "part").select("p_brand", "p_partkey", chunk.alias("content")), "p_brand", "p_partkey", "content").select("p_brand", "chapter", "item")


SQL["scope_suggestions"] = "SELECT DISTINCT p_brand, 'Chapter ' || p_size AS chapter, unnest([p_name, p_name || ' again']) AS item FROM part"


def definition_suggestions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.concat("o_orderpriority", F.lit(" must")).alias("content"))
    return M.definition_suggested(rows, "o_custkey", "o_orderkey", "content", 60)


SQL["definition_suggestions"] = "SELECT o_custkey, 'definition' AS type, left(string_agg(o_orderpriority || ' must', chr(10) || chr(10) ORDER BY o_orderkey), 60) AS instructions FROM orders GROUP BY o_custkey"


def json_objects(spark: SparkSession, d: str) -> DataFrame:
    """Replies with text around their JSON, and some without any."""
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Sure: "), "props", F.lit(" ok"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise("none {")
    return table(spark, d, "events").select("event_id", F.try_variant_get(X.json_object(reply), "$.k", "int").alias("k"))


SQL["json_objects"] = "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN json_extract_string(props, '$.k')::int END AS k FROM events"


def flag_workflow(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of flags, and which pending ones no verification holds."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "O", "pending").otherwise("upheld").alias("status"), (F.col("l_tax") > 0).alias("ok"), (F.col("l_returnflag") == "R").alias("changed"))
    running = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    lost = M.orphaned(rows, running, "l_orderkey").select("l_orderkey", "l_linenumber", F.lit("orphaned").alias("outcome"))
    return rows.select("l_orderkey", "l_linenumber", M.flag_outcome(F.col("status"), F.col("ok"), F.col("changed")).alias("outcome")).union(lost)


SQL["flag_workflow"] = """SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus <> 'O' THEN 'upheld' WHEN l_tax <= 0 THEN 'failed' WHEN l_returnflag = 'R' THEN 'corrected' ELSE 'upheld' END AS outcome FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'orphaned' FROM lineitem WHERE l_linestatus = 'O' AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"""


def uncached_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id")
    return G.uncached(pages, pages.filter("page_id % 4 = 1"), "page_id")


SQL["uncached_pages"] = "SELECT page_id FROM pages WHERE page_id % 4 <> 1"


def overdue_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Every three events are a job: those that are still queued a day after their last event."""
    e = table(spark, d, "events").withColumn("job_id", F.floor(F.col("event_id") / 3))
    states = G.job_states(e, "job_id", "ts", "event_type", "purchase", "error", "refund")
    return G.overdue(states, e.agg(F.max("ts").alias("now")), 86_400).select(F.col("job").alias("job_id"))


SQL["overdue_jobs"] = "SELECT event_id // 3 AS job_id FROM events GROUP BY event_id // 3 HAVING count(*) FILTER (WHERE event_type IN ('purchase', 'error')) = 0 AND max(ts) < (SELECT max(ts) FROM events) - INTERVAL 1 DAY"


def marked_sources(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "orders").select("o_custkey", F.concat(F.lit("f"), "o_orderkey").alias("path"), F.col("o_orderpriority").alias("text"))
    return I.under_markers(files, "o_custkey")


SQL["marked_sources"] = "SELECT o_custkey, string_agg('[PDF_SOURCE f' || o_orderkey || ']' || chr(10) || o_orderpriority, chr(10) || chr(10) ORDER BY 'f' || o_orderkey) AS text FROM orders GROUP BY o_custkey"


def combined_texts(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "P", " ").when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("text"))
    return I.combined(parts, "o_custkey", "o_orderkey", "text")


SQL["combined_texts"] = "SELECT o_custkey, string_agg(o_orderpriority, chr(10) || chr(10) ORDER BY o_orderkey) AS text FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey"


def file_kinds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 5
    mime = F.when(k == 0, "application/PDF").when(k == 1, "image/png")
    name = F.concat("page_id", F.when(k == 2, ".JPEG").when(k == 3, ".pdf").otherwise(".md"))
    return table(spark, d, "pages").select("page_id", I.file_kind(mime, name).alias("kind"))


SQL["file_kinds"] = "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 3 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'image' ELSE 'text' END AS kind FROM pages"


def accepted_answers(spark: SparkSession, d: str) -> DataFrame:
    """Questions that a verifier is asked, and the answers it is sure enough of. The verifier is a callable; here one that answers from the order's number."""
    ask = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey", F.col("o_orderkey").cast("string").alias("q"))

    def verifier(q: str) -> str:
        return f'{{"labels": ["{"ABCDE"[int(q) % 5]}"], "confidence": {int(q) % 100 / 100}}}'

    replies = E.asked(ask, "o_orderkey", "q", verifier).withColumn("r", F.from_json("reply", "labels array<string>, confidence double")).select("o_orderkey", "r.*")
    return E.accepted(replies, "labels", "confidence").select("o_orderkey", F.get("labels", F.lit(0)).alias("label"))


SQL["accepted_answers"] = "SELECT o_orderkey, 'ABCDE'[o_orderkey % 5 + 1] AS label FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 100 >= 72 AND o_orderkey % 5 < 4"


def chat_replies(spark: SparkSession, d: str) -> DataFrame:
    """The first service that has a reply, without its reasoning."""
    chat = F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("<think>hm\n</think> "), "o_orderpriority").alias("content")).alias("message"))).alias("choices")))
    first = F.when(F.col("o_orderkey") % 2 == 0, chat)
    return table(spark, d, "orders").select("o_orderkey", E.first_reply(F.lit(" "), E.without_reasoning(E.message(first)), F.col("o_orderstatus")).alias("reply"))


SQL["chat_replies"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS reply FROM orders"


def rejected_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    before = o.select(F.col("o_orderkey").alias("id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("content_hash"), F.when(F.col("o_orderstatus") == "F", "rejected").otherwise("ready").alias("status"))
    now = o.filter("o_orderkey % 3 = 0").select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("content_hash"), F.lit(1).alias("seq"), F.lit("ready").alias("status"), F.array("o_orderpriority").alias("flags"))
    return R.diagnostics(before, now).select("previous_id", "current_status", F.array_join("current_flags", ",").alias("current_flags"))


SQL["rejected_diagnostics"] = "SELECT o_orderkey AS previous_id, CASE WHEN o_orderkey % 3 = 0 THEN 'ready' ELSE 'not_matched' END AS current_status, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END AS current_flags FROM orders WHERE o_orderstatus = 'F'"


def published_versions(spark: SparkSession, d: str) -> DataFrame:
    """A table published twice: readers get the second version."""
    docs, root = table(spark, d, "documents").select("doc_id", "lang"), shared_path(spark, "bank")
    published(docs.filter("doc_id % 2 = 0"), root, "documents")
    published(docs, root, "documents")
    return current(spark, root, "documents")


SQL["published_versions"] = "SELECT doc_id, lang FROM documents"


def json_artifacts(spark: SparkSession, d: str) -> DataFrame:
    path = write_json(table(spark, d, "orders").select("o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("labels"), F.when(F.col("o_orderstatus") == "P", "x").alias("note")), shared_path(spark, "artifact"))
    return spark.read.schema("o_orderkey long, labels array<string>, note string").json(path).select("o_orderkey", F.array_join("labels", "|").alias("labels"), "note")


SQL["json_artifacts"] = "SELECT o_orderkey, o_orderstatus || '|' || o_orderpriority AS labels, CASE WHEN o_orderstatus = 'P' THEN 'x' END AS note FROM orders"


def partial_patch(spark: SparkSession, d: str) -> DataFrame:
    """A patch changes the fields that users may change, where it has a value; its other fields do nothing."""
    bank = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("question"), F.col("o_orderstatus").alias("status"), F.lit("h").alias("content_hash"))
    patch = bank.filter("o_orderkey % 4 = 0").select("o_orderkey", F.lit("new").alias("question"), F.when(F.col("o_orderkey") % 8 == 0, "ready").alias("status"), F.lit("forged").alias("content_hash"))
    return B.patched(bank, patch, "o_orderkey", *[f for f in B.EDITABLE if f in bank.columns])


SQL["partial_patch"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderpriority END AS question, CASE WHEN o_orderkey % 8 = 0 THEN 'ready' ELSE o_orderstatus END AS status, 'h' AS content_hash FROM orders"


def _scopes(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("  "), F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_name"))).alias("title"), F.lit(None).cast("string").alias("details"))
    one = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("i")))).alias("x"))
    chapter = F.struct(F.col("p_type").alias("title"), F.transform("x", lambda x: x["i"]).alias("items"))
    return one.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_type", chapter.alias("c")))).alias("y")).select("p_brand", F.transform("y", lambda y: y["c"]).alias("chapters"))


def scope_normalized(spark: SparkSession, d: str) -> DataFrame:
    made = _scopes(spark, d).withColumn("n", C.normalized(F.col("chapters"), most_chapters=3, most_items=4, length=8))
    return made.select("p_brand", F.explode("n").alias("c")).select("p_brand", F.col("c.title").alias("chapter"), F.array_join(F.transform("c.items", lambda i: F.concat(i["id"], F.lit(":"), i["title"])), "|").alias("items"))


SQL["scope_normalized"] = """WITH c AS (SELECT p_brand, p_type, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_type) AS r FROM (SELECT DISTINCT p_brand, p_type FROM part)),
 i AS (SELECT p_brand, p_type, p_partkey, left(trim(p_name), 8) AS t, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS n FROM part WHERE p_size % 7 <> 0)
SELECT c.p_brand, left(c.p_type, 8) AS chapter, coalesce(string_agg(p_partkey || ':' || t, '|' ORDER BY n) FILTER (WHERE n <= 4), '') AS items FROM c LEFT JOIN i ON c.p_brand = i.p_brand AND c.p_type = i.p_type WHERE r <= 3 GROUP BY c.p_brand, c.p_type"""


def scope_active(spark: SparkSession, d: str) -> DataFrame:
    """Items of a scope that are not frozen, and whether it can be used."""
    item = lambda i: F.struct(i["id"].alias("id"), i["title"].alias("title"), (i["id"].cast("int") % 3 > 0).alias("frozen"))
    made = _scopes(spark, d).withColumn("s", F.transform("chapters", lambda c: F.struct(c["title"].alias("title"), F.transform(c["items"], item).alias("items"))))
    return made.select("p_brand", F.size(C.active_items(F.col("s"))).alias("active"), C.usable(F.col("s")).alias("usable"))


SQL["scope_active"] = "SELECT p_brand, (count(*) FILTER (WHERE p_partkey % 3 = 0))::int AS active, count(*) FILTER (WHERE p_partkey % 3 = 0) > 0 AS usable FROM part GROUP BY p_brand"


def scope_described(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_brand", F.col("p_size").alias("chapter_no"), F.concat(F.lit("Size "), "p_size").alias("chapter"), F.col("p_partkey").alias("item_no"), F.col("p_partkey").cast("string").alias("item"), F.col("p_name").alias("title"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("details"), (F.col("p_partkey") % 3 == 0).alias("frozen"))
    return C.described(rows, "p_brand", 500)


SQL["scope_described"] = """WITH c AS (SELECT p_brand, p_size, 'Size ' || p_size || chr(10) || coalesce(string_agg('  - ' || p_partkey || ': ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' - ' || p_type ELSE '' END, chr(10) ORDER BY p_partkey) FILTER (WHERE p_partkey % 3 <> 0), '') AS t
 FROM part GROUP BY p_brand, p_size) SELECT p_brand, left(string_agg(t, chr(10) || chr(10) ORDER BY p_size), 500) AS context FROM c GROUP BY p_brand"""


def generated_questions(spark: SparkSession, d: str) -> DataFrame:
    """Replies of a generator: sound questions are taken, others left."""
    k = F.col("o_orderkey")
    one = F.format_string('{"content": "Q%d", "options": [{"id": "A", "text": "x"}, {"id": "B", "text": "y"}], "correctAnswers": [%d], "subtopicTags": ["t"]}', k, k % 4)
    reply = F.when(k % 5 == 0, "no JSON").otherwise(F.concat(F.lit('Here: {"questions": ['), one, F.lit(", "), F.regexp_replace(one, '"B", "text": "y"', '"B", "text": "z"'), F.lit("]} done")))
    return table(spark, d, "orders").select("o_orderkey", F.size(D.generated(reply, 2)).alias("taken"))


SQL["generated_questions"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 4 < 2 THEN 2 ELSE 0 END AS taken FROM orders"


def generation_prompts(spark: SparkSession, d: str) -> DataFrame:
    plan = F.when(F.col("c_custkey") % 2 == 0, F.array(F.struct(F.lit("i1").alias("id"), F.col("c_mktsegment").alias("title"), F.lit(2).alias("count")))).otherwise(F.array().cast("array<struct<id:string,title:string,count:int>>"))
    prompt = D.generation_prompt(F.col("c_name"), F.lit(3), 4, False, F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")), F.lit(""), plan, F.array(F.lit("x"), F.lit("y")), F.col("c_custkey") % 2)
    return table(spark, d, "customer").select("c_custkey", F.regexp_replace(prompt, r"(?s)\n\nAnswer in JSON.*", "").alias("prompt"))


SQL["generation_prompts"] = """SELECT c_custkey, 'Write 3 exam questions on "' || c_name || '": 4 choices each (A to D), exactly one answer is correct, with an explanation for each choice, one to three tags and the scope item.' || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || chr(10) || 'Scope:' || chr(10) || c_mktsegment ELSE '' END
 || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || chr(10) || 'Plan:' || chr(10) || '- 2 for i1: ' || c_mktsegment ELSE '' END || chr(10) || chr(10) || 'Only these topics: x, y' || CASE WHEN c_custkey % 2 = 1 THEN chr(10) || chr(10) || 'Do not repeat the 1 questions that exist.' ELSE '' END AS prompt FROM customer"""


def verdict_reader(spark: SparkSession, d: str) -> DataFrame:
    """Outputs of an auditing model: whole arrays, arrays cut off, verdicts out of turn, and no JSON at all."""
    k = F.col("o_orderkey")
    one = lambda n, clean: F.concat(F.lit('{"n":' + str(n) + ',"complete":true,"optionsClean":'), F.when(clean, "true").otherwise("false"), F.lit(',"keyVerdict":"wrong","modelAnswer":"C","issues":["x } ]"]}'))
    output = F.when(k % 5 == 0, "no verdict").when(k % 5 == 1, F.concat(F.lit("["), one(2, k % 2 == 0), F.lit("]"))).otherwise(F.concat(F.lit("Here: ["), one(1, k % 2 == 0), F.lit(", "), F.when(k % 3 == 0, one(2, F.lit(True))).otherwise('{"n":2,"comp')))
    got = V.read(table(spark, d, "orders").select("o_orderkey", output.alias("output")), "o_orderkey", "output", 3)
    return got.select("o_orderkey", "n", "complete", "optionsClean", "modelAnswer", "keyVerdict", F.array_join("issues", "|").alias("issues"))


SQL["verdict_reader"] = """SELECT o_orderkey, n::int AS n, true AS complete, n = 2 OR o_orderkey % 2 = 0 AS optionsClean, 'C' AS modelAnswer, 'wrong' AS keyVerdict, 'x } ]' AS issues FROM orders, (SELECT unnest([1, 2]) AS n) WHERE o_orderkey % 5 > 1 AND (n = 1 OR o_orderkey % 3 = 0)"""


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as text layers, a page a turn; thin pages are read by another service, here one that gives the role."""
    layer = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("t")))), lambda x: x["t"]), "\f").alias("text"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    replies = table(spark, d, "conversations").select("conv_id", nth.alias("page"), F.col("role").alias("reply"))
    return I.page_text(I.layer_pages(layer, "conv_id"), replies, "conv_id")


SQL["page_texts"] = f"""SELECT conv_id, string_agg('[PDF_PAGE ' || n || ']' || chr(10) || CASE WHEN length(regexp_replace(text, '[{_SPACE}]', '', 'g')) >= 50 THEN text ELSE role END, chr(10) || chr(10) ORDER BY n) AS text
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id"""


def extraction_report(spark: SparkSession, d: str) -> DataFrame:
    """Orders as extracted records: counts, rates, duplicates and records without an answer, by source."""
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("source"), F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "needs_repair").otherwise("needs_user_review").alias("status"), F.concat_ws("|", "o_custkey", "o_orderpriority").alias("h"), (F.col("o_orderkey") % 4 > 0).alias("answered"))
    return A.extraction_report(B.duplicate_of(rows, "h", "o_orderkey", "o_orderkey"), F.col("status"), F.col("duplicate_of").isNotNull(), F.col("answered"), "source").select("source", "total", "ready", "needs_repair", "repair_debt_rate", "duplicates", "unmatched")


SQL["extraction_report"] = """SELECT source, count(*) AS total, count(*) FILTER (WHERE s = 'F') AS ready, count(*) FILTER (WHERE s = 'O') AS needs_repair, round(count(*) FILTER (WHERE s = 'O')::double / count(*), 4) AS repair_debt_rate, count(*) FILTER (WHERE r > 1) AS duplicates, count(*) FILTER (WHERE k % 4 = 0) AS unmatched
FROM (SELECT o_orderkey AS k, o_orderpriority AS source, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS r FROM orders) GROUP BY source"""


def planned_strata(spark: SparkSession, d: str) -> DataFrame:
    """The stratum of each item: its own part if planned, else the first planned tag."""
    plan = table(spark, d, "part").filter("p_size < 25").select(F.col("p_partkey").cast("string").alias("item"))
    rows = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("k"), F.col("l_partkey").cast("string").alias("own"), F.array(F.col("l_suppkey").cast("string"), (F.col("l_suppkey") + 1).cast("string")).alias("tags")).dropDuplicates(["k"])
    return S.with_stratum(rows, "k", F.col("own"), F.col("tags"), plan, "item").select("k", "stratum")


SQL["planned_strata"] = """WITH p AS (SELECT p_partkey FROM part WHERE p_size < 25) SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS k,
 CASE WHEN l_partkey IN (FROM p) THEN l_partkey WHEN l_suppkey IN (FROM p) THEN l_suppkey WHEN l_suppkey + 1 IN (FROM p) THEN l_suppkey + 1 END::varchar AS stratum FROM lineitem"""

QUERIES = {f.__name__: f for f in (
    scope_filter, quiz_wire, quiz_results, retry_quiz, hybrid_fill, fallback_item, option_explanations, locale_order, usable_layer, audit_items, audit_batches, audit_requests, content_repairs, answer_demotion, stale_verdicts, last_verdict,
    audit_counts, shared_explanation, order_scalars, text_scalars, upper_medians, settled_sizes, merged_summaries, import_gate, chunks_from_questions, scoped_reset, suggestion_decisions, approved_scopes, verdict_corrections, appended_notes,
    soft_deletes, scope_suggestions, definition_suggestions, json_objects, flag_workflow, uncached_pages, overdue_jobs, marked_sources, combined_texts, file_kinds, accepted_answers, chat_replies, verdict_reader, page_texts, extraction_report, rejected_diagnostics, published_versions,
    json_artifacts, partial_patch, scope_normalized, scope_active, scope_described, generated_questions, generation_prompts, planned_strata,
)}
