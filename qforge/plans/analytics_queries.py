"""Analytics and bank queries on the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qforge.functions import text as X
from qforge.operators import analytics as A
from qforge.operators import bank as B
from qforge.operators import sampling as S
from qforge.plans.tables import AUDITED, audited, table
from qforge.storage import settled

SQL: dict[str, str] = {}


def weak_subtopics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "orders").filter("o_orderstatus <> 'P'"), F.col("l_orderkey") == F.col("o_orderkey"))
    return A.weak_subtopics(rows, F.array("p_brand", "p_type"), (F.col("l_returnflag") == "R") & ~(F.col("l_discount") > 0.08))


SQL["weak_subtopics"] = """SELECT tag, count(*) FILTER (WHERE miss) AS miss_count, count(*) AS total_questions,
 CAST(floor(100.0::double * count(*) FILTER (WHERE miss) / count(*) + 0.5) AS bigint) AS miss_rate
FROM (SELECT unnest([p_brand, p_type]) AS tag, (l_returnflag = 'R' AND NOT (l_discount > 0.08)) AS miss
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P') GROUP BY tag"""


def session_score(spark: SparkSession, d: str) -> DataFrame:
    given = F.when(F.col("l_tax") > 0, F.array((F.col("l_partkey") % 3).cast("int"), F.lit(7))).otherwise(None)
    return A.session_scores(table(spark, d, "lineitem"), "l_orderkey", F.array((F.col("l_suppkey") % 3).cast("int"), F.lit(7)), given)


SQL["session_score"] = """SELECT l_orderkey, count(*) AS questions, count(*) FILTER (WHERE ok) AS correct,
 CAST(floor(100.0::double * count(*) FILTER (WHERE ok) / count(*) + 0.5) AS bigint) AS score
FROM (SELECT l_orderkey, l_tax > 0 AND l_suppkey % 3 = l_partkey % 3 AS ok FROM lineitem) GROUP BY l_orderkey"""


def missed_set(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    active = table(spark, d, "part").filter("p_size < 25").select(F.col("p_partkey").alias("scope_id"))
    correct = F.when(F.col("l_tax") > 0, F.col("l_returnflag") != "R")
    scope = F.when(F.col("l_linestatus") == "O", F.col("l_partkey"))
    return A.missed(rows, correct, F.col("l_discount") > 0.08, scope, active).select("l_orderkey", "l_linenumber", "l_partkey")


SQL["missed_set"] = """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_tax > 0 AND l_returnflag = 'R' AND NOT l_discount > 0.08 AND (l_linestatus <> 'O' OR l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25))"""


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("completed_at", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")))


def history_page(spark: SparkSession, d: str) -> DataFrame:
    return A.history_page(_sessions(spark, d), "completed_at", "o_orderkey", page=2, limit=20).select("o_orderkey", "o_custkey", "completed_at")


SQL["history_page"] = """SELECT o_orderkey, o_custkey, o_orderdate AS completed_at FROM orders WHERE o_orderstatus <> 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20"""


def history_total(spark: SparkSession, d: str) -> DataFrame:
    """Completed sessions of each user, so that it is a count of the whole table."""
    return _sessions(spark, d).groupBy("o_custkey").agg(F.count("completed_at").alias("total"))


SQL["history_total"] = """SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus <> 'O') AS total FROM orders GROUP BY o_custkey"""


def owner_session_join(spark: SparkSession, d: str) -> DataFrame:
    owners = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).filter("c_acctbal >= 0")
    return table(spark, d, "orders").join(owners, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "n_name")


SQL["owner_session_join"] = """SELECT o_orderkey, c_custkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0"""

_RATES = "round(coalesce(needs_user_review::double / nullif(total, 0), 0), 4) AS manual_review_rate, round(coalesce(needs_repair::double / nullif(total, 0), 0), 4) AS repair_debt_rate"
_COUNTS = "count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE s = '{s}') AS {s}" for s in A.STATUSES)
_STATUS = "CASE WHEN l.doc_id IS NULL THEN 'unresolved' WHEN toxic = 1 THEN 'needs_user_review' WHEN quality = 0 THEN 'needs_repair' ELSE 'ready' END"


def _status() -> Column:
    return F.when(F.col("quality").isNull(), "unresolved").when(F.col("toxic") == 1, "needs_user_review").when(F.col("quality") == 0, "needs_repair").otherwise("ready")


def import_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.status_summary(audited(spark, d), _status(), "lang")


SQL["import_summary"] = f"SELECT *, {_RATES} FROM (SELECT lang, {_COUNTS} FROM (SELECT lang, {_STATUS} AS s FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY lang)"


def report_by_source(spark: SparkSession, d: str) -> DataFrame:
    return A.status_summary(audited(spark, d), _status(), "source")


SQL["report_by_source"] = f"SELECT *, {_RATES} FROM (SELECT source, {_COUNTS} FROM (SELECT source, {_STATUS} AS s FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY source)"


def usable_by_item(spark: SparkSession, d: str) -> DataFrame:
    return A.usable_by_item(table(spark, d, "lineitem"), "l_partkey", F.col("l_returnflag") != "R")


SQL["usable_by_item"] = "SELECT l_partkey, count(*) FILTER (WHERE l_returnflag <> 'R') AS usable, count(*) AS total FROM lineitem GROUP BY l_partkey"


def session_progress(spark: SparkSession, d: str) -> DataFrame:
    return A.progress(table(spark, d, "lineitem"), "l_orderkey", F.col("l_tax") > 0, F.lit(5))


SQL["session_progress"] = "SELECT l_orderkey, count(*) FILTER (WHERE l_tax > 0) AS current, 5 AS total, count(*) FILTER (WHERE l_tax > 0) >= 5 AS complete, greatest(0, 5 - count(*) FILTER (WHERE l_tax > 0)) AS pending FROM lineitem GROUP BY l_orderkey"


def stats_pivot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("total"), *[F.count_if(F.col("lang") == x).alias(x) for x in ("de", "en", "es", "fr")])


SQL["stats_pivot"] = "SELECT source, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE lang = '{x}') AS {x}" for x in ("de", "en", "es", "fr")) + " FROM documents GROUP BY source"


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


_SP = X.SPACE
_HASH = rf"sha256(regexp_replace(regexp_replace(lower(text), '^[{_SP}]+|[{_SP}]+$', '', 'g'), '[^\w{_SP}]', '', 'g'))"
SQL["content_hash"] = f"SELECT doc_id, {_HASH} AS content_hash FROM documents"


def _options() -> Column:
    return F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).cast("string").alias("id"), x.alias("text")))


def exact_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.exact_hash(F.coalesce("source", F.lit("")), _options()).alias("exact_hash"))


SQL["exact_hash"] = "SELECT doc_id, sha256(coalesce(source, '') || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: i || '.' || x), chr(10))) AS exact_hash FROM documents"


def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.fingerprint(F.col("text"), _options(), F.array("source"), F.col("lang")).alias("fingerprint"))


SQL["fingerprint"] = "SELECT doc_id, sha256('[' || to_json(text)::varchar || ',[' || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: to_json([i::varchar, x])::varchar), ',') || '],' || to_json([source])::varchar || ',' || coalesce(to_json(lang)::varchar, 'null') || ']') AS fingerprint FROM documents"


def _banks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    bench = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return B.united(bench, docs).withColumn("h", X.content_hash(F.col("text")))


_BANKS = f"(SELECT item_id AS id, text, 0 AS bank_no, {_HASH} AS h FROM benchmark UNION ALL SELECT doc_id, text, 1, {_HASH} FROM documents)"


def keep_first(spark: SparkSession, d: str) -> DataFrame:
    return B.keep_first(_banks(spark, d).drop("text"), "h", "bank_no", "id")


SQL["keep_first"] = f"SELECT id, bank_no, h FROM {_BANKS} QUALIFY row_number() OVER (PARTITION BY h ORDER BY bank_no, id) = 1"


def duplicate_of(spark: SparkSession, d: str) -> DataFrame:
    docs = settled(table(spark, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("h")), "hashes")  # the join needs them twice
    return B.duplicate_of(docs, "h", "doc_id", "doc_id").select("doc_id", F.col("duplicate_of").cast("string").alias("duplicate_of"))


SQL["duplicate_of"] = f"SELECT doc_id, nullif(min(doc_id) OVER (PARTITION BY {_HASH}), doc_id)::varchar AS duplicate_of FROM documents"


def _split_bank(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "documents").select("doc_id", "lang", X.content_hash(F.col("text")).alias("h"), "source")
    return rows.filter("source = 'src0'").drop("source"), rows.filter("source <> 'src0'").drop("source")


def conflict_ignore_insert(spark: SparkSession, d: str) -> DataFrame:
    target, incoming = _split_bank(spark, d)
    return B.insert_ignoring_conflicts(target, incoming, "h", "doc_id").select("doc_id", "lang", "h")


SQL["conflict_ignore_insert"] = f"""SELECT doc_id, lang, h FROM (SELECT doc_id, lang, source, {_HASH} AS h FROM documents) WHERE source <> 'src0'
 AND h NOT IN (SELECT {_HASH} FROM documents WHERE source = 'src0' AND text IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1"""


def replace_bank(spark: SparkSession, d: str) -> DataFrame:
    target, incoming = _split_bank(spark, d)
    return B.replace_bank(target.withColumn("active", F.col("lang") == "en"), incoming, "h", "active", "doc_id")[0].select("doc_id", "h", "active")


SQL["replace_bank"] = f"""WITH x AS (SELECT doc_id, lang, source, {_HASH} AS h FROM documents), n AS (SELECT doc_id, h FROM x WHERE source <> 'src0' QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1)
SELECT doc_id, h, true AS active FROM n UNION ALL SELECT doc_id, h, false FROM x WHERE source = 'src0' AND lang <> 'en' AND h NOT IN (SELECT h FROM n)"""


def unattempted(spark: SparkSession, d: str) -> DataFrame:
    return B.unattempted(table(spark, d, "orders"), table(spark, d, "lineitem").filter("l_returnflag = 'R'"), "o_orderkey", "l_orderkey").select("o_orderkey")


SQL["unattempted"] = "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"


def owner_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose customer is archived (a negative balance) go with it."""
    return B.cascade(table(spark, d, "orders"), table(spark, d, "customer").filter("c_acctbal >= 0"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


SQL["owner_cascade"] = "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NULL OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)"


def audit_join(spark: SparkSession, d: str) -> DataFrame:
    """Documents still to audit: without a label of the current version (quality known)."""
    verdicts = table(spark, d, "labels").select("doc_id", F.lit("v1").alias("version"))
    return B.stale(table(spark, d, "documents"), verdicts, "v1", key="doc_id").select("doc_id")


SQL["audit_join"] = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"

_OUTCOME = "CASE WHEN status <> 'ready' THEN 'not_servable' WHEN quality IS NULL THEN 'unaudited' WHEN quality = 0 THEN 'structure' WHEN toxic = 1 AND source <> 'src0' THEN 'key_disputed' WHEN lang = 'es' THEN 'explanation_dropped' ELSE 'clean' END"


def audit_outcome(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("toxic") == 1, "wrong").otherwise("correct")
    outcome = B.audit_outcome(F.col("status"), F.col("quality").isNotNull(), F.lit(True), F.col("quality") == 1, key, F.col("source") == "src0", F.lit(True), F.col("lang") != "es")
    return audited(spark, d).select("doc_id", outcome.alias("outcome"))


SQL["audit_outcome"] = f"SELECT doc_id, {_OUTCOME} AS outcome FROM {AUDITED}"


def audit_stats(spark: SparkSession, d: str) -> DataFrame:
    lang = table(spark, d, "documents").select("doc_id", "lang")
    rows = audit_outcome(spark, d).join(lang, "doc_id")
    return rows.groupBy("lang", "outcome").agg(F.count("*").alias("n"))


SQL["audit_stats"] = f"SELECT lang, outcome, count(*) AS n FROM (SELECT lang, {_OUTCOME} AS outcome FROM {AUDITED}) GROUP BY lang, outcome"


def override_apply(spark: SparkSession, d: str) -> DataFrame:
    patch = table(spark, d, "labels").filter("quality = 1").select("doc_id", F.lit("verified").alias("source"), F.when(F.col("toxic") == 1, F.lit("xx")).alias("lang"))
    return B.patched(table(spark, d, "documents").select("doc_id", "source", "lang"), patch, "doc_id", "source", "lang")


SQL["override_apply"] = "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'verified' ELSE source END AS source, CASE WHEN toxic = 1 THEN 'xx' ELSE lang END AS lang FROM documents d LEFT JOIN (SELECT * FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id"


def question_position(spark: SparkSession, d: str) -> DataFrame:
    return B.numbered(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "position")


SQL["question_position"] = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS position FROM lineitem"

_N = 100


def scope_plan(spark: SparkSession, d: str) -> DataFrame:
    return S.scope_plan(table(spark, d, "documents"), "source", _N)


_PLAN = f"(SELECT source, ({_N} // m + CASE WHEN r <= {_N} % m THEN 1 ELSE 0 END)::bigint AS quota FROM (SELECT source, row_number() OVER (ORDER BY sha256(source || '|plan'), source) AS r, count(*) OVER () AS m FROM (SELECT DISTINCT source FROM documents)))"
SQL["scope_plan"] = f"SELECT * FROM {_PLAN} WHERE quota > 0"


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sampling operator's report: a drawn set of fixed size from all documents."""
    docs = table(spark, d, "documents")
    return S.stratified_sample(docs, "doc_id", "source", S.scope_plan(docs, "source", _N), "source", _N).select("doc_id", "source")


SQL["stratified_sample"] = f"""SELECT doc_id, source FROM (SELECT doc_id, d.source, quota, sha256(doc_id || '|sample') AS h, row_number() OVER (PARTITION BY d.source ORDER BY sha256(doc_id || '|sample'), doc_id) AS r
 FROM documents d LEFT JOIN (SELECT * FROM {_PLAN} WHERE quota > 0) p ON d.source = p.source) ORDER BY CASE WHEN r <= coalesce(quota, 0) THEN 0 WHEN quota IS NULL THEN 1 ELSE 2 END, h, doc_id LIMIT {_N}"""

QUERIES = {f.__name__: f for f in (
    weak_subtopics, session_score, missed_set, history_page, history_total, owner_session_join, import_summary, report_by_source, usable_by_item, session_progress, stats_pivot, content_hash, exact_hash, fingerprint,
    keep_first, duplicate_of, conflict_ignore_insert, replace_bank, unattempted, owner_cascade, audit_join, audit_outcome, audit_stats, override_apply, question_position, scope_plan, stratified_sample,
)}
