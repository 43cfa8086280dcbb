"""Vocabulary, near-duplicate, line and scope queries on the driver's tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qforge.functions import text as X
from qforge.operators import bank as B
from qforge.operators import lines as L
from qforge.operators import near_duplicates as N
from qforge.operators import scope as C
from qforge.operators import vocabulary as V
from qforge.plans.tables import table
from qforge.storage import few, settled

SQL: dict[str, str] = {}


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return V.vocabulary(table(spark, d, "documents"), F.col("text"), F.col("source") == "src0")


SQL["vocabulary"] = r"""SELECT lower(w) AS word, count(*) AS n, bool_or(t) AS trusted, bool_or(w = lower(w)) AS lower_seen
FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w, source = 'src0' AS t FROM documents) GROUP BY lower(w)"""


def doc_frequency(spark: SparkSession, d: str) -> DataFrame:
    return V.document_frequency(table(spark, d, "documents"), F.regexp_extract_all(X.normal_form(F.col("text")), F.lit("[A-Za-z]{3,}"), F.lit(0)))


SQL["doc_frequency"] = "SELECT word, count(*) AS records FROM (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]{3,}'))) AS word FROM documents)) GROUP BY word"


def garble_flag(spark: SparkSession, d: str) -> DataFrame:
    docs, words = table(spark, d, "documents"), F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    known = table(spark, d, "benchmark").select(F.explode(words).alias("word")).distinct()
    return V.garbled(docs, "doc_id", F.col("text"), docs, X.letter_words(X.normal_form(F.col("text"))), known)


def known_words(spark: SparkSession, d: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    docs, bench = (table(spark, d, t).select(F.explode(words).alias("word")).select(F.lower("word").alias("word")).distinct() for t in ("documents", "benchmark"))
    return V.known(docs, bench)


_ENDS = " OR ".join(f"(ends_with(w, '{s}') AND length(w) >= {len(s) + 3} AND (left(w, -{len(s)}) IN (SELECT k FROM known) OR left(w, -{len(s)}) || 'e' IN (SELECT k FROM known)))" for s in V.SUFFIXES)
SQL["known_words"] = f"""WITH known AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS k FROM benchmark), words AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM documents)
SELECT w AS word FROM words WHERE w IN (SELECT k FROM known) OR {_ENDS} OR (ends_with(w, 'ies') AND left(w, -3) || 'y' IN (SELECT k FROM known))"""


SQL["garble_flag"] = f"""WITH known AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS k FROM benchmark),
 t AS (SELECT doc_id, lower(x) AS w, x FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z''’]+')) AS x FROM documents) WHERE regexp_full_match(x, '[A-Za-z]{{3,}}')),
 odd AS (SELECT doc_id, w FROM t WHERE regexp_matches(x, '^[a-z]') AND w NOT IN (SELECT w FROM (SELECT DISTINCT doc_id, w FROM t) GROUP BY w HAVING count(*) > 1)),
 fine AS (SELECT w FROM (SELECT DISTINCT w FROM odd) WHERE w IN (SELECT k FROM known) OR {_ENDS} OR (ends_with(w, 'ies') AND left(w, -3) || 'y' IN (SELECT k FROM known)))
SELECT doc_id, count(*) AS unknown FROM odd WHERE w NOT IN (SELECT w FROM fine) GROUP BY doc_id HAVING count(*) >= 2"""


def option_prefixes(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return each.select("doc_id", X.prefix(F.col("line")).alias("prefix")).filter("prefix <> ''").groupBy("doc_id", "prefix").agg(F.count("*").alias("n"))


SQL["option_prefixes"] = "SELECT doc_id, prefix, count(*) AS n FROM (SELECT doc_id, left(regexp_replace(lower(unnest(string_split(text, chr(10)))), '[^a-z0-9]', '', 'g'), 12) AS prefix FROM documents) WHERE prefix <> '' GROUP BY doc_id, prefix"


def shared_prefix(spark: SparkSession, d: str) -> DataFrame:
    """How many option prefixes each document shares with each benchmark item (as multisets)."""
    def cut(t: str, key: str) -> DataFrame:
        each = table(spark, d, t).select(key, F.explode(F.split("text", r"[\n.]")).alias("o")).select(key, X.prefix(F.col("o"), 8).alias("p"))
        return each.filter("p <> ''").groupBy(key, "p").agg(F.count("*").alias(f"n_{key}"))

    return cut("documents", "doc_id").join(cut("benchmark", "item_id"), "p").groupBy("doc_id", "item_id").agg(F.sum(F.least("n_doc_id", "n_item_id")).alias("shared"))


_CUT = "(SELECT {k}, p, count(*) AS n FROM (SELECT {k}, left(regexp_replace(lower(unnest(string_split_regex(text, '[\\n.]'))), '[^a-z0-9]', '', 'g'), 8) AS p FROM {t}) WHERE p <> '' GROUP BY {k}, p)"
SQL["shared_prefix"] = f"SELECT doc_id, item_id, sum(least(a.n, b.n))::bigint AS shared FROM {_CUT.format(k='doc_id', t='documents')} a JOIN {_CUT.format(k='item_id', t='benchmark')} b ON a.p = b.p GROUP BY doc_id, item_id"


def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Word-set similarity and containment of consecutive turns of a conversation."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", X.word_set(F.col("text")).alias("w"))
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return turns.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"), F.round(X.containment(F.col("w"), F.col("v")), 6).alias("containment"))


SQL["token_overlap"] = """WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS w FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(a.w) = 0 AND len(b.w) = 0 THEN 1.0::double ELSE len(list_intersect(a.w, b.w))::double / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END, 6) AS jaccard,
 round(CASE WHEN least(len(a.w), len(b.w)) < 5 THEN 0.0::double ELSE len(list_intersect(a.w, b.w))::double / least(len(a.w), len(b.w)) END, 6) AS containment FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn"""


def _features(spark: SparkSession, d: str) -> DataFrame:
    return N.features(table(spark, d, "documents"), "doc_id", F.col("text"), F.split("text", "\n"))


def near_dup_clusters(spark: SparkSession, d: str) -> DataFrame:
    return N.groups(_features(spark, d)).select(F.col("id").alias("doc_id"), "cluster")


_FEATS = """feats AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS w, list_filter(list_transform(string_split(text, chr(10)), lambda x: left(regexp_replace(lower(x), '[^a-z0-9]', '', 'g'), 12)), lambda p: p <> '') AS p FROM documents),
 pref AS (SELECT doc_id, p || '#' || row_number() OVER (PARTITION BY doc_id, p) AS p FROM (SELECT doc_id, unnest(p) AS p FROM feats)),
 pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM pref a JOIN pref b ON a.p = b.p AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING count(*) >= 2),
 sims AS (SELECT a, b, shared, len(list_intersect(x.w, y.w))::double AS i, len(x.w) AS n, len(y.w) AS m FROM pairs JOIN feats x ON x.doc_id = a JOIN feats y ON y.doc_id = b),
 edges AS (SELECT a, b FROM (SELECT a, b, shared, CASE WHEN n = 0 AND m = 0 THEN 1 ELSE i / (n + m - i) END AS j, CASE WHEN least(n, m) < 5 THEN 0 ELSE i / least(n, m) END AS c FROM sims) WHERE (shared >= 4 AND j >= 0.6) OR (shared >= 3 AND c >= 0.7) OR j >= 0.8)"""
SQL["near_dup_clusters"] = f"""WITH RECURSIVE {_FEATS}, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
 reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT x, b FROM reach JOIN both_ways ON y = a)
SELECT x AS doc_id, min(y) AS cluster FROM reach GROUP BY x"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").select("doc_id", "n_chars", F.substring_index("text", "\n", 1).alias("answer"))  # joins take no texts along
    docs = own.join(table(spark, d, "labels"), "doc_id", "left").join(settled(near_dup_clusters(spark, d), "clusters"), "doc_id")
    return docs.select("doc_id", "cluster", "quality", "n_chars", "answer", X.folded(F.col("answer")).alias("answer_key"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("passes"))


def cluster_survivor(spark: SparkSession, d: str) -> DataFrame:
    best = N.survivors(_ranked(spark, d), "cluster", F.when(F.col("passes"), 0).otherwise(1), -F.col("n_chars"), F.col("doc_id"))
    return best.select("cluster", "doc_id", "removed")


_REACH = f"WITH RECURSIVE {_FEATS}, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT x, b FROM reach JOIN both_ways ON y = a), cl AS (SELECT x AS doc_id, min(y) AS cluster FROM reach GROUP BY x), ranked AS (SELECT d.*, cluster, coalesce(quality = 1, false) AS passes FROM documents d JOIN cl USING (doc_id) LEFT JOIN labels USING (doc_id))"
SQL["cluster_survivor"] = f"{_REACH} SELECT cluster, doc_id, count(*) OVER (PARTITION BY cluster) - 1 AS removed FROM ranked QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY CASE WHEN passes THEN 0 ELSE 1 END, -n_chars, doc_id) = 1"


def cluster_conflict(spark: SparkSession, d: str) -> DataFrame:
    rows = settled(_ranked(spark, d), "ranked")
    best = N.survivors(rows, "cluster", F.when(F.col("passes"), 0).otherwise(1), -F.col("n_chars"), F.col("doc_id"))
    return N.conflicts(rows, "cluster", best, "answer_key", "answer", "passes")


_WORDS = "list_distinct(regexp_extract_all(lower({t}), '[a-z0-9]{{2,}}'))"
_KEYED = f"""{_REACH}, r AS (SELECT *, string_split(text, chr(10))[1] AS t, regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]', '', 'g') AS k FROM ranked),
 best AS (SELECT cluster, t AS rt, k AS rk, bool_or(passes) OVER (PARTITION BY cluster) AS one_passes FROM r QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY CASE WHEN passes THEN 0 ELSE 1 END, -n_chars, doc_id) = 1),
 c AS (SELECT cluster, k, rk, CASE WHEN length(k) <= length(rk) THEN k ELSE rk END AS lo, CASE WHEN length(k) <= length(rk) THEN rk ELSE k END AS hi, {_WORDS.format(t="t")} AS a, {_WORDS.format(t="rt")} AS b FROM r JOIN best USING (cluster) WHERE passes OR NOT one_passes)"""
SQL["cluster_conflict"] = f"""{_KEYED} SELECT DISTINCT cluster FROM c WHERE NOT (k = '' OR rk = '' OR CASE WHEN length(lo) >= 8 THEN starts_with(hi, lo) ELSE lo = hi END
 OR CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 ELSE len(list_intersect(a, b))::double / (len(a) + len(b) - len(list_intersect(a, b))) END >= 0.6)"""


def merge_bank(spark: SparkSession, d: str) -> DataFrame:
    """Exact duplicates go first, by precedence of bank; then near-duplicates; one row per surviving record. Texts stay where they are read: only their hashes and lengths are grouped."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("doc_id").alias("seq"), "text")
    bench = table(spark, d, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), F.col("item_id").alias("seq"), "text")
    rows = B.united(bench, docs).withColumn("text_hash", F.xxhash64("text"))
    narrow = settled(rows.select("id", "bank_no", "seq", "text_hash", F.length("text").alias("n"), X.content_hash(F.col("text")).alias("h")), "hashed")
    kept = settled(B.keep_first(narrow, "h", "bank_no", "seq").drop("h"), "kept")
    texts = rows.join(few(kept.select("id", "text_hash")), ["id", "text_hash"], "left_semi").select("id", "text")
    if not narrow.groupBy("id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        texts = texts.dropDuplicates(["id", "text"])
    feats = N.features(texts, "id", F.col("text"), F.split("text", "\n"))
    joined = kept.join(N.groups(feats).withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"))
    best = N.survivors(joined.select("cluster", "id", "bank_no", "seq", "n"), "cluster", -F.col("n"), F.col("bank_no"), F.col("seq"))
    return best.select("cluster", "id", "removed")


_HASH = rf"sha256(regexp_replace(regexp_replace(lower(text), '^[{X.SPACE}]+|[{X.SPACE}]+$', '', 'g'), '[^\w{X.SPACE}]', '', 'g'))"
_KEPT = f"kept AS (SELECT CASE bank_no WHEN 0 THEN 'b' ELSE 'd' END || id AS doc_id, id AS seq, bank_no, text FROM (SELECT item_id AS id, text, 0 AS bank_no, {_HASH} AS h FROM benchmark UNION ALL SELECT doc_id, text, 1, {_HASH} FROM documents) QUALIFY row_number() OVER (PARTITION BY h ORDER BY bank_no, id) = 1)"
SQL["merge_bank"] = f"""WITH RECURSIVE {_KEPT}, {_FEATS.replace("FROM documents", "FROM kept")}, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
 reach AS (SELECT doc_id AS x, doc_id AS y FROM kept UNION SELECT x, b FROM reach JOIN both_ways ON y = a), cl AS (SELECT x AS doc_id, min(y) AS cluster FROM reach GROUP BY x)
SELECT cluster, doc_id AS id, count(*) OVER (PARTITION BY cluster) - 1 AS removed FROM kept JOIN cl USING (doc_id) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY -length(text), bank_no, seq) = 1"""


def context_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    return L.filled(rows, "conv_id", "turn", F.when(F.col("role") == "user", F.length("text")), "last_user_length").select("conv_id", "turn", F.col("last_user_length").cast("string").alias("last_user_length"))


SQL["context_fill"] = "SELECT conv_id, turn, (last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::varchar AS last_user_length FROM conversations"


def lookahead(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    return L.ahead(rows, "conv_id", "turn", F.length("text") > 500, 6, "long_ahead").select("conv_id", "turn", "long_ahead")


SQL["lookahead"] = "SELECT conv_id, turn, coalesce(bool_or(length(text) > 500) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), false) AS long_ahead FROM conversations"


def key_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Line items find an answer among the orders of their own key, else of their part's number, else of their supplier's."""
    q = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit(1).alias("number"))
    a = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("context"), F.lit(1).alias("number"), F.col("o_orderpriority").alias("label"))
    return L.keyed(q, a, F.array(*[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey")]), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "label", "matched_context")


SQL["key_fallback"] = """WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'F') SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(a.o_orderpriority, b.o_orderpriority, c.o_orderpriority) AS label,
 coalesce(a.o_orderkey, b.o_orderkey, c.o_orderkey)::varchar AS matched_context FROM lineitem LEFT JOIN f a ON l_orderkey = a.o_orderkey LEFT JOIN f b ON l_partkey = b.o_orderkey LEFT JOIN f c ON l_suppkey = c.o_orderkey"""


def answer_key_join(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    a = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("label"))
    return q.join(a, "l_orderkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", "label")


SQL["answer_key_join"] = "SELECT l_orderkey, l_linenumber, l_partkey, o_orderpriority AS label FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey"


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return L.paragraphs(table(spark, d, "documents"))


_W = f"[{X.SPACE}]"
_PARA = rf"""(SELECT doc_id, line_start, line_end, content FROM (SELECT doc_id, island, min(n) AS line_start, max(n) AS line_end, string_agg(trim(regexp_replace(line, '{_W}+', ' ', 'g')), chr(10) ORDER BY n) AS content
 FROM (SELECT doc_id, n, line, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS island, blank FROM (SELECT doc_id, line, n, NOT regexp_matches(line, '[^{X.SPACE}]') AS blank
 FROM (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS n FROM documents))) WHERE NOT blank GROUP BY doc_id, island)
 WHERE length(content) >= 30 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_start) <= 200)"""
SQL["paragraphs"] = f"SELECT doc_id, line_start, line_end, content FROM {_PARA}"


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    marked = L.lines(table(spark, d, "documents")).filter(F.col("line").rlike("rights reserved|password|token|license"))
    return marked.select("doc_id", F.col("line_no").alias("start"), F.col("line_no").alias("stop"))


_LINES = r"(SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS line_no FROM documents)"
_RANGES = f"(SELECT doc_id AS k, line_no AS a, line_no AS b FROM {_LINES} WHERE regexp_matches(line, 'rights reserved|password|token|license'))"


def range_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return L.outside(L.paragraphs(table(spark, d, "documents")), _ranges(spark, d), "doc_id").select("doc_id", "line_start", "line_end")


SQL["range_exclusion"] = f"SELECT doc_id, line_start, line_end FROM {_PARA} p WHERE NOT EXISTS (SELECT 1 FROM {_RANGES} r WHERE k = doc_id AND line_start <= b AND a <= line_end)"


def near_lines(spark: SparkSession, d: str) -> DataFrame:
    return L.near(L.lines(table(spark, d, "documents")), _ranges(spark, d), "doc_id", 2, 4).select("doc_id", "line_no", "start", F.length("line").alias("line_length"))


SQL["near_lines"] = f"SELECT doc_id, line_no, a AS start, length(line) AS line_length FROM {_LINES} JOIN {_RANGES} ON k = doc_id AND line_no BETWEEN a - 2 AND b + 4"


def chunk_kind(spark: SparkSession, d: str) -> DataFrame:
    kind = X.chunk_kind(F.col("text"))
    return table(spark, d, "documents").select("doc_id", kind.alias("kind"), X.chunk_confidence(kind).alias("confidence"))


_KIND = r"CASE WHEN regexp_matches(lower(text), '(\b(exam|test|level|explanation|explain|language|bilingual|japanese|english|n2|n1|format|style|must|should)\b|answer in|output in)') AND length(text) < 1200 THEN 'definition' WHEN regexp_matches(lower(text), 'syllabus|table of contents|chapter|unit|lesson|objective|outline|subtopic|scope') OR regexp_matches(lower(text), '(^|\n)(\d+\.|[ivx]+\.)\s+') THEN 'structure' ELSE 'context' END"
SQL["chunk_kind"] = f"SELECT doc_id, kind, CASE WHEN kind = 'context' THEN 0.6::double ELSE 0.7::double END AS confidence FROM (SELECT doc_id, {_KIND} AS kind FROM documents)"


def record_status(spark: SparkSession, d: str) -> DataFrame:
    """Flags, confidence and review status of documents read as records: the first line is the prompt, the next four are options, a label points at one of them."""
    parts = F.split("text", "\n")
    options = F.transform(F.slice(parts, 2, 4), lambda x, i: F.struct(F.get(F.array(*map(F.lit, "ABCD")), i).alias("id"), x.alias("text")))
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.get(parts, F.lit(0)).alias("q"), options.alias("o"), F.when(F.col("quality").isNull(), F.array().cast("array<string>")).when(F.col("quality") == 1, F.array(F.lit("A"))).otherwise(F.array(F.lit("D"))).alias("l"), "lang")
    rows = rows.withColumn("c", F.filter(F.transform("l", lambda x: F.array_position(F.transform("o", lambda o: o["id"]), x).cast("int") - 1), lambda i: i >= 0))
    rows = rows.withColumn("flags", X.repair_flags(F.col("q"), F.col("o"), F.col("l"), F.col("c")))
    conf = X.confidence(F.col("q"), F.col("o"), F.col("l"), F.col("c"), F.col("lang"), F.col("flags"))
    return rows.withColumn("confidence", conf).select("doc_id", F.array_join("flags", ",").alias("flags"), "confidence", X.review_status(F.col("o"), F.col("flags"), F.lit(False), F.col("confidence")).alias("status"))


_REC = r"""WITH r AS (SELECT d.doc_id, lang, string_split(text, chr(10))[1] AS q, string_split(text, chr(10))[2:5] AS o, CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 THEN 1 ELSE 4 END AS l FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id),
 f AS (SELECT *, coalesce(l <= len(o), false) AS hit, list_filter([CASE WHEN len(o) <> 4 THEN 'missing_or_extra_options' END, CASE WHEN regexp_matches(q, '\s+\d{1,3}[.)]\s+[A-Z][^.?!]{15,}') THEN 'merged_numbered_question' END, CASE WHEN regexp_matches(q, '\bA[.)]\s+[^B]+B[.)]\s+[^C]+C[.)]') THEN 'prompt_contains_options' END,
 CASE WHEN len(list_filter(o, lambda t: length(t) > 420 OR regexp_matches(t, '\s+\d{1,3}[.)]\s+[A-Z]') OR regexp_matches(t, '[.!?]\s+[A-D][.)]\s+'))) > 0 THEN 'option_swallowed_text' END, CASE WHEN length(q) < 12 THEN 'too_short_prompt' END,
 CASE WHEN regexp_matches(q || ' ' || array_to_string(o, ' '), '(?i)would The owner|B\. Riparian rights are water rights|\[PDF_(PAGE|SOURCE)\b|fi(?:\s+fi){2,}|fl(?:\s+fi|\s+fl){2,}') THEN 'explicit_ocr_layout_pollution' END,
 CASE WHEN l IS NULL THEN 'no_answer_label' END, CASE WHEN l > len(o) THEN 'answer_label_not_in_options' END], lambda x: x IS NOT NULL) AS fl FROM r),
 g AS (SELECT *, len(list_filter(fl, lambda x: x NOT IN ('no_answer_label', 'answer_label_not_in_options'))) > 0 AS bad FROM f),
 h AS (SELECT *, 45 + CASE WHEN length(q) > 20 THEN 15 ELSE 0 END + CASE WHEN len(o) = 4 THEN 20 ELSE 0 END + CASE WHEN hit THEN 15 ELSE 0 END + CASE WHEN coalesce(lang, '') <> '' THEN 5 ELSE 0 END AS pts FROM g),
 k AS (SELECT *, least(CASE WHEN NOT hit OR len(o) <> 4 OR bad THEN least(pts, 75) ELSE pts END, 100) / 100.0::double AS confidence FROM h)
SELECT doc_id, array_to_string(fl, ',') AS flags, confidence, CASE WHEN len(o) <> 4 OR bad OR l > len(o) THEN 'needs_repair' WHEN l IS NULL THEN 'needs_user_review' WHEN confidence >= 0.75 THEN 'ready' ELSE 'needs_user_review' END AS status FROM k"""
SQL["record_status"] = _REC


def first_scope_match(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "part").select("p_type").distinct().withColumn("title", F.substring("p_type", 1, 3))
    return C.first_match(table(spark, d, "documents"), "doc_id", F.col("text"), items, "p_type", "title", "p_type").select("doc_id", "matched")


SQL["first_scope_match"] = "SELECT doc_id, (SELECT min(p_type) FROM (SELECT DISTINCT p_type FROM part) WHERE contains(lower(text), lower(left(p_type, 3)))) AS matched FROM documents"


def scope_derive(spark: SparkSession, d: str) -> DataFrame:
    out = C.derived(table(spark, d, "part"), F.col("p_brand"), F.col("p_size"), F.col("p_type"), "p_partkey")
    return out.select("chapter", "chapter_no", F.array_join("items", "|").alias("items"))


SQL["scope_derive"] = "SELECT chapter, min(no) AS chapter_no, string_agg(item, '|' ORDER BY seq, item) AS items FROM (SELECT p_brand AS chapter, p_type AS item, min(p_size) AS no, min(p_partkey) AS seq FROM part GROUP BY 1, 2) GROUP BY chapter"


def scope_merge(spark: SparkSession, d: str) -> DataFrame:
    current = table(spark, d, "part").select(F.col("p_name").alias("title"))
    return C.merged(current.filter("title like '%r%'"), current.select(F.upper("title").alias("title")), "title")


SQL["scope_merge"] = "SELECT coalesce(c, s) AS title, CASE WHEN c IS NOT NULL THEN 'current' ELSE 'suggested' END AS origin FROM (SELECT lower(trim(p_name)) AS k, min(p_name) AS c FROM part WHERE p_name LIKE '%r%' GROUP BY 1) FULL JOIN (SELECT lower(trim(upper(p_name))) AS k2, min(upper(p_name)) AS s FROM part GROUP BY 1) ON k = k2"


def scope_freeze(spark: SparkSession, d: str) -> DataFrame:
    part, used = table(spark, d, "part"), table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return C.frozen(part, part.filter("p_size < 25"), used, "p_partkey")


SQL["scope_freeze"] = "SELECT p_partkey, p_size >= 25 AS frozen FROM part WHERE p_size < 25 OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')"


def suggest_context(spark: SparkSession, d: str) -> DataFrame:
    return C.context_text(table(spark, d, "documents"), "source", "doc_id", "text")


SQL["suggest_context"] = "SELECT source, left(string_agg(text, chr(10) || chr(10) ORDER BY doc_id), 5000) AS context FROM documents GROUP BY source"

QUERIES = {f.__name__: f for f in (
    vocabulary, doc_frequency, garble_flag, known_words, option_prefixes, shared_prefix, token_overlap, near_dup_clusters, cluster_survivor, cluster_conflict, merge_bank, context_fill, lookahead, key_fallback, answer_key_join,
    paragraphs, range_exclusion, near_lines, chunk_kind, record_status, first_scope_match, scope_derive, scope_merge, scope_freeze, suggest_context,
)}
