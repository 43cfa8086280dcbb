"""Secret scans with an incremental blob ledger, on DataFrame functions alone.

Texts are content-addressed. The ledger is a table (blob, rule, version, spans) in a folder: a scan looks only at pairs of a
blob and a rule version that the ledger lacks, appends what it found (also that nothing was found), and joins the
ledger's findings back to every path, that is document, that holds the blob. A later scan of a grown corpus or of a new rule
version costs what is new.

Spans come from regular expressions without Python: the pieces between matches (split) and the matches (regexp_extract_all)
alternate, so running sums of their lengths are the starts and ends, in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qforge.llm.common import scratch, written


@dataclass(frozen=True)
class Rule:
    """Leftmost, non-overlapping matches of ``pattern``; those whose ``group`` has fewer than ``least`` characters are dropped.

    ``hint``: a plain string that every match holds, looked for first (in the lower-cased text if ``any_case``).
    """

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    version: int = 1
    base: bool = False
    hint: tuple[str, ...] = ()
    any_case: bool = False


#: In the order in which ties of start are listed. The runs of access and hex are as long as they can be, so the least length is in the pattern.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", least=12, group=2, base=True, hint=("passw", "secret", "token", "apikey", "api_key"), any_case=True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True, hint=("AKIA",)),
    Rule("hex", r"[0-9a-f]{16,}+", base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hint=("PRIVATE KEY-----",)),
    # the first part starts a word and goes on to its end, so that no run of characters is looked at from each "eyJ" in it
    Rule("jwt", r"(?<![A-Za-z0-9_])eyJ[A-Za-z0-9_]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", hint=("eyJ",), version=2),
    Rule("github_token", r"gh[pousr]_[A-Za-z0-9]{36,}", hint=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("url_password", r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/:@]{4,64}@", hint=("://",)),
)

LEDGER = "blob binary, rule string, version int, spans array<struct<start:int,end:int>>"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start,end>> of a rule's matches, ends exclusive, in code points; empty if there is none."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    pieces = F.split(text, rule.pattern, -1)
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    lengths = F.filter(F.arrays_zip(pieces.alias("p"), matches.alias("m"), kept.alias("k")), lambda x: x["m"].isNotNull())
    lengths = F.transform(lengths, lambda x: F.struct(F.length(x["p"]).alias("p"), F.length(x["m"]).alias("m"), F.length(x["k"]).alias("k")))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["p"]
        end = begin + x["m"]
        found = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["k"] >= rule.least, F.concat(a["out"], found)).otherwise(a["out"]).alias("out"))

    def chunk(a: Column, xs: Column) -> Column:
        start = F.struct(a["at"].alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
        return F.get(F.transform(F.array(F.aggregate(xs, start, step)), lambda w: F.struct(w["at"].alias("at"), F.concat(a["out"], F.array(w["out"])).alias("out"))), F.lit(0))

    # an array that grows is copied with each element, so it grows by chunks, as many as a chunk has elements
    size = lambda xs: F.ceil(F.sqrt(F.size(xs))).cast("int")
    chunks = lambda xs: F.transform(F.sequence(F.lit(0), size(xs)), lambda i: F.slice(xs, i * size(xs) + 1, size(xs)))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int>>>").alias("out"))
    walk = lambda xs: F.flatten(F.aggregate(chunks(xs), begin, chunk, lambda a: a["out"]))
    walked = F.get(F.transform(F.array(lengths), walk), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int>>")
    there = text.rlike(rule.pattern)
    if rule.hint:
        seen = F.lower(text) if rule.any_case else text
        hinted = F.lit(False)
        for h in rule.hint:
            hinted = hinted | F.contains(seen, F.lit(h))
        there = hinted & there
    return F.when(there, walked).otherwise(none)


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger in a folder; an empty one is made where there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def scan(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bring the ledger up to date with ``docs`` and return it.

    Only one document of each blob is read for its text: the smallest id that holds it (null ids come first). Blobs all of whose
    rules are in the ledger are not read at all.
    """
    spark = docs.sparkSession
    ledger = open_ledger(spark, ledger_path)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("blob", blob_of(F.col("text")))
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    holders = texts.groupBy("blob").agg(F.min(F.struct("id")).alias("holder"))
    # struct keys compare null-safe, so documents without an id have their blobs scanned as well
    seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("seen"))
    due = holders.join(seen, "blob", "left").select("blob", "holder.id", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<struct<rule:string,version:int>>"))).alias("due")).filter("size(due) > 0")
    # joined by document, not by blob: the rows of a hot blob are spread over all tasks
    # and the blob, so that rows without an id, or with one id, meet their own text only
    due = due.select(F.col("id").alias("holder"), F.col("blob").alias("held"), "due")
    new = texts.join(due, texts["id"].eqNullSafe(due["holder"]) & (texts["blob"] == due["held"])).select("blob", "text", "due")
    found = new.select("blob", *[F.when(F.array_contains("due", F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"))), spans_of(F.col("text"), r)).alias(f"r{i}") for i, r in enumerate(rules)])
    found = found.dropDuplicates(["blob"])  # rows that repeat an id and text
    rows = found.select("blob", F.explode(F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), F.col(f"r{i}").alias("spans")) for i, r in enumerate(rules)])).alias("e")).select("blob", "e.*").filter("spans is not null")
    rows.write.mode("append").option("compression", "zstd").parquet(ledger_path)
    return spark.read.schema(LEDGER).parquet(ledger_path)


def findings(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, from an up-to-date ledger.

    ``spans`` lists kind:start:end of all rules, ordered by start, then by the order of the rules, then by end; base_sha256 is of the base
    kinds only. Null texts are empty. Rows that repeat get equal results; rows without an id are documents like any other. An empty table gives no rows. Other columns,
    whatever their names, are ignored. Without a path the ledger starts empty in the shared folder.
    """
    spark = docs.sparkSession
    ledger = scan(docs, ledger_path or scratch(spark, "ledger"), rules, id_col, text_col)
    at = {r.kind: i for i, r in enumerate(rules)}
    current = F.lit(False)
    order = F.lit(len(rules))
    for r in rules:
        current = current | ((F.col("rule") == r.kind) & (F.col("version") == r.version))
        order = F.when(F.col("rule") == r.kind, at[r.kind]).otherwise(order)
    # versions that are no longer current stay in the ledger; a blob scanned twice (rows that repeat) counts once
    spans = ledger.filter(current & (F.size("spans") > 0)).select("blob", order.alias("o"), "spans").distinct()
    flat = F.array_sort(F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("o").alias("o"), s["end"].alias("end"))))))
    by_blob = spans.groupBy("blob").agg(flat.alias("all"))
    own = docs.select(F.col(id_col).alias("doc_id"), blob_of(F.col(text_col)).alias("blob"))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    listed = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", F.get(kinds, s["o"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("all", lambda s: s["o"] == at[kind])).cast("long").alias(f"n_{kind}")
    base = [at[r.kind] for r in rules if r.base]
    by_blob = by_blob.select("blob", *[count(r.kind) for r in rules if r.base], F.sha2(listed(F.filter("all", lambda s: s["o"].isin(base))), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))
    # settled first, so that the join is of two plain exchanges and the rows of a frequent blob can be split over tasks
    by_blob, _ = written(by_blob, "findings")
    zero = F.lit(0).cast("long")
    return own.join(by_blob, "blob", "left").select("doc_id", *[F.coalesce(f"n_{r.kind}", zero).alias(f"n_{r.kind}") for r in rules if r.base], F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
