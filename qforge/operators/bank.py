"""What a bank does on insert, replace, update, override and audit, as joins over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qforge.functions import text as X


def united(*banks: DataFrame) -> DataFrame:
    """All banks in order of precedence, numbered from 0 in bank_no."""
    out = banks[0].withColumn("bank_no", F.lit(0))
    for i, b in enumerate(banks[1:], 1):
        out = out.unionByName(b.withColumn("bank_no", F.lit(i)))
    return out


def keep_first(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key. A grouped minimum with map-side combine, so a frequent key is no task of its own."""
    columns = rows.columns
    first = rows.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("_row"))
    return first.select(*[F.col("_row")[c].alias(c) for c in columns])


def duplicate_of(rows: DataFrame, key: str, id_col: str, *order: str) -> DataFrame:
    """Adds duplicate_of: the id of the first row of the same key, null on that row itself."""
    first = rows.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*order, F.col(id_col).alias("_id")))["_id"].alias("_first"))
    return rows.join(first, F.col(key) == F.col("_key"), "left").withColumn("duplicate_of", F.when(F.col("_first") != F.col(id_col), F.col("_first"))).drop("_key", "_first")


def insert_ignoring_conflicts(target: DataFrame, incoming: DataFrame, key: str, *order: str) -> DataFrame:
    """The incoming rows that get in: the first of each key that the target lacks."""
    return keep_first(incoming, key, *order).join(target.select(key).distinct(), key, "left_anti")


def replace_bank(target: DataFrame, incoming: DataFrame, key: str, active: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """(rows after, counts): active rows go, then inactive rows with an incoming key; the incoming ones come in, active.

    counts: deleted_active, deleted_colliding, inserted, kept_inactive.
    """
    new = keep_first(incoming, key, *order).withColumn(active, F.lit(True))
    inactive = target.filter(~F.col(active))
    kept = inactive.join(new.select(key), key, "left_anti")
    counts = (
        target.agg(F.count_if(active).alias("deleted_active"), F.count_if(~F.col(active)).alias("_inactive"))
        .join(new.agg(F.count("*").alias("inserted")))
        .join(kept.agg(F.count("*").alias("kept_inactive")))
        .select("deleted_active", (F.col("_inactive") - F.col("kept_inactive")).alias("deleted_colliding"), "inserted", "kept_inactive")
    )
    return kept.unionByName(new), counts


def patched(rows: DataFrame, patch: DataFrame, key: str, *fields: str) -> DataFrame:
    """Fields of the patch that are not null replace those of the row with the key; the patch has a key once. Fields not named are left alone, whatever the patch holds."""
    p = patch.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields])
    return rows.join(p, key, "left").withColumns({f: F.coalesce(f"_new_{f}", f) for f in fields}).drop(*[f"_new_{f}" for f in fields])


def cascade(child: DataFrame, parent: DataFrame, foreign: str, key: str, on_delete: str = "cascade") -> DataFrame:
    """Rows whose parent is gone go, or lose the reference (on_delete = "set null"). A null reference is kept."""
    alive = parent.select(F.col(key).alias("_alive")).distinct()
    joined = child.join(alive, F.col(foreign) == F.col("_alive"), "left")
    if on_delete == "set null":
        return joined.withColumn(foreign, F.col("_alive")).drop("_alive")
    return joined.filter(F.col(foreign).isNull() | F.col("_alive").isNotNull()).drop("_alive")


def excluded(rows: DataFrame, gone: DataFrame, key: str, active: str = "active") -> DataFrame:
    """The rows named stay, inactive."""
    named = gone.select(F.col(key).alias("_gone")).distinct()
    return rows.join(named, rows[key] == named["_gone"], "left").withColumn(active, F.when(F.col("_gone").isNotNull(), False).otherwise(F.col(active))).drop("_gone")


def with_ids(rows: DataFrame, *of: str, name: str = "id") -> DataFrame:
    """Adds an id made from the columns named, so a rerun gives equal ids."""
    return rows.withColumn(name, F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in of]), 256), 1, 32))


#: Fields of a question that a user may change.
EDITABLE = ("question", "options", "labels", "correct", "explanation", "tags", "status")


def soft_deleted(rows: DataFrame, gone: Column, at: Column) -> DataFrame:
    return rows.withColumn("archived_at", F.when(gone, at).otherwise(F.col("archived_at")))


def unattempted(bank: DataFrame, attempts: DataFrame, key: str, attempt_key: str) -> DataFrame:
    """Questions that no attempt has; attempts without a question do not count."""
    seen = attempts.select(F.col(attempt_key).alias("_seen")).filter("_seen is not null").distinct()
    return bank.join(seen, F.col(key) == F.col("_seen"), "left_anti")


def latest_verdicts(verdicts: DataFrame, key: str = "fingerprint", order: str = "seq") -> DataFrame:
    """Of verdicts with one key the last."""
    last = verdicts.groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(order, *[c for c in verdicts.columns if c != order])).alias("_row"))
    return last.select(*[F.col("_row")[c].alias(c) for c in verdicts.columns])


def stale(bank: DataFrame, verdicts: DataFrame, version: str, key: str = "fingerprint", version_col: str = "version") -> DataFrame:
    """Rows without a verdict of the current version: those to audit (again)."""
    current = verdicts.filter(F.col(version_col) == version).select(key).distinct()
    return bank.join(current, key, "left_anti")


def audit_outcome(status: Column, audited: Column, complete: Column, clean: Column, key: Column, verified: Column, explained: Column, matches: Column) -> Column:
    """not_servable, unaudited, structure, key_disputed (unless the answer is verified), explanation_dropped or clean."""
    return (
        F.when(~X.servable(status), "not_servable")
        .when(~audited, "unaudited")
        .when(~complete | ~clean, "structure")
        .when((key != "correct") & ~verified, "key_disputed")
        .when(~F.coalesce(matches, F.lit(True)) & explained, "explanation_dropped")
        .otherwise("clean")
    )


def outcome_counts(rows: DataFrame, outcome: str = "outcome") -> DataFrame:
    c = F.col(outcome)
    return rows.agg(
        F.count_if(~c.isin("not_servable", "unaudited")).alias("audited"),
        F.count_if(c == "unaudited").alias("unaudited"),
        F.count_if(c == "structure").alias("structure"),
        F.count_if(c == "key_disputed").alias("key_disputed"),
        F.count_if(c == "explanation_dropped").alias("explanation_dropped"),
    )


def demoted(status: Column, correct: Column, options: Column) -> Column:
    """A servable record whose answers are missing or point nowhere goes to user review."""
    valid = (F.size(correct) > 0) & F.forall(correct, lambda i: (i >= 0) & (i < F.size(options)))
    return F.when(X.servable(status) & ~F.coalesce(valid, F.lit(False)), "needs_user_review").otherwise(status)


def apply_repairs(bank: DataFrame, repairs: DataFrame, key: str, fingerprint: str, *fields: str) -> tuple[DataFrame, DataFrame]:
    """(bank with the repairs that fit, problems): a repair whose target is missing, changed since (stale) or repaired twice is a problem."""
    r = repairs.select(F.col(key).alias("_k"), F.col(fingerprint).alias("_f"), *[F.col(f).alias(f"_new_{f}") for f in fields])
    twice = r.groupBy("_k").agg(F.count("*").alias("_n"))
    joined = r.join(twice, "_k").join(bank.select(F.col(key).alias("_b"), F.col(fingerprint).alias("_now")), F.col("_k") == F.col("_b"), "left")
    problem = F.when(F.col("_b").isNull(), "missing").when(F.col("_n") > 1, "repeated").when(F.col("_f") != F.col("_now"), "stale")
    judged = joined.withColumn("problem", problem)
    fine = judged.filter("problem is null").select(F.col("_k").alias(key), *[F.col(f"_new_{f}").alias(f) for f in fields])
    return patched(bank, fine, key, *fields), judged.filter("problem is not null").select(F.col("_k").alias(key), "problem").distinct()


def numbered(rows: DataFrame, session: str, *order: str) -> DataFrame:
    """position within a session, from 1, as a stable read order."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(session).orderBy(*order)))


def content_repaired(bank: DataFrame, repairs: DataFrame, fingerprint: Column) -> tuple[DataFrame, DataFrame]:
    """(bank with content repairs, problems). repairs: id, fingerprint, kind, question, options, labels, explanation, note, evidence.

    A repair that is repeated, misses its target, was made for other content (stale), or has not each of four labels and four different texts is a problem, and none that has one is applied.
    What is applied replaces question, options, labels, correct and explanation, renews the hash, clears the flags, and says in the log where it came from.
    """
    r = repairs.select(*[F.col(c).alias(f"r_{c}") for c in ("id", "fingerprint", "kind", "question", "options", "labels", "explanation", "note", "evidence")])
    twice = r.groupBy("r_id").agg(F.count("*").alias("r_n"))
    seen = r.join(twice, "r_id").join(bank.select("id", fingerprint.alias("_now")), F.col("r_id") == F.col("id"), "left")
    ids = F.array_distinct(F.transform("r_options", lambda o: o["id"]))
    texts = F.array_distinct(F.transform("r_options", lambda o: X.collapsed(F.lower(o["text"]))))
    problem = F.when(F.col("r_n") > 1, "repeated").when(F.col("id").isNull(), "missing").when(F.col("r_fingerprint") != F.col("_now"), "stale").when(~(F.size(F.array_intersect(ids, F.array(*map(F.lit, "ABCD")))) == 4) | (F.size("r_options") != 4), "labels").when(F.size(texts) != 4, "same_texts")
    seen = seen.withColumn("problem", problem)
    fine = seen.filter("problem is null").drop("id", "_now", "problem", "r_n")
    joined = bank.join(fine, F.col("id") == F.col("r_id"), "left")
    hit = F.col("r_id").isNotNull()
    options = F.array_sort("r_options")
    at = F.transform("r_labels", lambda x: F.array_position(F.transform(options, lambda o: o["id"]), x).cast("int") - 1)
    note = F.concat("r_note", F.lit(" Input fingerprint: "), "r_fingerprint", F.lit(". Evidence: "), "r_evidence")
    action = F.struct(F.when(F.col("r_kind") == "ai_adaptation", "ai_content_repair").otherwise("source_content_repair").alias("type"), F.lit("applied").alias("status"), note.alias("note"))
    new = {
        "question": F.col("r_question"), "options": options, "labels": F.col("r_labels"), "correct": at, "explanation": F.col("r_explanation"), "content_hash": X.exact_hash(F.col("r_question"), options),
        "status": F.lit("auto_repaired"), "flags": F.array().cast("array<string>"), "actions": F.concat("actions", F.array(action)),
    }
    out = joined.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})
    return out.select(*bank.columns), seen.filter("problem is not null").select(F.col("r_id").alias("id"), "problem").distinct()
