"""Banks merged into one: exact copies, text damage, garbled records, near copies, their survivors and disputes, in this order.

A bank here is rows of id, seq, bank_no, question, options, explanation, status, flags, actions (array of type and status), labels, correct, content_hash, trusted
(its text is no OCR) and failed (an audit judged it broken).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qforge.functions import text as X
from qforge.operators import near_duplicates as N
from qforge.operators import repair_text, vocabulary
from qforge.operators.bank import keep_first
from qforge.storage import settled


def _texts() -> Column:
    """All texts of a record, with where they belong; options by their place, as two may have one id."""
    options = F.transform("options", lambda o, i: F.struct(i.cast("string").alias("field"), o["text"].alias("text")))
    return F.concat(F.array(F.struct(F.lit("question").alias("field"), F.col("question").alias("text")), F.struct(F.lit("explanation").alias("field"), F.coalesce("explanation", F.lit("")).alias("text"))), options)


def _acted(kind: str, status: str, when: Column) -> Column:
    return F.when(when, F.concat("actions", F.array(F.struct(F.lit(kind).alias("type"), F.lit(status).alias("status"))))).otherwise(F.col("actions"))


def normalised(bank: DataFrame) -> DataFrame:
    """Records with their texts repaired by the bank's own vocabulary; ``changed`` says whether a text is another now, and then the log does too."""
    each = settled(bank.select("id", "trusted", F.explode(_texts()).alias("t")).select("id", "trusted", "t.*"), "texts")
    words = settled(vocabulary.vocabulary(each, F.col("text"), F.col("trusted")), "vocabulary")
    mended = repair_text.changes(each.withColumn("k", F.struct("id", "field")), "k", "text", words).select("k.id", "k.field", "text")
    by_field = mended.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "text"))).alias("_new"))
    joined = bank.join(by_field, "id", "left")
    at = lambda f, old: F.coalesce(F.try_element_at("_new", f), old)
    question = at(F.lit("question"), F.col("question"))
    options = F.transform("options", lambda o, i: F.struct(o["id"].alias("id"), at(i.cast("string"), o["text"]).alias("text")))
    said = F.when(F.coalesce("explanation", F.lit("")) != "", at(F.lit("explanation"), F.col("explanation"))).otherwise(F.col("explanation"))
    changed = (question != F.col("question")) | ~said.eqNullSafe(F.col("explanation")) | (options != F.col("options"))
    out = joined.withColumns({"_q": question, "_o": options, "_e": said, "changed": changed})
    return out.withColumn("actions", _acted("normalize_ocr_text", "applied", F.col("changed"))).withColumns({"question": F.col("_q"), "options": F.col("_o"), "explanation": F.col("_e")}).drop("_q", "_o", "_e", "_new")


def _words() -> Column:
    return F.flatten(F.transform(F.concat(F.array("question"), F.transform("options", lambda o: o["text"])), X.letter_words))


def unknown_words(bank: DataFrame, word_list: DataFrame) -> DataFrame:
    """(id, damage): how many words of a record's question and options are not known."""
    each = bank.select("id", F.explode(_words()).alias("w")).select("id", F.lower("w").alias("word"))
    fine = vocabulary.known(each.select("word").distinct(), word_list)
    return each.join(fine, "word", "left_anti").groupBy("id").agg(F.count("*").alias("damage"))


def clustered(bank: DataFrame) -> DataFrame:
    """Adds cluster: the records that are copies of one question."""
    feats = N.features(bank, "id", F.col("question"), F.transform("options", lambda o: o["text"]))
    return bank.join(N.groups(feats).withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).drop("_id")


def best_copies(bank: DataFrame, audited: bool = True) -> DataFrame:
    """Of each cluster the record that is servable and, if ``audited``, not failed, has fewest unknown words and flags, an explanation, and the longest options; ties to the first. Adds removed."""
    sound = X.servable(F.col("status")) & (~F.col("failed") if audited else F.lit(True))
    length = F.aggregate("options", F.lit(0), lambda a, o: a + F.length(o["text"]))
    first = F.when(sound, 0).otherwise(1), F.col("damage"), F.size("flags"), F.when(F.coalesce("explanation", F.lit("")) != "", 0).otherwise(1), -length, F.col("bank_no"), F.col("seq")
    return N.survivors(bank, "cluster", *first)


def audited(bank: DataFrame, audits: DataFrame) -> DataFrame:
    """``failed`` as audits (fingerprint, failed) say of exactly this question, options, key and explanation; records that no audit has seen have not failed. Of several audits of one record one that fails counts."""
    verdicts = audits.groupBy(F.col("fingerprint").alias("_print")).agg(F.bool_or("failed").alias("_failed"))
    own = X.fingerprint(F.col("question"), F.col("options"), F.col("labels"), F.col("explanation"))
    return bank.withColumn("_own", own).join(verdicts, F.col("_own") == F.col("_print"), "left").withColumn("failed", F.coalesce("_failed", F.lit(False))).drop("_own", "_print", "_failed")


def merged(banks: DataFrame, word_list: DataFrame, audits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(bank, counts): the surviving records, and duplicates, normalized, garbled and conflicts as one row.

    Garbled records are found against one copy of each question, whatever audits say of it, and cannot be served; a survivor whose copies disagree on the answer goes to user review. With ``audits``
    a record has failed if the verdict on its normalised text says so, whatever the banks say.
    """
    unique = settled(keep_first(banks, "content_hash", "bank_no", "seq"), "unique")
    repaired = settled(normalised(unique), "repaired")
    clean = settled(clustered(audited(repaired, audits) if audits is not None else repaired), "clean")
    reference = best_copies(clean.withColumn("damage", F.lit(0)), audited=False).withColumn("words", F.concat(_words(), X.letter_words(F.coalesce("explanation", F.lit("")))))
    odd = vocabulary.garbled(clean.withColumn("_t", F.concat_ws("\n", "question", F.array_join(F.transform("options", lambda o: o["text"]), "\n"))), "id", F.col("_t"), reference, F.col("words"), word_list)
    judged = clean.join(odd, "id", "left").join(unknown_words(clean, word_list), "id", "left").withColumn("damage", F.coalesce("damage", F.lit(0)))
    bad = F.col("unknown").isNotNull() & X.servable(F.col("status"))
    judged = judged.withColumn("garbled", bad).withColumns({
        "actions": _acted("garbled_text_check", "failed", bad), "flags": F.when(bad, F.concat("flags", F.array(F.lit("explicit_ocr_layout_pollution")))).otherwise(F.col("flags")), "status": F.when(bad, "needs_repair").otherwise(F.col("status")),
    }).drop("unknown")
    answer = F.array_join(F.transform("correct", lambda i: F.coalesce(F.get("options", i)["text"], F.lit(""))), " ")
    judged = settled(judged.withColumns({"_answer": answer, "_key": X.folded(answer), "_passes": ~F.col("failed")}), "judged")
    best = settled(best_copies(judged), "best")
    disputed = N.conflicts(judged, "cluster", best, "_key", "_answer", "_passes").withColumn("_disputed", F.lit(True))
    out = best.join(disputed, "cluster", "left")
    hit = F.coalesce("_disputed", F.lit(False)) & X.servable(F.col("status"))
    out = out.withColumn("conflict", hit).withColumns({
        "actions": _acted("duplicate_answer_conflict", "failed", hit), "flags": F.when(hit, F.concat("flags", F.array(F.lit("model_audit_key_disputed")))).otherwise(F.col("flags")), "status": F.when(hit, "needs_user_review").otherwise(F.col("status")),
    }).drop("_disputed", "_answer", "_key", "_passes")
    out = settled(out, "merged")
    counts = banks.agg(F.count("*").alias("_all")).join(judged.agg(F.count_if("changed").alias("normalized"), F.count_if("garbled").alias("garbled"))).join(out.agg(F.count("*").alias("_left"), F.count_if("conflict").alias("conflicts")))
    return out, counts.select((F.col("_all") - F.col("_left")).alias("duplicates"), "normalized", "garbled", "conflicts")
