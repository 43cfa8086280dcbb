"""Benchmark decontamination: a prefix-filtered set join on DataFrame functions alone.

An item has the windows of ``window`` consecutive words (one window, the whole item, if it has fewer). A window can only occur
in a document that holds its rarest word. So:

1. count, over all documents, the words that items use; order the words of each window by that rarity;
2. the rarest position of each window is its prefix; windows that share it share one prefix row (item, position, word);
3. equi-join the document words with the prefixes. Length and position bounds cut the aligned region of ``window`` words either way
   to what both sides have;
4. verify: compare the aligned region word by word; the run of equal words around the prefix holds a window occurrence if and only if
   it is as long as a window, and its words are then hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qforge.llm.common import written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of the prefix table up to which it is broadcast; beyond that the places of words that any prefix has are found first, and only the
#: regions around those are shuffled.
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text: runs of ASCII letters, digits and non-ASCII characters. Null or none: an empty array."""
    clean = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(clean, SEPARATORS), "")


def small(df: DataFrame, measure: Column) -> bool:
    """Whether the measured bytes of a table are within the bound for a broadcast."""
    return (df.agg(F.sum(measure).alias("b")).first()["b"] or 0) <= BROADCAST_BYTES


def hinted(df: DataFrame, broadcast: bool) -> DataFrame:
    return F.broadcast(df) if broadcast else df


def prefixes(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """(word, item_id, pos, len, words): the positions of items to probe, with the item's words around them."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).filter("size(words) > 0").distinct()
    at = items.select("item_id", "words", F.posexplode("words").alias("pos", "word"))
    vocabulary = at.select("word").distinct()
    fits = small(vocabulary, F.octet_length("word") + 16)
    counts = docs.select(F.explode(words(F.col("text"))).alias("word")).join(hinted(vocabulary, fits), "word", "left_semi" if not fits else "inner").groupBy("word").agg(F.count("*").alias("n"))
    rare = at.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # the rarest position of the window that starts here; ties to the first
    ahead = Window.partitionBy("item_id", "words").orderBy("pos").rowsBetween(0, window - 1)
    first = rare.withColumn("best", F.min(F.struct("n", "pos", "word")).over(ahead)).filter(F.col("pos") <= F.greatest(F.size("words") - F.lit(window), F.lit(0)))
    return first.filter("best.n > 0").select("item_id", "words", F.col("best.pos").alias("at"), F.col("best.word").alias("word")).distinct()


def _run(same: Column) -> Column:
    """Length of the run of true at the start of a boolean array."""
    stop = F.array_position(same, False)
    return F.when(stop > 0, stop - 1).otherwise(F.size(same).cast("long"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, text_hash, runs, items) of documents that windows occur in: the runs of words they cover (start, stop), and the items."""
    probe, _ = written(prefixes(docs, benchmark, window), "prefixes")
    fits = small(probe, F.aggregate("words", F.lit(64).cast("long"), lambda a, w: a + F.octet_length(w) + 8))
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("doc_words"))
    if fits:
        found = own.select("doc_id", "text_hash", "doc_words", F.posexplode_outer("doc_words").alias("pos", "word"))
    else:
        # where a document has a word that any prefix has: narrow rows, and a frequent word's rows can be split over the join's tasks
        at = own.select("doc_id", "text_hash", F.posexplode(F.transform("doc_words", lambda w: F.xxhash64(w))).alias("pos", "h"))
        at = at.join(probe.select(F.xxhash64("word").alias("h")).distinct(), "h", "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("places"))
        at = written(at, "places")[0].select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "places")
        own = own.join(at, own["doc_id"].eqNullSafe(at["_id"]) & (own["text_hash"] == at["_hash"]))
        found = own.select("doc_id", "text_hash", "doc_words", F.explode("places").alias("pos")).withColumn("word", F.get("doc_words", F.col("pos")))
    # only the region around a word that met a prefix is kept of its document
    reach = F.lit(window - 1)
    shift = F.greatest(F.col("pos") - reach, F.lit(0))
    region = F.slice("doc_words", shift + 1, F.lit(2 * window - 1)).alias("doc_words")
    if fits:
        met = found.join(F.broadcast(probe), "word").select("doc_id", "text_hash", "item_id", "at", "words", F.col("pos"), shift.alias("shift"), region)
    else:
        met = found.select("doc_id", "text_hash", "word", "pos", shift.alias("shift"), region).join(probe, "word")
    pos, at = F.col("pos") - F.col("shift"), F.col("at")
    left = F.least(pos, at, reach)
    right = F.least(F.size("doc_words") - 1 - pos, F.size("words") - 1 - at, reach)
    same = lambda a, b: a == b
    before = F.zip_with(F.reverse(F.slice("doc_words", pos - left + 1, left)), F.reverse(F.slice("words", at - left + 1, left)), same)
    after = F.zip_with(F.slice("doc_words", pos + 2, right), F.slice("words", at + 2, right), same)
    runs = met.select("doc_id", "text_hash", "item_id", "pos", _run(before).alias("l"), _run(after).alias("r"), F.least(F.size("words"), F.lit(window)).alias("need"))
    # the test stands in the aggregate: as a filter it would be pushed into the join, which would then carry whole documents for each word
    enough = F.col("l") + F.col("r") + 1 >= F.col("need")
    run = F.when(enough, F.struct((F.col("pos") - F.col("l")).cast("long").alias("start"), (F.col("pos") + F.col("r") + 1).cast("long").alias("stop")))
    out = runs.groupBy("doc_id", "text_hash").agg(F.collect_set(run).alias("runs"), F.collect_set(F.when(enough, F.col("item_id").cast("string"))).alias("items"))
    return out.filter("size(runs) > 0")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Contaminated: some word is hit and ``share`` * n_hit >= n_words. Null and empty texts have no words; items without
    words have no window; equal items count each; rows that repeat get equal results; an empty benchmark contaminates nothing.
    Other columns, whatever their names, are ignored.
    """
    return _judged(docs, benchmark, window, share).drop("text_hash")


def _judged(docs: DataFrame, benchmark: DataFrame, window: int, share: int) -> DataFrame:
    docs = docs.select("doc_id", "text")
    found = hits(docs, benchmark.select("item_id", "text"), window)
    # words covered by the union of the runs: in order of start, each adds what lies beyond the furthest stop so far
    covered = F.aggregate(
        F.array_sort("runs"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["stop"] - F.greatest(x["start"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["stop"]).alias("end")),
        lambda a: a["n"],
    )
    by_doc = found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join(F.array_sort("items"), ",").alias("ids"))
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = own.join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id",
        "text_hash",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (F.lit(share) * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """The documents, with all their columns, that are not contaminated.

    Null and empty texts have no words and stay. Rows that repeat are judged alike. An empty benchmark leaves all documents.
    """
    bad, _ = written(_judged(docs, benchmark, window, share).filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "contaminated")
    own = docs.withColumn("_text_hash", F.xxhash64("text"))
    bad = hinted(bad, small(bad, F.lit(64)))
    return own.join(bad, own["doc_id"].eqNullSafe(bad["_id"]) & (own["_text_hash"] == bad["_hash"]), "left_anti").drop("_text_hash")
