"""Importance resampling towards a target: hashed n-gram weights, Gumbel noise, and the highest scores found by a quantile sketch and exact counts.

1. Features of a text are its runs of one to three words; each falls into one of BUCKETS buckets. Buckets are counted over all documents and over the target.
2. A bucket's gain is the log of its smoothed share in the target over that in the documents, in thousandths. Gains are one array, by which each document's
   buckets are scored; its score is that weight and noise that depends on its id alone.
3. The cutoff: a quantile sketch gives a bracket of scores; exact counts of what lies above and within it tell whether the cutoff is inside, else the bracket
   is widened. Only the bracket's rows are sorted to locate it. Rows above are sorted for their ranks. Sorts are by ranges over all tasks; ranks
   come from counts of those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qforge.llm.common import drop_path, written

BUCKETS = 10_000
#: Percent of the documents with LEAST words or more that are drawn.
SHARE, LEAST = 5, 20
SEED = 42
#: Relative error of the quantile sketch; the bracket reaches twice that to either side.
ERROR = 0.002
#: Bytes of a text that are taken apart at a time.
SLICE = 1 << 20

_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes.maketrans(bytes(range(0x41, 0x5B)) + _SEPARATORS, bytes(range(0x61, 0x7B)) + b" " * len(_SEPARATORS))


def slices(text: str | None) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in them) of a text, a slice of about SLICE bytes at a time; a null text has none."""
    clean = (text or "").encode("utf-8", "replace").translate(_TABLE)
    at, before = 0, []
    while at < len(clean):
        end = clean.find(b" ", at + SLICE)
        end = len(clean) if end < 0 else end
        words = [*before, *clean[at:end].split()]
        spaced = [b" " + w for w in words]
        # the checksum of a run goes on from that of the run without its last word
        one = list(map(crc32, words))
        two = list(map(crc32, spaced[1:], one))
        three = np.fromiter(map(crc32, spaced[2:], two), dtype=np.uint32, count=max(len(words) - 2, 0))
        n = len(before)
        new = np.concatenate([np.fromiter(one, dtype=np.uint32, count=len(one))[n:], np.fromiter(two, dtype=np.uint32, count=len(two))[max(n - 1, 0) :], three[max(n - 2, 0) :]])
        yield len(words) - n, new % np.uint32(BUCKETS)
        at, before = end, words[-2:]


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held, size = np.zeros(BUCKETS, dtype=np.int64), [np.empty(0, np.uint32)], 0
        for b in batches:
            for t in b["text"]:
                for _, found in slices(t):
                    held.append(found)
                    size += len(found)
                    if size > 1 << 20:
                        total += np.bincount(np.concatenate(held), minlength=BUCKETS)
                        held, size = [np.empty(0, np.uint32)], 0
        total += np.bincount(np.concatenate(held), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": total[at]})

    rows = texts.select(F.col(text_col).alias("text")).mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row a bucket
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket the log of its smoothed share in the target over that in the source, in thousandths, rounded down."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log(((t + 1.0) * s_all) / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id in thousandths, rounded down; a null id is the empty string."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """(doc_id, text_hash, n_words, n_features, weight, score, row), one row per input row, as a written table, and its path; row is a number of its own for each."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, text_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = np.zeros((len(b), 3), dtype=np.int64)
            for i, t in enumerate(b["text"]):
                for n, found in slices(t):
                    got[i] += (n, len(found), gain[found].sum())
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_hash": b["text_hash"], "n_words": got[:, 0], "n_features": got[:, 1], "weight": got[:, 2]})

    # ids go through pandas as strings: a column of integers with nulls would become one of doubles
    own = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    each = own.mapInPandas(run, "doc_id string, text_hash long, n_words long, n_features long, weight long")
    return written(each.select(F.col("doc_id").cast(kind).alias("doc_id"), "text_hash", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), F.monotonically_increasing_id().alias("row")), "scored")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with its places from 1 (``place``) in the order of scores: sorted by ranges over all tasks, places from the counts of those."""
    order = (F.desc("score"), F.asc("doc_id"), F.asc("row"))
    dealt, _ = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), name)
    part = F.shiftright("_m", 33)
    counts = sorted((r["p"], r["n"]) for r in dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row a task
    before = np.cumsum([0, *(n for _, n in counts)])
    offsets = df.sparkSession.createDataFrame([(p, int(o)) for (p, _), o in zip(counts, before, strict=False)], "_p long, _before long")
    return dealt.join(F.broadcast(offsets), part == F.col("_p")).withColumn("place", F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_m", "_p", "_before")


def ranked(table: DataFrame, share: int = SHARE, least: int = LEAST, error: float = ERROR) -> DataFrame:
    """The rows of a scored table with ``rank``: of the N with ``least`` words or more the floor(share * N / 100) highest, from 1; null for the others."""
    may = F.col("n_words") >= least
    pool = table.filter(may)
    n = pool.count()
    k = share * n // 100
    if not k:
        return table.withColumn("rank", F.lit(None).cast("long"))
    while True:
        reach = 2 * error
        if reach < 0.5:
            low, high = (int(x) for x in pool.stat.approxQuantile("score", [max(0.0, 1 - k / n - reach), min(1.0, 1 - k / n + reach)], error))
        else:
            low, high = (int(x) for x in pool.agg(F.min("score"), F.max("score")).first())
        above, inside = pool.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < k <= above + inside:
            break
        error *= 4  # the bracket missed the cutoff
    bracket = numbered(pool.filter(F.col("score").between(low, high)), "bracket").withColumn("rank", F.col("place") + above).withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    top = numbered(pool.filter(F.col("score") > high), "above").withColumn("rank", F.col("place"))
    rest = table.filter(~may | (F.col("score") < low)).withColumn("rank", F.lit(None).cast("long"))
    return top.drop("place").unionByName(bracket.drop("place")).unionByName(rest)


def importance(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """One row per document row: doc_id, text_hash, n_words, n_features, weight, score, rank.

    Ties of score go to the smaller doc_id, a null id first; rows that repeat an id and text get equal scores and ranks of their own. Null and empty texts have no
    features, weight 0 and no rank. An empty table gives no rows, an empty target the gains of smoothing alone. Other columns, whatever their names, are ignored.
    """
    return ranked(scored(docs.select("doc_id", "text"), target.select("text"), seed)[0], share, least).drop("row")


def resampled(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """The drawn documents with all their columns; of rows that repeat an id and text as many as were drawn. Nulls and empty tables as in ``importance``."""
    from pyspark.sql import Window

    table, path = scored(docs.select("doc_id", "text"), target.select("text"), seed)
    drawn, _ = written(ranked(table, share, least).filter("rank is not null").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.count("*").alias("_n")), "drawn")
    drop_path(docs.sparkSession, path)
    own = docs.withColumn("_text_hash", F.xxhash64("text"))
    met = own.join(drawn, own["doc_id"].eqNullSafe(drawn["_id"]) & (own["_text_hash"] == drawn["_hash"]))
    nth = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(F.lit(1)))
    return met.withColumn("_nth", nth).filter("_nth <= _n").select(*docs.columns)
