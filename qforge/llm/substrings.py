"""Substring dedup with difference-cover anchors.

A window is ``WINDOW`` consecutive words of one document; a word goes if a window over it also starts in a document with a smaller id.

COVER is a difference cover modulo PERIOD: for any two positions there is a shift below PERIOD that puts both on cover positions. So two equal
windows share an equal run of WINDOW - PERIOD + 1 words (an anchor) that starts at a cover position in both. Three rounds:

0. exact copies: a document whose text has a smaller id elsewhere loses all words (if it has a window), and takes no further part;
1. anchors: hashes of the runs at cover positions only (3 of 7) meet by hash; those found twice go back to where they came from;
2. extension: the windows over such an anchor, and only they, meet by 96-bit hash with the smallest id that has them; what a smaller id
   holds goes back;
3. each document drops its covered words.

Documents are staged in chunks of CHUNK_ROWS rows, bucketed by chunk, so every round reads its texts in place and only packed hashes travel. A chunk is worked on
in slices of about SLICE_BYTES of text, whatever its documents' lengths. What a slice sends is unique within it, so a passage of a third of all
documents arrives once a slice, and never as pairs. Hashes meet in buckets whose number grows with the bytes of all texts.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from qforge.llm.common import drop_path, release_shuffles, scratch, written

WINDOW = 13
PERIOD, COVER = 7, (0, 1, 3)
CHUNK_ROWS = 2048
#: Documents over LONG bytes are in chunks of their own, of fewer rows.
LONG, LONG_ROWS = 1 << 17, 64
SLICE_BYTES = 8 << 20
#: Bytes of text for each bucket in which hashes meet: about 4 million anchors.
BUCKET_BYTES = 56 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)

PACKED = "bucket int, chunk long, a binary, b binary, c binary, d binary"
BACK = "chunk long, kind int, a binary, b binary, c binary"
COPY, ANCHOR, HELD = 0, 1, 2


def split(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "replace").split()


def rolling(h: np.ndarray, n: int, mult: int) -> np.ndarray:
    """Hash of each run of n word hashes that starts at a position; the last n - 1 positions hash with zeros."""
    out, m = np.zeros(len(h), dtype=np.uint64), np.uint64(mult | 1)
    for k in range(n):
        out *= m
        out[: len(h) - k] += h[k:]
    out ^= out >> np.uint64(31)
    out *= MIX
    return out ^ (out >> np.uint64(29))


class Chunk:
    """The documents of one chunk that take part: words, word hashes, and where each document begins."""

    def __init__(self, rows: pd.DataFrame, copies: pd.DataFrame):
        gone = set()
        for r in copies[copies["kind"] == COPY].itertuples():
            gone.update(zip(np.frombuffer(r.a, "<i8").tolist(), np.frombuffer(r.b, "<i8").tolist(), strict=True))
        self.rows = rows
        self.known = rows["doc_id"].notna().to_numpy()
        self.ids = rows["doc_id"].fillna(0).to_numpy(dtype=np.int64)
        self.copy = np.array([k and (i, t) in gone for k, i, t in zip(self.known, self.ids.tolist(), rows["text_hash"].tolist(), strict=True)], dtype=bool)
        self.words = [split(t) for t in rows["text"]]
        self.n = np.array([len(w) for w in self.words], dtype=np.int64)
        self.active = self.known & ~self.copy & (self.n >= WINDOW)
        n = np.where(self.active, self.n, 0)
        self.start = np.concatenate([[0], np.cumsum(n)])
        self.doc = np.repeat(np.arange(len(rows)), n)
        digest = xxhash.xxh64_intdigest
        self.h = np.empty(int(self.start[-1]), dtype=np.uint64)
        for i in np.flatnonzero(self.active):
            self.h[self.start[i] : self.start[i + 1]] = np.fromiter(map(digest, self.words[i]), dtype=np.uint64, count=int(self.n[i]))
        self.pos = np.arange(len(self.h)) - self.start[self.doc]
        self.left = self.n[self.doc] - self.pos  # words from here to the document's end

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the runs at cover positions."""
        at = np.flatnonzero(np.isin(self.pos % PERIOD, COVER) & (self.left > WINDOW - PERIOD))
        return at, rolling(self.h, WINDOW - PERIOD + 1, 0x2545F4914F6CDD1D)[at]

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return rolling(self.h, WINDOW, 0x5851F42D4C957F2D)[at], (rolling(self.h, WINDOW, 0xD6E8FEB86659FD93)[at] >> np.uint64(32)).astype(np.uint32)


def slices(rows: pd.DataFrame, copies: pd.DataFrame) -> Iterator[Chunk]:
    """A chunk's documents in runs of about SLICE_BYTES: memory follows the slice."""
    size = np.cumsum([len(t) if t else 0 for t in rows["text"]])
    for _, at in pd.Series(np.arange(len(rows))).groupby((size - 1) // SLICE_BYTES):
        yield Chunk(rows.iloc[at.to_numpy()], copies)


def _sent(left: pd.DataFrame, right: pd.DataFrame, send: Callable[[Chunk, pd.DataFrame], pd.DataFrame]) -> pd.DataFrame:
    return pd.concat([send(chunk, right) for chunk in slices(left, right)] or [pd.DataFrame(columns=["bucket", "chunk", "a", "b", "c", "d"])], ignore_index=True)


def _packed(chunk: int, buckets: int, key: np.ndarray, *columns: np.ndarray) -> pd.DataFrame:
    """One row for each bucket of the keys' high bits."""
    b = ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    cuts = np.searchsorted(b[order], np.arange(buckets + 1))
    rows = [(i, chunk, *[c[order[s:e]].tobytes() for c in (key, *columns)]) for i, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if e > s]
    return pd.DataFrame([(*r, *[None] * (6 - len(r))) for r in rows], columns=["bucket", "chunk", "a", "b", "c", "d"])


def _back(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["chunk", "kind", "a", "b", "c"])


def _send_anchors(buckets: int):
    def send(chunk: Chunk, right: pd.DataFrame) -> pd.DataFrame:
        at, h = chunk.anchors()
        order = np.lexsort((chunk.doc[at], h))
        h, doc = h[order], chunk.doc[at][order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
        last = np.concatenate([first[1:], [len(h)]]) - 1 if len(h) else first
        return _packed(int(chunk.rows["chunk"].iloc[0]), buckets, h[first], (doc[first] != doc[last]).astype(np.uint8))

    return lambda left, right: _sent(left, right, send)


def _meet_anchors(rows: pd.DataFrame) -> pd.DataFrame:
    parts = [np.frombuffer(a, "<u8") for a in rows["a"]]
    key, within = np.concatenate(parts), np.concatenate([np.frombuffer(b, np.uint8) for b in rows["b"]])
    found, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count > 1
    twice[inverse[within > 0]] = True
    out, at = [], 0
    for chunk, part in zip(rows["chunk"], parts, strict=True):
        mine = part[twice[inverse[at : at + len(part)]]]
        at += len(part)
        if len(mine):
            out.append((chunk, ANCHOR, mine.tobytes(), None, None))
    return _back(out)


def _send_windows(buckets: int):
    def send(chunk: Chunk, right: pd.DataFrame) -> pd.DataFrame:
        at, h = chunk.anchors()
        blobs = [np.frombuffer(a, "<u8") for a in right.loc[right["kind"] == ANCHOR, "a"]]
        shared = np.sort(np.concatenate(blobs)) if blobs else np.empty(0, np.uint64)
        hit = at[shared[np.minimum(np.searchsorted(shared, h), len(shared) - 1)] == h] if len(shared) else at[:0]
        # the windows over an anchor start up to PERIOD - 1 words before it
        mark = np.zeros(len(chunk.h) + 1, dtype=np.int64)
        np.add.at(mark, np.maximum(hit - (PERIOD - 1), chunk.start[chunk.doc[hit]]), 1)
        np.add.at(mark, hit + 1, -1)
        at = np.flatnonzero((np.cumsum(mark)[:-1] > 0) & (chunk.left >= WINDOW))
        w, v = chunk.windows(at)
        ids = chunk.ids[chunk.doc[at]]
        order = np.lexsort((ids, v, w))
        w, v, ids = w[order], v[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (v[1:] != v[:-1])])) if len(w) else np.empty(0, np.int64)
        last = np.concatenate([first[1:], [len(w)]]) - 1 if len(w) else first
        return _packed(int(chunk.rows["chunk"].iloc[0]), buckets, w[first], v[first], ids[first], ids[last])

    return lambda left, right: _sent(left, right, send)


def _meet_windows(rows: pd.DataFrame) -> pd.DataFrame:
    """The smallest id of each window, for the chunks where a larger id has it."""
    parts = [np.frombuffer(a, "<u8") for a in rows["a"]]
    w, v = np.concatenate(parts), np.concatenate([np.frombuffer(b, "<u4") for b in rows["b"]])
    low, high = (np.concatenate([np.frombuffer(x, "<i8") for x in rows[c]]) for c in ("c", "d"))
    order = np.lexsort((low, v, w))
    new = np.concatenate([[True], (w[order][1:] != w[order][:-1]) | (v[order][1:] != v[order][:-1])])
    least = np.empty(len(w), dtype=np.int64)
    least[order] = low[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
    out, at = [], 0
    for chunk, part in zip(rows["chunk"], parts, strict=True):
        t = np.arange(at, at + len(part))
        t = t[least[t] < high[t]]
        at += len(part)
        if len(t):
            out.append((chunk, HELD, w[t].tobytes(), v[t].tobytes(), least[t].tobytes()))
    return _back(out)


def _cut(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    return pd.concat([_cut_slice(chunk, right) for chunk in slices(left, right)] or [pd.DataFrame(columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])], ignore_index=True)


def _cut_slice(chunk: Chunk, right: pd.DataFrame) -> pd.DataFrame:
    held = right[right["kind"] == HELD]
    gone = np.zeros(len(chunk.h), dtype=bool)
    if len(held):
        w, v, ids = (np.concatenate([np.frombuffer(x, t) for x in held[c]]) for c, t in (("a", "<u8"), ("b", "<u4"), ("c", "<i8")))
        order = np.lexsort((v, w))
        w, v, ids = w[order], v[order], ids[order]
        at = np.flatnonzero(chunk.left >= WINDOW)
        mine, check = chunk.windows(at)
        own = chunk.ids[chunk.doc[at]]
        place = np.searchsorted(w, mine)
        cut = np.zeros(len(at), dtype=bool)
        for k in range(int(np.unique(w, return_counts=True)[1].max())):  # two windows with one 64-bit hash stand side by side
            p = np.minimum(place + k, len(w) - 1)
            cut |= (w[p] == mine) & (v[p] == check) & (ids[p] < own)
        mark = np.zeros(len(chunk.h) + 1, dtype=np.int64)
        mark[at[cut]] += 1
        mark[at[cut] + WINDOW] -= 1  # distinct starts, so no place is counted twice
        gone = np.cumsum(mark)[:-1] > 0
    out = []
    for i, words in enumerate(chunk.words):
        kept = words
        if chunk.copy[i] and len(words) >= WINDOW:
            kept = []
        elif chunk.active[i]:
            g = gone[chunk.start[i] : chunk.start[i + 1]]
            if g.any():
                kept = [x for x, drop in zip(words, g.tolist(), strict=True) if not drop]
        out.append((len(words), len(words) - len(kept), hashlib.sha256(text := b" ".join(kept)).hexdigest(), text.decode("utf-8")))
    got = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "kept_text"])
    got.insert(0, "doc_id", chunk.rows["doc_id"].to_numpy())
    return got


def remove_repeats(docs: DataFrame, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_words, n_removed, kept_sha256 and, if wanted, kept_text (kept words joined by one space).

    Null and empty texts have no words. A document without an id is compared with none: it keeps its words and takes none from others. Rows that
    repeat an id take nothing from each other. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    staged = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("at", at)
    # rows of a partition in runs: the partition is in the high 31 bits
    row, long = F.col("at").bitwiseAND((1 << 33) - 1), F.octet_length("text") > LONG
    chunk = F.shiftright("at", 33) * F.lit(1 << 30) + F.when(long, F.lit(1 << 29) + F.floor(row / LONG_ROWS)).otherwise(F.floor(row / CHUNK_ROWS)).cast("long")
    staged = staged.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), chunk.alias("chunk"))
    table, path = f"substrings_{uuid.uuid4().hex}", scratch(spark, "substrings")
    seen = Observation()
    staged.observe(seen, F.sum(F.octet_length("text")).alias("bytes")).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(shuffles, "chunk").saveAsTable(table)
    buckets = max(shuffles, -(-(seen.get["bytes"] or 0) // BUCKET_BYTES))
    try:
        out, paths = _rounds(spark, spark.table(table), buckets)
        out, _ = written(out if with_text else out.drop("kept_text"), "kept")
    finally:
        spark.sql(f"drop table {table}")  # its files are in the shared folder
    drop_path(spark, path, *paths)
    release_shuffles(spark)
    return out


def _rounds(spark: SparkSession, texts: DataFrame, buckets: int) -> tuple[DataFrame, list[str]]:
    """What is kept of the staged documents, and the scratch tables it is made from."""

    # round 0: the rows whose text has a smaller id, packed for each chunk; two hashes stand for a text
    keys = texts.filter("doc_id is not null").select("doc_id", "chunk", "text_hash", F.xxhash64(F.lit(1), "text").alias("other_hash"))
    least = keys.groupBy("text_hash", "other_hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most")
    least, p3 = written(least, "classes")  # settled, so that the rows of a frequent text can be split over the join's tasks
    copies = keys.join(least, ["text_hash", "other_hash"]).filter("doc_id > least").select("chunk", "doc_id", "text_hash")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        return _back([(int(rows["chunk"].iloc[0]), COPY, rows["doc_id"].to_numpy("<i8").tobytes(), rows["text_hash"].to_numpy("<i8").tobytes(), None)])

    copies, p0 = written(copies.groupBy("chunk").applyInPandas(pack, BACK), "copies")
    beside = lambda right, f, schema: texts.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInPandas(f, schema)
    anchors, p1 = written(beside(copies, _send_anchors(buckets), PACKED).groupBy("bucket").applyInPandas(_meet_anchors, BACK), "anchors")
    release_shuffles(spark)
    held, p2 = written(beside(copies.union(anchors), _send_windows(buckets), PACKED).groupBy("bucket").applyInPandas(_meet_windows, BACK), "windows")
    release_shuffles(spark)
    return beside(copies.union(held), _cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"), [p0, p1, p2, p3]
