"""Approximate nearest neighbours: an inverted file whose probed lists are scanned dimension block by dimension block.

Fitting, on a bounded sample of FIT_ROWS distinct vectors: a random rotation (it spreads a vector's length evenly over the dimensions) and k-means centroids.
Indexing: every vector goes to its nearest centroid's list. Lists, and the queries of a list, are dealt by hash into blocks of LIST_BLOCK, so no task holds a hot list.

Searching: a query goes to all blocks of the PROBES nearest lists. In a block, partial squared distances grow by COLUMNS rotated dimensions at a time. After d of D
dimensions, the hypothesis "nearer than the current k-th" is rejected for a candidate whose partial distance, scaled by D / d, is over the k-th distance
by the factor (1 + EPSILON / sqrt(d)) ** 2; such candidates are abandoned. What survives all blocks is measured exactly, on original vectors in double
precision, and the best k of all blocks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qforge.llm.common import drop_path, written

FIT_ROWS = 20_000
LIST_BLOCK = 4096
COLUMNS = 16
EPSILON = 2.1
TARGET = 0.97
SEED = 11


@dataclass
class Index:
    """rotation (D x D), centroids (rotated) and how many lists a query probes."""

    rotation: np.ndarray
    centroids: np.ndarray
    probes: int

    def lists(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each rotated vector, nearest first."""
        d = (self.centroids**2).sum(axis=1) - 2 * (x @ self.centroids.T)
        if n >= d.shape[1]:
            return np.argsort(d, axis=1, kind="stable")
        part = np.argpartition(d, n - 1, axis=1)[:, :n]
        return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, axis=1), axis=1, kind="stable"), axis=1)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors with an id that are not null, not empty, not zero, and hold no null, NaN or infinite component."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def fit(rows: DataFrame, total: int, width: int, fit_rows: int = FIT_ROWS) -> Index:
    """Rotation and centroids from at most ``fit_rows`` vectors drawn by hash of the id. About sqrt(total) lists."""
    draw = F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.lit(1 << 30))
    share = min(1.0, 1.1 * fit_rows / max(total, 1))  # so the sample is bounded; the same rows at every run
    sample = rows.withColumn("draw", draw).filter(F.col("draw") <= int(share * (1 << 30))).toPandas().sort_values(["draw", "vec_id"]).head(fit_rows)
    x = np.array(sample["v"].tolist(), dtype=np.float32).reshape(-1, width)
    rng = np.random.default_rng(SEED)
    rotation = np.linalg.qr(rng.standard_normal((width, width)))[0].astype(np.float32)
    x = x @ rotation
    distinct = np.unique(x, axis=0)  # a frequent vector is one centroid at most
    k = int(max(1, min(len(distinct), round(total**0.5), fit_rows // 16)))
    centres = distinct[rng.choice(len(distinct), size=k, replace=False)] if len(distinct) else np.zeros((1, width), np.float32)
    index = Index(rotation, centres, 1)
    for _ in range(8):
        if not len(x):
            break
        own = index.lists(x, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        index = Index(rotation, centres, 1)
    return Index(rotation, centres, probes_for(index, x, rng))


def probes_for(index: Index, x: np.ndarray, rng: np.random.Generator, queries: int = 256, k: int = 10) -> int:
    """The fewest lists with which TARGET is the mean recall of a query's k nearest among the sample's distinct vectors; in all rows, neighbours are nearer and easier to find."""
    lists = len(index.centroids)
    x = np.unique(x, axis=0)  # copies are found in the first list and would hide what other queries miss
    if len(x) < 2:
        return lists
    own, found = index.lists(x, 1)[:, 0], np.zeros(lists)
    asked = rng.choice(len(x), size=min(queries, len(x)), replace=False)
    for i in asked:
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
        order = np.empty(lists, dtype=np.int64)
        order[index.lists(x[i : i + 1], lists)[0]] = np.arange(lists)
        found += np.bincount(order[own[near]], minlength=lists) / len(near)
    return int(min(np.searchsorted(np.cumsum(found) / len(asked), TARGET - 1e-9) + 1, lists))


def scan_block(ids: np.ndarray, v: np.ndarray, x: np.ndarray, q: np.ndarray, qx: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of a block to one query (places, squared distances), by adaptive scanning of the rotated columns."""
    left = np.arange(len(ids))
    width = x.shape[1]
    if len(left) > 4 * k:
        # a first k-th distance, from the candidates nearest over the first columns
        partial = ((x[left, :COLUMNS] - qx[:COLUMNS]) ** 2).sum(axis=1)
        first = left[np.argpartition(partial, 2 * k)[: 2 * k]]
        bound = np.partition(((v[first] - q) ** 2).sum(axis=1), k - 1)[k - 1] * (1 + 1e-6)
        for d in range(COLUMNS, width + COLUMNS, COLUMNS):
            d = min(d, width)
            keep = partial * (width / d) <= bound * ((1 + EPSILON / d**0.5) ** 2 if d < width else 1 + 1e-4)
            left, partial = left[keep], partial[keep]
            if d == width or len(left) <= k:
                break
            partial += ((x[left, d : d + COLUMNS] - qx[d : d + COLUMNS]) ** 2).sum(axis=1)
        left = np.union1d(left, first)
    d2 = ((v[left] - q) ** 2).sum(axis=1)
    best = np.lexsort((ids[left], d2))[:k]
    return left[best], d2[best]


def search(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``, among all other rows.

    score is the Euclidean distance in double precision; ties go to the smaller id. Vectors that are null, empty or zero, or hold null or non-finite components, and rows
    without an id take no part; nor do vectors of another width than the most common one (of the widest, if tied). With no candidate a query has no rows. Rows that
    repeat an id and vector count once; an id with several vectors stands for the smallest of them (compared component by component). Other columns are ignored.

    Equal vectors are one class, searched for and measured once: of its ids only the k + 1 smallest can be among the nearest of any query, as ties go to the smaller id.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    fine = usable(vectors, id_col, vector_col)
    widths = fine.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if widths is None:
        return spark.createDataFrame([], schema)
    width = widths["width"]
    rows, rows_path = written(fine.filter(F.size("v") == width).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    total = rows.count()
    # a class for each vector: its smallest ids; the limit by rank works before the shuffle too, so copies stay behind
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    classes, classes_path = written(ranked.groupBy("v").agg(F.min("vec_id").alias("cid"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "classes")
    index = fit(classes.select(F.col("cid").alias("vec_id"), "v"), classes.count(), width)

    def assign(n: int, skip: int = 0):
        """Rows repeated for each of their lists from the ``skip``-th to the n-th, with a column ``list``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float32) @ index.rotation
                near = index.lists(x, n)[:, skip:]
                at = pa.array(np.repeat(np.arange(len(near)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns], pa.array(near.ravel().astype(np.int32))], names=[*b.schema.names, "list"])

        return run

    member = "cid long, v array<double>, ids array<long>, list int"
    lists, lists_path = written(classes.select("cid", "v", "ids").mapInArrow(assign(1), member), "lists")
    sizes = lists.groupBy("list").agg(F.ceil(F.count("*") / F.lit(LIST_BLOCK)).cast("int").alias("blocks"))  # a row a list, fit_rows / 16 at most
    # the queries: the classes that hold one; a frequent vector asks once
    asking = rows.filter(F.col("vec_id") % every == 0)
    asking, asking_path = written(asking.join(classes.select("cid", "v"), "v").select("vec_id", "cid"), "asking")
    queries = classes.select("cid", "v").join(asking.select("cid").distinct(), "cid", "left_semi")

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            v, q = (np.array(t["v"].tolist(), dtype=np.float64).reshape(-1, width) for t in (left, right))
            x, qx = (t.astype(np.float32) @ index.rotation for t in (v, q))
            cids, ids = left["cid"].to_numpy(), left["ids"].tolist()
            for i, qid in enumerate(right["cid"].to_numpy()):
                near, d2 = scan_block(cids, v, x, q[i], qx[i], k + 1)
                many = [ids[j] for j in near]
                out.append(pd.DataFrame({"cid": qid, "vec_id": np.concatenate(many), "score": np.repeat(np.sqrt(d2), [len(m) for m in many])}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"cid": [], "vec_id": [], "score": []})

    def best(found: DataFrame) -> DataFrame:
        """The k + 1 nearest ids of each class, its own among them."""
        return found.withColumn("r", F.row_number().over(Window.partitionBy("cid").orderBy("score", "vec_id"))).filter(F.col("r") <= k + 1).select("cid", "vec_id", "score")

    def nearest(queries: DataFrame, n: int, skip: int) -> DataFrame:
        """The nearest of each class in its lists from the ``skip``-th to the n-th; a list's candidates and its queries are both dealt in blocks."""
        probes, path = written(queries.mapInArrow(assign(n, skip), "cid long, v array<double>, list int"), "probes")
        dealt = sizes.join(probes.groupBy("list").agg(F.ceil(F.count("*") / F.lit(LIST_BLOCK)).cast("int").alias("query_blocks")), "list")
        dealt = F.broadcast(dealt)  # a row a list
        block = lambda name, n: F.pmod(F.xxhash64(F.lit(SEED + 1), "cid"), F.col(n)).cast("int").alias(name)
        every_block = lambda name, n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
        held = lists.join(dealt, "list").select("list", block("block", "blocks"), every_block("query_block", "query_blocks"), "cid", "v", "ids")
        asked = probes.join(dealt, "list").select("list", block("query_block", "query_blocks"), every_block("block", "blocks"), "cid", "v")
        group = ("list", "block", "query_block")
        out, out_path = written(best(held.groupBy(*group).cogroup(asked.groupBy(*group)).applyInPandas(scan, "cid long, vec_id long, score double")), "nearest")
        drop_path(spark, path)
        return out, out_path

    most, probed = len(index.centroids), index.probes
    found, path = nearest(queries, probed, 0)
    while probed < most:
        # classes with fewer ids than there are look into further lists, four times as many each round, up to all
        have = found.groupBy("cid").agg(F.count("*").alias("have"))
        short = queries.join(have, "cid", "left").filter(F.coalesce("have", F.lit(0)) < min(k + 1, total)).drop("have")
        short, short_path = written(short, "short")
        if not short.limit(1).count():
            drop_path(spark, short_path)
            break
        n = min(4 * probed, most)
        more, more_path = nearest(short, n, probed)
        both, both_path = written(best(more.union(found)), "nearest")
        drop_path(spark, path, short_path, more_path)
        found, path, probed = both, both_path, n
    # every query takes its class's nearest without itself
    own = found.join(asking.select("cid", F.col("vec_id").alias("query_id")), "cid").filter("vec_id <> query_id")
    own = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")).filter(F.col("rank") <= k)
    out, _ = written(own.select("query_id", "rank", "vec_id", "score"), "neighbours")
    drop_path(spark, rows_path, classes_path, lists_path, asking_path, path)
    return out
