"""SimHash near-duplicate groups by the generalised pigeonhole principle.

1. A 64-bit fingerprint for each text, from the XXH64 (seed 42) of its word shingles.
2. Equal fingerprints collapse first (partial aggregation), so copies never meet as pairs.
3. The 64 bits are cut into partitions that keep correlated bits together. A dynamic program gives each partition a
   threshold T_i >= -1 with sum(T_i + 1) = radius + 1, the cheapest by the candidates that the observed patterns of its bits make. Two fingerprints at
   distance <= radius differ in at most T_i bits of some partition i, so probing each partition with its own
   threshold misses no pair.
4. Probing with threshold t masks t bits of the partition in every way; fingerprints that agree on the rest meet in
   a bucket. A bucket over BLOCK members is dealt out to pairs of blocks, so that no task holds a whole hot bucket.
   Inside a bucket exact distances are verified, and only a spanning forest of the links leaves it.
5. Connected components of the links, with alternating star contraction.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qforge.llm.common import drop_path, written

BITS = 64
#: Bits whose patterns are counted together.
PROJECTED = 16
#: Members of a bucket that one task verifies against each other.
BLOCK = 2048


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of one text: ASCII lower case, words between ASCII white space, shingles with repeats; no words: 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    rows = zip(*(words[i : i + n] for i in range(shingle))) if len(words) >= shingle else [words]
    h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(r), 42) for r in rows), dtype=np.uint64, count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for part in np.array_split(h, max(1, n // 65536)):  # a long text is counted in pieces
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp): one row per input row; a null or blank text has fingerprint 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b["text"]], dtype=np.uint64)
            yield b[["doc_id", "text_hash"]].assign(fp=fp.view(np.int64))

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return own.mapInPandas(run, "doc_id long, text_hash long, fp long")


# -- partitions and thresholds --------------------------------------------------------------------------------------


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each pair of bits in how many both are set: 64 x 64 sums over all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, gram = 0, np.zeros((BITS, BITS))
        for b in batches:
            for part in np.array_split(b["fp"].to_numpy(dtype=np.int64), max(1, len(b) // 65536)):
                bits = np.unpackbits(part.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
                gram += bits.T @ bits
                n += len(part)
        if n:
            at = np.arange(BITS)
            yield pd.DataFrame({"i": np.append(np.repeat(at, BITS), -1), "j": np.append(np.tile(at, BITS), -1), "n": np.append(gram.ravel(), n).astype(np.int64)})

    rows = fps.select("fp").mapInPandas(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 4097 rows at most
    gram, n = np.zeros((BITS, BITS)), 0
    for i, j, v in rows:
        if i < 0:
            n = int(v)
        else:
            gram[i, j] = v
    return n, gram


def group_bits(n: int, gram: np.ndarray, parts: int) -> list[list[int]]:
    """Cut the bits into ``parts`` groups of near-equal width, greedily adding the bit most correlated with the group; bits in the order in which they were added."""
    p = np.diag(gram) / max(n, 1)
    cov = gram / max(n, 1) - np.outer(p, p)
    dev = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    corr = np.abs(cov / dev)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        width = (BITS - sum(map(len, groups))) // (parts - k)
        seed = max(left, key=lambda b: (corr[b, sorted(left)].sum(), -b))
        group = [seed]
        left.remove(seed)
        while len(group) < width:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(group)
    return groups


def blocks_of(group: list[int]) -> list[list[int]]:
    """A group's bits in runs of at most PROJECTED bits: the patterns of a run are counted."""
    n = -(-len(group) // PROJECTED)
    return [group[len(group) * i // n : len(group) * (i + 1) // n] for i in range(n)]


def projections(fps: DataFrame, blocks: list[list[int]]) -> list[np.ndarray]:
    """For each block of bits how many of all fingerprints have each of its patterns: 2 ** width counts."""
    offsets = np.cumsum([0, *(1 << len(b) for b in blocks)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(offsets[-1], dtype=np.int64)
        for b in batches:
            for part in np.array_split(b["fp"].to_numpy(dtype=np.int64).view(np.uint64), max(1, len(b) // 65536)):
                for at, bits in zip(offsets, blocks, strict=False):
                    pattern = np.zeros(len(part), dtype=np.int64)
                    for k, bit in enumerate(bits):
                        pattern |= ((part >> np.uint64(BITS - 1 - bit)) & np.uint64(1)).astype(np.int64) << k
                    total[at : at + (1 << len(bits))] += np.bincount(pattern, minlength=1 << len(bits))
        seen = np.flatnonzero(total)
        if len(seen):
            yield pd.DataFrame({"at": seen, "n": total[seen]})

    rows = fps.select("fp").mapInPandas(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # as many rows as there are patterns at most
    total = np.zeros(offsets[-1], dtype=np.int64)
    total[rows["at"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return np.split(total, offsets[1:-1])


def distances(counts: np.ndarray) -> np.ndarray:
    """The chance that two different fingerprints differ in d bits of a block, d = 0..width, from how often each of its patterns occurs.

    The pairs whose patterns differ by x are the counts' correlation with themselves under XOR, which a Walsh-Hadamard transform gives for all x at once.
    """
    n, width = int(counts.sum()), len(counts).bit_length() - 1
    if n < 2:
        return np.eye(1, width + 1)[0]

    def transform(v: np.ndarray) -> np.ndarray:
        for k in range(width):
            v = v.reshape(-1, 2, 1 << k)
            v = np.stack([v[:, 0] + v[:, 1], v[:, 0] - v[:, 1]], axis=1).reshape(-1)
        return v

    pairs = transform(transform(counts.astype(np.float64)) ** 2) / len(counts)
    pairs[0] -= n  # a fingerprint with itself
    by_bits = np.bincount(np.bitwise_count(np.arange(len(counts), dtype=np.uint64)).astype(np.int64), weights=np.maximum(pairs, 0), minlength=width + 1)
    return by_bits / (n * (n - 1.0))


def candidates_within(n: int, counts: list[np.ndarray], most: int) -> list[float]:
    """Estimated pairs that differ in at most t bits of a group, t = 0..most, from the observed patterns of its blocks.

    Exact for a group of one block; the blocks of a wider group are taken as independent of each other.
    """
    dist = np.ones(1)
    for c in counts:
        dist = np.convolve(dist, distances(c))
    return [n * max(n - 1, 0) / 2 * float(dist[: t + 1].sum()) for t in range(most + 1)]


def allocate(n: int, pairs: list[list[float]], widths: list[int], radius: int) -> tuple[float, list[int]]:
    """Thresholds by dynamic programming: the least cost with sum(T_i + 1) = radius + 1; T_i = -1 leaves a partition out.

    The cost of a partition is the rows that probing it makes plus the candidate pairs to verify.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for found, width in zip(pairs, widths, strict=True):
        # a probe is written, sorted and read; verifying a pair is two machine words and a popcount
        cost = [0.0] + [n * comb(width, min(t, width)) + 0.01 * found[t] * comb(width, min(t, width)) for t in range(radius + 1)]
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for k in range(radius + 2 - used):
                new = (c + cost[k], [*chosen, k - 1])
                if used + k not in step or new < step[used + k]:
                    step[used + k] = new
        best = step
    return best[radius + 1]


def plan_partitions(n: int, gram: np.ndarray, counted: Callable[[list[list[int]]], list[np.ndarray]], radius: int = 3) -> list[tuple[list[int], int]]:
    """The (bits, threshold) of each partition to probe, the cheapest over several numbers of partitions; ``counted`` gives the patterns' counts of blocks of bits."""
    cuts = [group_bits(n, gram, parts) for parts in range(2, radius + 4)]
    counts = iter(counted([b for groups in cuts for g in groups for b in blocks_of(g)]))
    plans = []
    for groups in cuts:
        pairs = [candidates_within(n, [next(counts) for _ in blocks_of(g)], radius) for g in groups]
        cost, t = allocate(n, pairs, [len(g) for g in groups], radius)
        plans.append((cost, len(groups), [(g, e) for g, e in zip(groups, t, strict=True) if e >= 0]))
    return min(plans)[2]


def probe_masks(plan: list[tuple[list[int], int]]) -> list[int]:
    """For each probe the 64-bit mask of the bits that have to agree (bit 0 is the highest, as in the fingerprint)."""
    out = []
    for bits, t in plan:
        for skip in itertools.combinations(bits, min(t, len(bits))):
            mask = sum(1 << (BITS - 1 - b) for b in bits if b not in skip)
            out.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return out


# -- links ----------------------------------------------------------------------------------------------------------


def spanning_links(fp: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect everything that distances of at most ``radius`` connect, one fewer than a group's members.

    Each fingerprint is compared with those not reached yet, so a dense bucket shrinks at once.
    """
    left, src, dst = np.arange(len(fp)), [], []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            near = np.bitwise_count(fp[left] ^ fp[x]) <= radius
            if near.any():
                found = left[near]
                src.append(np.full(len(found), node[x]))
                dst.append(node[found])
                left = left[~near]
                stack.extend(found.tolist())
    return (np.concatenate(src), np.concatenate(dst)) if src else (np.empty(0, np.int64), np.empty(0, np.int64))


def _contract(src: np.ndarray, dst: np.ndarray) -> pd.DataFrame:
    """Union-find over the links of one batch: each node linked to the smallest of its group."""
    ids, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
    parent = np.arange(len(ids))
    for a, b in zip(flat[: len(src)].tolist(), flat[len(src) :].tolist(), strict=True):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)
    while (parent[parent] != parent).any():
        parent = parent[parent]
    own = parent != np.arange(len(ids))
    return pd.DataFrame({"src": ids[own], "dst": ids[parent[own]]})


def links(fps: DataFrame, masks: list[int], radius: int = 3) -> DataFrame:
    """(src, dst) of linked nodes from (node, fp), src > dst; a spanning forest of each bucket, all buckets whole."""
    # one long key for each probe: the agreeing bits and the probe's number, hashed; a clash of two keys costs time only
    keyed = fps.select("node", "fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("probe", "mask")).select("node", "fp", F.xxhash64("probe", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    held = keyed.join(sizes, "bucket")
    # a bucket of b blocks: a member of block i goes to the pairs {i, 0}..{i, b-1}
    blocks = F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = held.withColumn("blocks", blocks).withColumn("mine", mine).select("node", "fp", "bucket", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("node", "fp", "bucket", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches in order of bucket: a bucket that goes on in the next batch is carried over; it has 2 * BLOCK rows or so."""
        carry = None

        def flush(b: pd.DataFrame) -> pd.DataFrame:
            key = b[["bucket", "lo", "hi"]].to_numpy(dtype=np.int64)
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            fp, node = b["fp"].to_numpy(dtype=np.int64).view(np.uint64), b["node"].to_numpy(dtype=np.int64)
            src, dst = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(b)]])
            two = ends - starts == 2  # most buckets hold one chance pair
            if two.any():
                i = starts[two]
                near = np.bitwise_count(fp[i] ^ fp[i + 1]) <= radius
                src.append(node[i][near])
                dst.append(node[i + 1][near])
            for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
                x, y = spanning_links(fp[s:e], node[s:e], radius)
                src.append(x)
                dst.append(y)
            return _contract(np.concatenate(src), np.concatenate(dst))

        for b in batches:
            b = b if carry is None else pd.concat([carry, b], ignore_index=True)
            last = (b[["bucket", "lo", "hi"]] == b[["bucket", "lo", "hi"]].iloc[-1]).all(axis=1).to_numpy()
            start = len(b) - int(np.argmin(last[::-1])) if not last.all() else 0
            carry = b.iloc[start:]
            if start:
                yield flush(b.iloc[:start])
        if carry is not None and len(carry):
            yield flush(carry)

    return dealt.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInPandas(verify, "src long, dst long")


# -- components -----------------------------------------------------------------------------------------------------


def components(edges: DataFrame, name: str = "components") -> tuple[DataFrame, str]:
    """(node, component) of every node in a link; component is the smallest node reachable. Also the table's path.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each a grouped minimum and an equi-join, so a hub is
    pre-aggregated and its join can be split. Every round is written to the shared folder.
    """
    spark = edges.sparkSession

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield _contract(b["src"].to_numpy(dtype=np.int64), b["dst"].to_numpy(dtype=np.int64))

    now, path = written(edges.mapInPandas(local, "src long, dst long").distinct(), name)
    while True:
        # large star: of u's neighbours, those over u go to the smallest of u and its neighbours
        both = now.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(now.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u and its neighbours under u go to the smallest of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        new = large.join(small, "u").select(F.explode(F.array(F.struct(F.col("v").alias("src"), F.col("m").alias("dst")), F.struct(F.col("u").alias("src"), F.col("m").alias("dst")))).alias("e")).select("e.*").filter("src <> dst").distinct()
        new, new_path = written(new, name)
        # done when every node has one link and no target has a link of its own
        ends = new.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("links")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("links")))).alias("e")).select("e.*")
        most = ends.groupBy("node").agg(F.sum("links").alias("links"), F.min("links").alias("least")).agg(F.max(F.when((F.col("least") == 0) & (F.col("links") > 0), 2).otherwise(F.col("links"))))
        done = (most.first()[0] or 0) < 2
        drop_path(spark, path)
        now, path = new, new_path
        if done:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("component")), path


def groups(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, component_id), one row per input row."""
    own, _ = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes, _ = written(own.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    n, gram = bit_statistics(classes)
    masks = probe_masks(plan_partitions(n, gram, lambda blocks: projections(classes, blocks), radius))  # both statistics are over all fingerprints
    found, _ = components(links(classes, masks, radius))
    label = classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return own.join(label, "fp", "left").select("doc_id", "text_hash", "fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Two texts are linked if their fingerprints differ in at most ``radius`` bits. Null and blank texts have fingerprint 0
    and are linked like any other. Rows that repeat give equal rows; rows whose id is null keep a null id and take the
    component of their fingerprint (null if no row with an id shares it). Other columns are ignored. An empty table gives no rows.
    """
    found = groups(docs, shingle, radius, id_col, text_col)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """The documents, with all their columns, of which the smallest doc_id of each group stays.

    Of rows that repeat an id or text one stays. Rows without an id go if a row with one shares their fingerprint; else one row of each such
    fingerprint stays.
    """
    columns, found = docs.columns, groups(docs, shingle, radius)
    stays = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone")).agg(
        F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))), F.min(F.struct("doc_id", "text_hash"))).alias("s")
    )
    stays = stays.select(F.col("s.doc_id").alias("_id"), F.col("s.text_hash").alias("_hash"))
    own = docs.withColumn("_text_hash", F.xxhash64("text"))
    kept = own.join(stays, own["doc_id"].eqNullSafe(stays["_id"]) & (own["_text_hash"] == stays["_hash"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "_text_hash"]).select(*columns)
