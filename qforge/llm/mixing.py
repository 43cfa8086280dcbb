"""Mixing sources to target weights, on DataFrame functions alone.

1. A table of sources: words, weight, target. Targets stop at ``cap`` times a source's words; what is over is shared again by weight
   (water filling, in closed form over the sources in order of cap / weight).
2. Each source's documents are dealt by hash into blocks, LEAST_BLOCKS of them or more, so that a block of a source has about BLOCK_ROWS rows
   at most. A mix takes whole epochs of a source and, for the rest, blocks in permuted order; of the block that crosses the target, documents in permuted order, the last one in part.
   So a source's taken words are its target, rounded to words.
3. The drawn blocks of a source are its quota. A binary tree over the output shards splits the quotas: at a node, the left half's
   counts are drawn from the multivariate hypergeometric distribution, one source after the other. The leaves' exact quotas
   give each shard disjoint runs of the source's permuted blocks.
4. ``write_mixture`` writes every shard to its own folder, its rows in the order of ``shuffle_key`` and epoch: shuffled locally.

A source is a row of step 1 and a number at a node of the tree, which are small tables whatever the documents are.

Everything is derived from a seed and hashes of the rows, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qforge.llm.common import WORD, drop_path, scratch, written

LEAST_BLOCKS, BLOCK_ROWS = 1024, 4096
SHARD = "_shard"
#: Rows of a shard that one task sorts and writes.
FILE_ROWS = 200_000
WEIGHTS = (5, 2, 1)
CAP = 3
LEVELS = 4  # 16 shards
SEED = 20240229
BROADCAST_ROWS = 100_000


def keyed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds _s (source; '' for null, '=' before any other), _size, _key (hash of the row) and _block."""
    blocks = max(LEAST_BLOCKS, 1 << max(0, (docs.count() - 1) // BLOCK_ROWS).bit_length())
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"_s": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")), "_size": size, "_key": F.xxhash64(F.lit(seed), "doc_id", "text")}).withColumn("_block", F.pmod(F.col("_key"), F.lit(blocks)).cast("int"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(_s, _size) rows to a row a source: i (its place by code point, null last), source_size, target."""
    by_name, by_cap = Window.orderBy(F.col("_s") == "", "_s"), Window.orderBy("ratio", "i")  # a row a source
    s = sizes.groupBy("_s").agg(F.sum("_size").alias("source_size")).withColumn("i", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("i") % len(weights)))
    s = s.withColumns({"most": (F.col("source_size") * cap).cast("double"), "total": F.sum("source_size").over(Window.partitionBy()).cast("double")})
    s = s.withColumn("ratio", F.col("most") / F.col("weight"))
    capped = F.sum("most").over(by_cap.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("most")
    rest = F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", (F.col("total") - capped) / rest)
    level = F.max(F.when(F.col("level") <= F.col("ratio") * (1 + 1e-12), F.col("level"))).over(Window.partitionBy())
    return s.select("_s", "i", "source_size", F.least("most", level * F.col("weight")).alias("target"))


def _hypergeometric(good: Column, bad: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` out of good + bad are good: inverts the distribution function at u, in logarithms."""
    low, high = F.greatest(F.lit(0).cast("long"), draws - bad), F.least(good, draws)

    def ratio(k: Column) -> Column:  # ln p(k) - ln p(k - 1)
        d = lambda x: x.cast("double")
        return F.log(d(good - k + 1)) + F.log(d(draws - k + 1)) - F.log(d(k)) - F.log(d(bad - draws + k))

    ks = F.when(high > low, F.sequence(low + 1, high)).otherwise(F.array().cast("array<bigint>"))
    zero = F.lit(0.0)

    def summed(a: Column, k: Column) -> Column:
        return _let(a["w"] + ratio(k), lambda w: F.struct(w.alias("w"), F.greatest(a["top"], w).alias("top"), (a["sum"] * F.exp(a["top"] - F.greatest(a["top"], w)) + F.exp(w - F.greatest(a["top"], w))).alias("sum")))

    # the sum of all weights, relative to the greatest
    total = F.aggregate(ks, F.struct(zero.alias("w"), zero.alias("top"), F.lit(1.0).alias("sum")), summed)

    def found(t: Column) -> Column:
        goal = u * t["sum"]

        def walk(a: Column, k: Column) -> Column:
            return _let(a["w"] + ratio(k), lambda w: F.struct(w.alias("w"), (a["sum"] + F.exp(w - t["top"])).alias("sum"), F.when(a["sum"] + F.exp(w - t["top"]) < goal, k + 1).otherwise(a["k"]).alias("k")))

        start = F.struct(zero.alias("w"), F.exp(-t["top"]).alias("sum"), F.when(F.exp(-t["top"]) < goal, low + 1).otherwise(low).alias("k"))
        return F.aggregate(ks, start, walk, lambda a: a["k"])

    return F.least(_let(total, found), high)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body on a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_quotas(quotas: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """(i, quota) to (shard, i, quota): the leaves of the splitting tree, 2 ** levels shards with near-equal numbers of blocks."""
    # a number a source, in one row: the tree's root
    nodes = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("quota").cast("long").alias("quota")))), lambda x: x["quota"]).alias("q")).select(F.lit(0).cast("long").alias("node"), "q")
    for level in range(levels):
        count = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)

        salt = F.lit(level)

        def draw(a: Column, x: Column) -> Column:
            u = (F.xxhash64(F.lit(seed), salt, F.col("node"), F.size(a["out"])).bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53))).cast("double")
            bad = a["left"] - x
            return _let(_hypergeometric(x, bad, a["draws"], u), lambda got: F.struct(bad.alias("left"), (a["draws"] - got).alias("draws"), F.concat(a["out"], F.array(got)).alias("out")))

        start = F.struct(count.alias("left"), (count / 2).cast("long").alias("draws"), F.array().cast("array<bigint>").alias("out"))
        nodes = nodes.withColumn("half", F.aggregate("q", start, draw, lambda a: a["out"]))
        other = F.zip_with("q", "half", lambda x, y: x - y)
        nodes = nodes.select(F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("half").alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), other.alias("q")))).alias("n")).select("n.*")
    return nodes.select(F.col("node").cast("int").alias("shard"), F.posexplode("q").alias("i", "quota"))


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """From (_s, _size, _block) rows the decision on each block: source_size, target, epochs (whole ones), part ('all', 'some' or 'none' in the
    last epoch), part_words (what 'some' has to give) and units (epoch and shard of each time the block is drawn)."""
    blocks = rows.groupBy("_s", "_block").agg(F.sum("_size").alias("words"))
    goal = targets(blocks.select("_s", F.col("words").alias("_size")), weights, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    drawn = Window.partitionBy("_s").orderBy(F.xxhash64(F.lit(seed + 1), "_s", "_block"), "_block")
    blocks = blocks.join(goal, "_s").withColumn("before", F.sum("words").over(drawn.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words"))
    part = F.when(F.col("before") + F.col("words") <= F.col("rest"), "all").when(F.col("before") < F.col("rest"), "some").otherwise("none")
    # blocks without a word are drawn with whole epochs only
    blocks = blocks.withColumn("part", F.when(F.col("words") > 0, part).otherwise("none")).withColumn("part_words", F.col("rest") - F.col("before"))
    blocks, _ = written(blocks.select("_s", "i", "_block", "source_size", "target", "epochs", "part", "part_words"), "mix-blocks")
    last = F.when(F.col("part") != "none", 1).otherwise(0)
    units = blocks.select("_s", "i", "_block", F.explode(F.when(F.col("epochs") + last > 0, F.sequence(F.lit(0), F.col("epochs") + last - 1)).otherwise(F.array().cast("array<int>"))).alias("epoch"))
    permuted = Window.partitionBy("i").orderBy(F.xxhash64(F.lit(seed + 2), "_s", "_block", "epoch"), "_block", "epoch")
    units = units.withColumn("rank", F.row_number().over(permuted))
    quotas = blocks.groupBy("i").agg(F.sum(F.col("epochs") + last).alias("quota"))
    shards = split_quotas(quotas, levels, seed).filter("quota > 0")
    upto = F.sum("quota").over(Window.partitionBy("i").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = shards.withColumn("upto", upto).select("i", "shard", F.explode(F.sequence(F.col("upto") - F.col("quota") + 1, F.col("upto"))).alias("rank")).withColumn("rank", F.col("rank").cast("int"))
    placed = units.join(runs, ["i", "rank"]).groupBy("_s", "_block").agg(F.array_sort(F.collect_list(F.struct("epoch", "shard"))).alias("units"))
    return blocks.drop("i").join(placed, ["_s", "_block"], "left")


def decide(rows: DataFrame, blocks: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds source_size, target, taken and shards (one for each time the mix takes the row) to keyed rows."""
    kept, _ = written(blocks, "mix-plan")
    fits = kept.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(kept) if fits else kept, ["_s", "_block"])
    whole = F.when(F.col("part") == "all", F.col("_size")).otherwise(F.lit(0).cast("long"))
    # the one block of a source that its target cuts: its rows in permuted order
    order = Window.partitionBy("_s").orderBy(F.xxhash64(F.lit(seed + 3), "_key"), "doc_id", "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("_size").over(order) - F.col("_size")
    cut = joined.filter("part = 'some'").withColumn("_last", F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), F.col("part_words") - before)))
    out = joined.filter("part <> 'some'").withColumn("_last", whole).unionByName(cut)
    mine = F.filter("units", lambda u: (u["epoch"] < F.col("epochs")) | (F.col("_last") > 0))
    return out.withColumns({"taken": F.col("epochs") * F.col("_size") + F.col("_last"), "shards": F.coalesce(F.transform(mine, lambda u: u["shard"]), F.array().cast("array<int>"))})


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """One row per document row: doc_id, size, source_size, target, taken, shards, shuffle_key.

    Words are those between ASCII white space; null and empty texts have none and nothing is taken of them. A null source is a source, the
    last. Rows that repeat are rows of their own; which of several equal rows a target cuts is immaterial. An empty table gives no rows.
    At most one document of a source is taken in part. Other columns are ignored.
    """
    rows, _ = written(keyed(docs.select("doc_id", "source", "text"), seed).select("doc_id", "_s", "_size", "_key", "_block"), "mix-rows")
    return decide(rows, plan(rows, weights, cap, levels, seed), seed).select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken", "shards", F.xxhash64(F.lit(seed + 4), "_key").alias("shuffle_key"))


def write_mixture(docs: DataFrame, path: str, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, levels: int = LEVELS, seed: int = SEED) -> str:
    """Write the mix: every document whole, once for each time it is drawn, with the columns of ``docs``; the folders are its shards.

    A shard's rows are shuffled: they are in the order of a hash of the row and the epoch within each of its files, and dealt to the files by another. The one
    document of a source that the target cuts is written whole if at least half of it is taken. Documents without a word are not drawn. Rows that repeat are rows of their own. An
    empty table, or one without a word, makes an empty file.
    """
    own = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_own")  # so that no name clashes with those of a plan
    rows = keyed(docs.select("doc_id", "source", "text", own), seed).drop("source", "text")
    sizes, sizes_path = written(rows.select("_s", "_size", "_block"), "mix-rows")
    drawn = decide(rows, plan(sizes, weights, cap, levels, seed), seed)
    last = F.when(2 * F.col("_last") >= F.col("_size"), 1).otherwise(0)
    drawn = drawn.filter("_size > 0").withColumn("_n", F.col("epochs") + last).filter("_n > 0")
    drawn = drawn.select("_own", "_key", F.explode(F.filter("units", lambda u: u["epoch"] < F.col("_n"))).alias("_u"))
    drawn = drawn.select("_own", F.col("_u.shard").alias("_shard"), F.xxhash64(F.lit(seed + 4), "_key", "_u.epoch").alias("_order"))
    total = sizes.count() * cap
    files = max(1, -(-total // (FILE_ROWS << levels)))
    dealt = drawn.repartition((2 << levels) * files, "_shard", F.pmod(F.xxhash64(F.lit(seed + 5), "_order"), F.lit(files)))
    shard = SHARD
    while shard in map(str.lower, docs.columns):
        shard += "_"
    sorted_rows = dealt.sortWithinPartitions("_shard", "_order").select("_own.*", F.col("_shard").alias(shard))
    sorted_rows.write.partitionBy(shard).option("compression", "zstd").parquet(path)
    drop_path(docs.sparkSession, sizes_path)
    return path


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """The documents of the mix, whole and as often as it takes them, with the columns of ``docs``: the rows of ``write_mixture``, read from its shards."""
    spark = docs.sparkSession
    path = write_mixture(docs, scratch(spark, "mixture"), weights, cap, levels, seed)
    return spark.read.schema(docs.schema).parquet(path).select(*[f"`{c}`" for c in docs.columns])
