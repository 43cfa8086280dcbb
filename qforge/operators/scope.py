"""A scope is chapters with items, as rows (chapter, chapter_no, item, item_no): derive, merge, freeze, match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qforge.functions import text as X
from qforge.storage import settled


def derived(rows: DataFrame, chapter: Column, number: Column, item: Column, seq: str) -> DataFrame:
    """(chapter, chapter_no, items): chapters by their smallest number, then title; distinct item titles in order of first sight."""
    first = rows.select(chapter.alias("chapter"), number.alias("no"), item.alias("item"), F.col(seq).alias("seq")).groupBy("chapter", "item").agg(F.min("no").alias("no"), F.min("seq").alias("seq"))
    out = first.groupBy("chapter").agg(F.min("no").alias("chapter_no"), F.array_sort(F.collect_list(F.struct("seq", "item"))).alias("i"))
    return out.select("chapter", "chapter_no", F.transform("i", lambda x: x["item"]).alias("items"))


def merged(current: DataFrame, suggested: DataFrame, title: str) -> DataFrame:
    """Suggested items by normalised title (lower case, trimmed) beside the current ones; where both have one, the current stays. origin: current or suggested."""
    norm = F.lower(F.trim(F.col(title)))
    c, s = (t.groupBy(norm.alias("k")).agg(F.min(title).alias(f"{n}_title")) for t, n in ((current, "c"), (suggested, "s")))
    return c.join(s, "k", "full_outer").select(F.coalesce("c_title", "s_title").alias(title), F.when(F.col("c_title").isNotNull(), "current").otherwise("suggested").alias("origin"))


def frozen(current: DataFrame, incoming: DataFrame, used: DataFrame, item: str) -> DataFrame:
    """(item, frozen): the incoming items, and those of the current ones that are gone but used, frozen."""
    gone = current.select(item).distinct().join(used.select(item).distinct(), item, "left_semi").join(incoming.select(item).distinct(), item, "left_anti")
    return incoming.select(item).distinct().withColumn("frozen", F.lit(False)).union(gone.withColumn("frozen", F.lit(True)))


#: Characters of the pieces by which titles are found in texts.
PIECE = 4
#: Pieces up to which those of all titles are broadcast.
SMALL = 200_000


def _pieces(text: Column, width: int) -> Column:
    """All runs of ``width`` characters of a text, in one pass over it."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1))


def first_match(rows: DataFrame, key: str, haystack: Column, items: DataFrame, item: str, title: str, order: str) -> DataFrame:
    """Adds matched: the first scope item, in order, whose title is within the haystack (any case), else null. ``key`` is unique.

    A title is looked for where its rarest piece of PIECE characters is (of a shorter title all of it), counted over the haystacks; a title with a piece that no haystack has is in none. Pieces
    travel with their key alone. A haystack meets the titles found for it once, as one list, and the first of those that it holds is taken. The empty title is in every haystack.
    """
    titles = items.select(F.lower(title).alias("_title"), F.col(order).alias("_order"), F.col(item).cast("string").alias("_item")).filter("_title is not null")
    titles = settled(titles.groupBy("_title").agg(F.min(F.struct("_order", "_item")).alias("_at")), "titles")
    low = rows.select(F.col(key).alias("_key"), F.lower(haystack).alias("_low")).filter("_low is not null")
    length = F.length("_title")
    own = F.array_distinct(F.when(length >= PIECE, _pieces(F.col("_title"), PIECE)).otherwise(F.array("_title")))
    of_titles = settled(titles.filter("_title <> ''").select("_title", F.explode(own).alias("_piece")), "pieces")
    known = of_titles.select("_piece").distinct()
    widths = [r[0] for r in known.select(F.length("_piece")).distinct().collect()]  # PIECE numbers at most
    if not widths:
        met = low.select("_key").limit(0).select("_key", F.lit(None).cast(titles.schema["_at"].dataType).alias("_at"))
    else:
        there = low.select("_key", F.explode(F.array_distinct(F.concat(*[_pieces(F.col("_low"), w) for w in sorted(widths)]))).alias("_piece"))
        spots = settled(there.join(F.broadcast(known) if known.count() <= SMALL else known, "_piece", "left_semi"), "spots")
        rarity = of_titles.join(spots.groupBy("_piece").agg(F.count("*").alias("n")), "_piece", "left")
        anchors = rarity.groupBy("_title").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "_piece")).alias("a")).filter("a.n > 0").select("_title", F.col("a._piece").alias("_piece"))
        found = spots.join(anchors.join(titles, "_title"), "_piece").groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_at", "_title"))).alias("_may"))
        met = low.join(found, "_key").select("_key", F.get(F.filter("_may", lambda x: F.contains(F.col("_low"), x["_title"])), F.lit(0))["_at"].alias("_at")).filter("_at is not null")
    if everywhere := titles.filter("_title = ''").first():
        at = F.struct(F.lit(everywhere["_at"][0]).alias("_order"), F.lit(everywhere["_at"][1]).alias("_item"))
        met = low.select("_key").join(met, "_key", "left").select("_key", F.least("_at", at.cast(titles.schema["_at"].dataType)).alias("_at"))
    first = met.select("_key", F.col("_at._item").alias("matched"))
    return rows.join(first, rows[key] == first["_key"], "left").drop("_key")


def context_text(chunks: DataFrame, by: str, order: str, content: str, most: int = 5000) -> DataFrame:
    """Chunks of a topic in order, joined by blank lines, cut to ``most`` characters. Only the first ``most`` / 2 + 1 chunks of a topic can matter, as each takes two characters at least; they
    are found on narrow rows, and before the shuffle too."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    narrow = chunks.filter(F.col(content).isNotNull()).select(by, order, F.substring(content, 1, most).alias("_t")).withColumn("_r", place).filter(F.col("_r") <= most // 2 + 1)
    before = F.sum(F.length("_t") + 2).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("_t") - 2
    kept = narrow.withColumn("_before", before).filter(F.col("_before") < most + 2)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_t"))), lambda x: x["_t"]), "\n\n")
    return kept.groupBy(by).agg(F.substring(text, 1, most).alias("context"))


def normalized(chapters: Column, most_chapters: int = 50, most_items: int = 100, length: int = 200) -> Column:
    """Chapters (array of struct of title and items, an array of struct of id, title, details) with texts trimmed and cut, untitled ones dropped, and no more of them than allowed."""
    text = lambda x: X.short(x, length)
    items = lambda c: F.slice(F.filter(F.transform(F.coalesce(c["items"], F.array().cast("array<struct<id:string,title:string,details:string>>")), lambda i: F.struct(i["id"].alias("id"), text(i["title"]).alias("title"), X.short(i["details"], 2000).alias("details"))), lambda i: i["title"] != ""), 1, most_items)
    made = F.transform(F.slice(chapters, 1, most_chapters), lambda c: F.struct(text(c["title"]).alias("title"), items(c).alias("items")))
    return F.filter(made, lambda c: c["title"] != "")


def active_items(chapters: Column) -> Column:
    """The items of all chapters, in order, that are not frozen: items is an array of struct of id, title, frozen."""
    return F.filter(F.flatten(F.transform(chapters, lambda c: c["items"])), lambda i: ~F.coalesce(i["frozen"], F.lit(False)))


def usable(chapters: Column) -> Column:
    """Whether a scope has an active item; without one it can't be saved."""
    return F.size(active_items(chapters)) > 0


def described(scope: DataFrame, by: str, most: int = 8000) -> DataFrame:
    """(by, context) of (by, chapter_no, chapter, item_no, item, title, details, frozen) rows: chapters in order with their active items, a line each."""
    line = F.concat(F.lit("  - "), "item", F.lit(": "), "title", F.when(F.coalesce("details", F.lit("")) != "", F.concat(F.lit(" - "), "details")).otherwise(""))
    one = scope.groupBy(by, "chapter_no", "chapter").agg(F.array_sort(F.collect_list(F.when(~F.coalesce("frozen", F.lit(False)), F.struct("item_no", line.alias("l"))))).alias("x"))
    text = F.concat("chapter", F.lit("\n"), F.array_join(F.transform("x", lambda x: x["l"]), "\n"))
    parts = F.array_sort(F.collect_list(F.struct("chapter_no", "chapter", text.alias("t"))))
    return one.groupBy(by).agg(F.substring(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n"), 1, most).alias("context"))
