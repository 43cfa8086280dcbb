"""Reading order of pages: column text by its gutter, word boxes by their geometry. One page is one group; pages are independent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qforge.functions import text as X

#: Pages that a Python worker puts in order at a time.
ROWS = 500


def _longest_run(mask: np.ndarray) -> tuple[int, int]:
    """(start, length) of the first longest run of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    return (int(starts[(ends - starts).argmax()]), int((ends - starts).max())) if len(starts) else (0, 0)


def gutter(lines: list[str]) -> tuple[int, int] | None:
    """Columns [start, end) between 30 and 70 % of the width that are blank in at least 45 % of the lines, if three or more stand together.

    Six lines of text and a width of 20 are needed. A line that ends before a column does not make it blank.
    """
    rows = [line.rstrip() for line in lines if line.strip()]
    width = max(map(len, rows), default=0)
    if len(rows) < 6 or width < 20:
        return None
    chars = np.array([np.frombuffer(r.ljust(width + 1, "\0").encode("utf-32-le"), "<u4") for r in rows])
    low, high = int(width * 0.3), int(np.ceil(width * 0.7))
    start, n = _longest_run((chars[:, low : high + 1] == 32).sum(axis=0) >= 0.45 * len(rows))
    return (low + start, low + start + n) if n >= 3 else None


def column_order(page: str | None) -> tuple[str, bool]:
    """(text, whether it has two columns): full-width lines of the upper half, the left column, the right column, full-width lines of the lower half."""
    lines = (page or "").replace("\r\n", "\n").split("\n")
    plain = "\n".join(line for line in lines if line.strip())
    if not (g := gutter(lines)):
        return plain, False
    parts: dict[str, list[str]] = {"top": [], "left": [], "right": [], "bottom": []}
    pairs = 0
    for i, line in enumerate(lines):
        if not line.strip():
            continue
        a, b = max(0, g[0] - 2), min(len(line), g[1] + 2)
        start, n = _longest_run(np.array([c == " " for c in line[a:b]], dtype=bool))
        left, right = line[: a + start].strip(), line[a + start + n :].strip()
        if n >= 3 and left and right:
            parts["left"].append(left)
            parts["right"].append(right)
            pairs += 1
        elif line[: g[0]].strip() and line[g[1] :].strip():
            parts["top" if i < len(lines) / 2 else "bottom"].append(line.strip())
        else:
            parts["right" if line[g[1] :].strip() else "left"].append(line.strip())
    return ("\n".join(x for p in parts.values() for x in p), True) if pairs >= 3 else (plain, False)


def ordered_pages(pages: DataFrame, key: str = "page", text: str = "text") -> DataFrame:
    """(key, text, two_columns) of pages of column text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), ROWS):
                part = b.iloc[s : s + ROWS]
                got = [column_order(t) for t in part["text"]]
                yield pd.DataFrame({"key": part["key"], "text": [t for t, _ in got], "two": [c for _, c in got]})

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, text string, two boolean").toDF(key, "text", "two_columns")


def totals(pages: DataFrame) -> DataFrame:
    """pages and two_column_pages over all sources: one row."""
    return pages.agg(F.count("*").alias("pages"), F.count_if("two_columns").alias("two_column_pages"))


def word_boxes(tsv: DataFrame, key: str, text: str = "tsv") -> DataFrame:
    """(key, line_id, left, top, right, bottom, text) of OCR tables: word rows with a confidence, numeric geometry and a text that is not blank; the header goes."""
    # cells are split within the text: as a column over rows Spark would split a row anew for each cell that a filter names
    rows = tsv.select(key, F.posexplode(F.transform(F.split(text, "\n"), lambda r: F.split(r, "\t"))).alias("n", "c")).filter("n > 0")
    at = lambda i: F.get("c", F.lit(i))
    number = lambda i: at(i).try_cast("double")
    rows = rows.filter((F.size("c") >= 12) & (number(0) == 5) & (number(10) >= 0) & (X.trimmed(at(11)) != ""))
    left, top = number(6), number(7)
    out = rows.select(key, F.array_join(F.slice("c", 2, 4), ":").alias("line_id"), left.alias("left"), top.alias("top"), (left + number(8)).alias("right"), (top + number(9)).alias("bottom"), X.trimmed(at(11)).alias("text"))
    return out.dropna(subset=["left", "top", "right", "bottom"])


def ocr_lines(boxes: DataFrame, key: str) -> DataFrame:
    """(key, line_id, left, right, top, bottom, words, text): the lines that OCR reports, words from left to right."""
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda w: w["text"]), " ")
    return boxes.groupBy(key, "line_id").agg(F.min("left").alias("left"), F.max("right").alias("right"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.count("*").alias("words"), words.alias("text"))


def column_major(boxes: DataFrame, key: str) -> DataFrame:
    """(key, text): lines that start left of the middle, then those right of it, each from top to bottom, if both sides have three words; else all from top to bottom."""
    page = Window.partitionBy(key)
    lines = ocr_lines(boxes, key).withColumn("mid", (F.min("left").over(page) + F.max("right").over(page)) / 2)
    sided = lines.withColumn("side", F.when(F.col("left") < F.col("mid"), 0).otherwise(1))
    sided = sided.withColumns({"l": F.sum(F.when(F.col("side") == 0, F.col("words")).otherwise(0)).over(page), "w": F.sum("words").over(page)})
    sided = sided.withColumn("side", F.when((F.col("l") >= 3) & (F.col("w") - F.col("l") >= 3), F.col("side")).otherwise(0))
    order = F.array_sort(F.collect_list(F.struct("side", "top", "left", "text")))
    return sided.groupBy(key).agg(F.array_join(F.transform(order, lambda x: x["text"]), "\n").alias("text"))


def column_split(boxes: DataFrame, key: str, least_lines: int = 6, share: float = 0.25) -> DataFrame:
    """(key, split): the middle of the gutter of pages whose lines all lie on one side of it, a quarter at least on each, with a gutter of a line's height; else null.

    Bare numbers do not count; a first line that stands apart from the next by twice its height is a running header.
    """
    # what does not count stays as a row, so that every page has one without a join
    lines = ocr_lines(boxes, key).withColumn("counts", ~F.col("text").rlike(r"^\d+[.]?$"))
    alike = Window.partitionBy(key, "counts")
    lines = lines.withColumns({"r": F.row_number().over(alike.orderBy("top", "left")), "next": F.lead("top").over(alike.orderBy("top", "left")), "of": F.count("*").over(alike)})
    header = (F.col("r") == 1) & (F.col("next") - F.col("bottom") > 2 * (F.col("bottom") - F.col("top")))
    lines = lines.withColumn("counts", F.coalesce(F.col("counts") & (F.col("of") >= least_lines) & ~header, F.lit(False)))
    body = lambda x: F.when(F.col("counts"), x)
    page = Window.partitionBy(key)
    lines = lines.withColumn("mid", (F.min(body(F.col("left"))).over(page) + F.max(body(F.col("right"))).over(page)) / 2)
    a, b = F.col("counts") & (F.col("right") < F.col("mid")), F.col("counts") & (F.col("left") > F.col("mid"))
    got = lines.groupBy(key).agg(F.count_if(a).alias("a"), F.count_if(b).alias("b"), F.count_if("counts").alias("n"), F.max(F.when(a, F.col("right"))).alias("x"), F.min(F.when(b, F.col("left"))).alias("y"), X.upper_median(F.collect_list(body(F.col("bottom") - F.col("top")))).alias("h"))
    need = F.ceil(F.col("n") * share)
    fine = (F.col("a") >= need) & (F.col("b") >= need) & (F.col("a") + F.col("b") == F.col("n")) & (F.col("y") - F.col("x") >= F.col("h"))
    return got.select(key, F.when(fine, X.rounded((F.col("x") + F.col("y")) / 2)).alias("split"))


def banded(boxes: DataFrame, key: str, least_rows: int = 4, least_two_sided: int = 3) -> DataFrame:
    """(key, text): rows of words by their centres; runs of rows with a clear gutter, four at least and three of them two-sided, are read left column then right; all else from top to bottom."""

    def rows_of(words: list[tuple], tolerance: float) -> list[list[tuple]]:
        """Words (left, top, right, bottom, text) to rows: a word within the tolerance of the running mean of a row's centres joins it."""
        rows: list[list[tuple]] = []
        centre = -np.inf
        for w in sorted(words, key=lambda w: (w[1] + w[3], w[0])):
            c = (w[1] + w[3]) / 2
            if c - centre > tolerance:
                rows.append([])
                centre = c
            rows[-1].append(w)
            centre += (c - centre) / len(rows[-1])
        return [sorted(r, key=lambda w: w[0]) for r in rows]

    def order(words: list[tuple]) -> str:
        heights = sorted(w[3] - w[1] for w in words)
        h = heights[len(heights) // 2] or 1.0
        low, high = min(w[0] for w in words), max(w[2] for w in words)
        mid, zone = (low + high) / 2, max(0.5 * h, 0.01 * (high - low))
        right = lambda w: (w[0] + w[2]) / 2 >= mid
        rows = rows_of(words, 0.6 * h)
        clear = [not any(w[0] < mid + zone and w[2] > mid - zone for w in r) for r in rows]
        out, i = [], 0
        while i < len(rows):
            j = i + 1
            while clear[i] and j < len(rows) and clear[j]:
                j += 1
            block = rows[i:j]
            if clear[i] and len(block) >= least_rows and sum(len(set(map(right, r))) == 2 for r in block) >= least_two_sided:
                block = [r for side in (False, True) for r in rows_of([w for b in block for w in b if right(w) == side], 0.6 * h)]
            out += [" ".join(w[4] for w in r) for r in block]
            i = j
        return "\n".join(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "text": [order([tuple(w.values()) for w in words]) for words in b["words"]]})

    kind = boxes.schema[key].dataType.simpleString()
    pages = boxes.groupBy(key).agg(F.collect_list(F.struct("left", "top", "right", "bottom", "text")).alias("words"))  # a page's words, which are few
    return pages.mapInPandas(run, f"{key} {kind}, text string")
