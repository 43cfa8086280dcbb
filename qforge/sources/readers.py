"""Files in, as DataFrames with given schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from qforge.functions import text as X
from qforge.operators.lines import lines


def text_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, text): a row a file, whole."""
    return spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def text_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, line_no from 1, line)."""
    return lines(text_files(spark, path, glob), "path", "text")


def json_arrays(spark: SparkSession, path: str, schema: StructType | str, glob: str = "*.json") -> DataFrame:
    """Rows of files that hold an array of objects each. Files that do not parse give a row of nulls (PERMISSIVE)."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", glob).json(path)


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-cased words of a file with a word a line."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).filter("word <> ''").distinct()


def listing(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Paths with the suffix, in order; no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select("path", "length", "modificationTime").orderBy("path")


def file_kind(mime: Column, name: Column) -> Column:
    """pdf, image or text, by MIME type or extension."""
    low, kind = F.lower(name), F.lower(F.coalesce(mime, F.lit("")))
    return F.when(kind.contains("pdf") | low.endswith(".pdf"), "pdf").when(kind.startswith("image/") | low.rlike(r"\.(png|jpe?g|webp|gif|bmp|tiff?)$"), "image").otherwise("text")


def combined(parts: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """One text a key: its parts in order, blank ones and failed ones (null) left out, joined by blank lines."""
    kept = parts.filter(F.trim(F.coalesce(text, F.lit(""))) != "")
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n\n").alias("text"))


def under_markers(files: DataFrame, key: str, path: str = "path", text: str = "text") -> DataFrame:
    """Files of a key after one another, each under a [PDF_SOURCE path] mark."""
    marked = F.struct(F.col(path).alias("p"), F.concat(F.lit("[PDF_SOURCE "), F.col(path), F.lit("]\n"), F.col(text)).alias("t"))
    return files.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(marked)), lambda x: x["t"]), "\n\n").alias("text"))


def layer_pages(layers: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, page from 1, text, usable) of text layers, whose pages end with form feeds; usable: enough to do without OCR."""
    return layers.select(key, F.posexplode(F.split(text, "\f")).alias("p", "text")).select(key, (F.col("p") + 1).alias("page"), "text", X.usable_text_layer(F.col("text")).alias("usable"))


def page_text(pages: DataFrame, replies: DataFrame, key: str) -> DataFrame:
    """(key, text): the pages of ``layer_pages`` in order, each under its [PDF_PAGE n] mark; pages that are not usable take the reply (key, page, reply) of an OCR service, if there is one."""
    joined = pages.join(replies.select(key, "page", "reply"), [key, "page"], "left")
    text = F.when(F.col("usable"), F.col("text")).otherwise(F.coalesce("reply", "text"))
    marked = F.struct("page", F.concat(F.lit("[PDF_PAGE "), F.col("page").cast("string"), F.lit("]\n"), text).alias("t"))
    return joined.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(marked)), lambda x: x["t"]), "\n\n").alias("text"))


def practice_tests(spark: SparkSession, path: str) -> DataFrame:
    """(test, portion, kind, text) of files test<N>-<questions|answers>.txt; what follows a line "State" is the State portion."""
    files = text_files(spark, path, "*.txt").select(F.regexp_extract("path", r"test(\d+)-(\w+)\.txt$", 1).try_cast("int").alias("test"), F.regexp_extract("path", r"test(\d+)-(\w+)\.txt$", 2).alias("kind"), "text")
    halves = F.split("text", r"(?m)^\s*State(?: Portion)?\s*$", 2)
    return files.select("test", "kind", F.posexplode(halves).alias("p", "text")).select("test", F.when(F.col("p") == 0, "National").otherwise("State").alias("portion"), "kind", "text")
