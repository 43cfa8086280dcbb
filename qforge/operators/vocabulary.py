"""Words of a bank: counts, document frequency, known words, and records garbled by OCR."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qforge.functions import text as X

#: Endings that a known word may have.
SUFFIXES = ("s", "es", "ed", "d", "ing", "ly", "er", "ers", "al", "ation", "ment")


def vocabulary(rows: DataFrame, text: Column, trusted: Column) -> DataFrame:
    """word (lower case), n, trusted (some trusted row has it), lower_seen (seen in running lower case). Letters count in their compatibility form, as repairs see them."""
    words = F.regexp_extract_all(X.normal_form(text), F.lit("[A-Za-z]+"), F.lit(0))
    each = rows.select(F.explode(words).alias("w"), trusted.alias("t"))
    return each.groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"), F.bool_or("t").alias("trusted"), F.bool_or(F.col("w") == F.lower("w")).alias("lower_seen"))


def document_frequency(rows: DataFrame, words: Column) -> DataFrame:
    return rows.select(F.explode(F.array_distinct(F.transform(words, F.lower))).alias("word")).groupBy("word").agg(F.count("*").alias("records"))


def stems(word: Column) -> Column:
    """The word and what it may be an inflection of; stems have three letters at least."""
    out = [F.array(word)]
    for s in SUFFIXES:
        stem = F.substr(word, F.lit(1), F.length(word) - len(s))
        out.append(F.when(F.endswith(word, F.lit(s)) & (F.length(word) - len(s) >= 3), F.array(stem, F.concat(stem, F.lit("e")))).otherwise(F.array().cast("array<string>")))
    ies = F.when(F.endswith(word, F.lit("ies")), F.array(F.concat(F.substr(word, F.lit(1), F.length(word) - 3), F.lit("y")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*out, ies)))


def known(words: DataFrame, word_list: DataFrame) -> DataFrame:
    """The distinct words that the list has, as they are or as an inflection. Both sides are joined by stem, whatever their size."""
    return words.select("word", F.explode(stems(F.col("word"))).alias("stem")).join(word_list.select(F.lower("word").alias("stem")).distinct(), "stem", "left_semi").select("word").distinct()


def garbled(rows: DataFrame, key: str, text: Column, reference: DataFrame, reference_words: Column, word_list: DataFrame, least: int = 2) -> DataFrame:
    """(key, unknown), over texts in compatibility form: records with ``least`` or more occurrences of words that start in lower case, that no other reference record has, and that are not known."""
    frequent = document_frequency(reference, reference_words).filter("records > 1").select("word")
    each = rows.select(key, F.explode(X.letter_words(X.normal_form(text))).alias("w")).filter(F.substring("w", 1, 1).rlike("[a-z]")).select(key, F.lower("w").alias("word"))
    # what is joined is words, which make hash tables; the places where they stand pass by those unsorted
    odd = each.join(frequent.hint("shuffle_hash"), "word", "left_anti")
    fine = known(odd.select("word").distinct(), word_list)
    return odd.join(fine.hint("shuffle_hash"), "word", "left_anti").groupBy(key).agg(F.count("*").alias("unknown")).filter(F.col("unknown") >= least)
