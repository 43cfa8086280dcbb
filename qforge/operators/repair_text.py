"""OCR damage repaired by the bank's own vocabulary: dropped fi/fl ligatures and glued articles.

What damage makes of the words of the vocabulary is a table; the distinct words and neighbours of each text are joined to it, whatever its size, and only what it has goes back to the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from qforge.functions import text as X
from qforge.storage import ROW_BYTES, few, settled

#: Fixed values, in order of preference.
LIGATURES = ("fi", "fl", "ffi", "ffl", "ff")
#: Places of the bitmap of what is damaged, as a power of two, and those of one of its pieces, as Spark's functions cut it.
PLACES, PIECE = 26, 1 << 15


def normalised(text: Column) -> Column:
    """NFKC, stray ideographs and a leading list number dropped."""
    return F.regexp_replace(X.without_stray_cjk(X.normal_form(text)), r"^\s*\(?\s*\d{1,3}[.,]\s+(?=[A-Z])", "")


_WORD = re.compile("[A-Za-z'’]+")
_START = re.compile("[.?!:][ \\t\\n\\x0b\\f\\r]+[\\x85\\u2028\\u2029]?\\Z")
_GLUED = re.compile("(?:An(?=[a-z]{3})|A)([a-z]{3,})")


def _tokens(text: str) -> list[tuple[str, str, bool, str | None]]:
    """(gap before it, word, whether it may be damaged, the rest of a word that starts a sentence and with "A" or "An") for each word, and what follows the last one."""
    out, at = [], 0
    for m in _WORD.finditer(text):
        gap, word = text[at : m.start()], m[0]
        glued = _GLUED.fullmatch(word) if _START.search(gap) or (at == 0 and gap == "") else None
        out.append((gap, word, word.isalpha() and not (len(word) > 1 and word == word.upper()), glued and glued[1]))
        at = m.end()
    return [*out, (text[at:], "", False, None)]


def _pair(x: tuple, y: tuple) -> str | None:
    return f"{x[1]} {y[1]}".lower() if x[2] and y[2] and y[0] == " " else None


def asking(damage: DataFrame) -> Callable[[Column], Column]:
    """What a text may hold that is damaged, as a function of texts: words, neighbours with a space between, and words that start a sentence with a plus before.

    Of these only what has a place in a bitmap of the damage's hashes (8 MB, whatever the damage) is given, so that not all words of all texts are shuffled where the damage is too large to be broadcast. It
    drops nothing that is damaged; the join says what is.
    """
    place = F.pmod(F.xxhash64("key"), F.lit(1 << PLACES))
    pieces = damage.select(F.floor(place / PIECE).alias("piece"), (place % PIECE).alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    whole = np.zeros((1 << PLACES) // 8, dtype=np.uint8)
    for r in pieces:
        whole[r["piece"] * (PIECE // 8) : (r["piece"] + 1) * (PIECE // 8)] = np.frombuffer(r["bits"], dtype=np.uint8)
    held = damage.sparkSession.sparkContext.broadcast(whole.tobytes())

    @F.pandas_udf(ArrayType(StringType()))
    def asked(texts: pd.Series) -> pd.Series:
        bits = held.value

        def there(key: str) -> bool:
            at = xxhash.xxh64_intdigest(key.encode(), 42) & ((1 << PLACES) - 1)
            return bool(bits[at >> 3] >> (at & 7) & 1)

        def keys(text: str | None) -> list[str]:
            x = _tokens(text or "")
            return [k for k in {w[1].lower() for w in x if w[2] and len(w[1]) > 1} | {p for p in map(_pair, x, x[1:]) if p} | {"+" + w[1].lower() for w in x if w[3]} if there(k)]

        return texts.map(keys)

    return asked


@F.pandas_udf(StringType())
def mended(texts: pd.Series, keys: pd.Series, news: pd.Series) -> pd.Series:
    """Texts with what is known of their words (keys as in ``asking``) put in. Of pairs that overlap, the first, third ... of a chain are taken."""

    def cased(word: str, new: str) -> str:
        return new[:1].upper() + new[1:] if "A" <= word[0] <= "Z" else new

    def mend(text: str | None, known: dict[str, str]) -> str | None:
        if not known:
            return text
        x, out, taken = _tokens(text), [], False
        for now, after in zip(x, [*x[1:], ("", "", False, None)], strict=True):
            gap, word, plain, rest = now
            if taken:  # by the word before
                taken = False
                continue
            low = word.lower()
            cut = rest is not None and "+" + low in known
            pair = None if cut else known.get(_pair(now, after) or "")
            if pair:
                new, taken = cased(word, pair), True
            elif cut:
                new = f"{word[: len(word) - len(rest)]} {rest}"
            else:
                new = cased(word, known[low]) if plain and len(word) > 1 and low in known else word
            out.append(gap + new)
        return "".join(out)

    return pd.Series([mend(t, dict(zip(k, n, strict=True)) if k is not None else {}) for t, k, n in zip(texts, keys, news, strict=True)], dtype=object)


def damaged(vocabulary: DataFrame, least: int, least_rest: int) -> DataFrame:
    """(key, new), keys as in ``asking``: what words of the vocabulary look like without a ligature, alone or in two, and glued to "A" or "An"."""
    v = vocabulary.filter(f"n >= {least}").select("word", "n")

    def spots(g: str) -> Column:
        return F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: F.substr("word", i, F.lit(len(g))) == g)

    spot = F.posexplode(F.array(*map(spots, LIGATURES)))
    split = v.filter("word like '%fi%' or word like '%fl%' or word like '%ff%'").select("word", spot.alias("rank", "at")).select("word", "rank", F.explode("at").alias("at"))
    size = F.get(F.array(*[F.lit(len(g)) for g in LIGATURES]), F.col("rank"))
    split = split.select("word", "rank", F.substr("word", F.lit(1), F.col("at") - 1).alias("low"), F.substr("word", F.col("at") + size).alias("next"))
    sure = vocabulary.filter("trusted").select("word")
    best = F.min(F.struct("rank", "word"))["word"].alias("new")
    led = split.filter("low = '' and length(next) >= 2").groupBy(F.col("next").alias("key")).agg(best).join(sure.withColumnRenamed("word", "key"), "key", "left_anti")
    two = split.filter("low != '' and next != ''").groupBy("low", "next").agg(best)
    for side in ("low", "next"):
        two = two.join(sure.select(F.col("word").alias(side), F.lit(True).alias(f"sure_{side}")), side, "left")
    two = two.filter("sure_low is null or sure_next is null").select(F.concat_ws(" ", "low", "next").alias("key"), "new")
    rest = v.filter((F.col("n") >= least_rest) & (F.length("word") >= 3)).select("word").join(split.filter("low = ''").select(F.col("next").alias("word")), "word", "left_anti")
    # "An" is taken off where three letters are left
    glued = F.array_compact(F.array(F.concat(F.lit("an"), "word"), F.when(~(F.startswith("word", F.lit("n")) & (F.length("word") >= 4)), F.concat(F.lit("a"), "word"))))
    starts = rest.select(F.explode(glued).alias("low"), F.col("word").alias("new")).join(vocabulary.filter("lower_seen").select(F.col("word").alias("low")), "low", "left_anti")
    return settled(led.union(two).union(starts.select(F.concat(F.lit("+"), "low").alias("key"), "new")), "damage")


def repaired(rows: DataFrame, key: str, text: str, vocabulary: DataFrame, least: int = 2, least_rest: int = 5) -> DataFrame:
    """(key, text) with words repaired. vocabulary: word, n, trusted, lower_seen.

    In order of precedence, each against the vocabulary: two neighbours that a ligature joins to a word seen ``least`` times, one of them untrusted; a word that
    is not trusted and that a ligature in front makes a word seen so often; a capitalised word at the start of a sentence that is "A" or "An" glued to a word seen ``least_rest``
    times, if the whole is never seen in lower case. Words in capitals and words that touch an apostrophe stay.
    """
    base = rows.select(F.col(key).alias("k"), normalised(F.col(text)).alias("t"))
    found = few(settled(_found(base, vocabulary, least, least_rest), "found"), 8 * ROW_BYTES)  # else texts are shuffled
    out = base.join(found, F.col("k").eqNullSafe(F.col("_k")), "left").select("k", mended("t", F.col("x.key"), F.col("x.new")).alias("t"))
    return out.select(F.col("k").alias(key), X.without_ligature_debris(F.col("t")).alias(text))


def changes(rows: DataFrame, key: str, text: str, vocabulary: DataFrame, least: int = 2, least_rest: int = 5) -> DataFrame:
    """(key, text), as ``repaired`` gives them, of every text that repair makes another one. Few are, so neither the others nor their records pass by a join."""
    base = rows.select(F.col(key).alias("k"), F.col(text).alias("was"), normalised(F.col(text)).alias("t"))
    base = settled(base.select("k", "t", X.without_ligature_debris(F.col("t")).eqNullSafe(F.col("was")).alias("same")), "normal")
    found = settled(_found(base, vocabulary, least, least_rest), "found")
    hit = base.join(found, F.col("k").eqNullSafe(F.col("_k"))).select("k", mended("t", F.col("x.key"), F.col("x.new")).alias("t"))
    rest = base.filter(~F.col("same")).join(found, F.col("k").eqNullSafe(F.col("_k")), "left_anti").select("k", "t")
    return hit.union(rest).select(F.col("k").alias(key), X.without_ligature_debris(F.col("t")).alias(text))


def _found(base: DataFrame, vocabulary: DataFrame, least: int, least_rest: int) -> DataFrame:
    """(_k, x): for texts (k, t) that hold something damaged, what it is and what becomes of it."""
    damage = damaged(vocabulary, least, least_rest)
    hits = base.select("k", F.explode(asking(damage)(F.col("t"))).alias("key")).join(few(damage), "key")
    return hits.groupBy(F.col("k").alias("_k")).agg(F.array_sort(F.collect_set(F.struct("key", "new"))).alias("x"))
