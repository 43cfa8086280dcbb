"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed character n-grams (1 to 3 letters, word edges marked). Each language has several centroids,
from spherical k-means over its training vectors; a text takes the language of the centroid with the greatest cosine. It is rejected if that
cosine is lower than almost all training texts of the language had (distance-based rejection).

The model is fitted on a bounded sample of labelled rows: at most FIT_DOCS in all, shared evenly by the languages, drawn by hash of the id. It is a few
arrays, of languages x CENTROIDS x DIMENSIONS; every document is then scored whole, in its own task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qforge.llm.common import kept_by

DIMENSIONS = 1 << 14
CENTROIDS = 4
FIT_DOCS = 1200
HOLD_OUT, HELD = 4, 2
UNKNOWN = "und"
#: A text is rejected below this share of the cosine that only one training text of its language in a hundred falls short of.
REJECT_SHARE = 0.5
#: Letters and word edges from which a text is held to the whole of that threshold.
SURE_LETTERS = 256
PIECE = 1 << 18
SEED = 7

_TABLE: list[np.ndarray] = []


def letters_table() -> np.ndarray:
    """Code point to its lower-case letter, or to a space if it is no letter; built once for each Python worker."""
    if not _TABLE:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(len(table)):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _TABLE.append(table)
    return _TABLE[0]


def counts(text: str | None) -> np.ndarray | None:
    """How often each hashed n-gram occurs in the whole text; None if it has no letter."""
    if not text:
        return None
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    out, found = np.zeros(DIMENSIONS, dtype=np.int64), False
    for s in range(0, len(points), PIECE):  # pieces overlap by the two code points that an n-gram looks ahead
        c = letters_table()[points[s : s + PIECE + 2]]
        if not (c != 32).any():
            continue
        found = True
        c = np.concatenate([[32], c, [32]]).astype(np.uint32)
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]  # one space between words
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
        for h in (c * np.uint32(0x165667B1), two, three):
            out += np.bincount(h >> np.uint32(18), minlength=DIMENSIONS)
    return out if found else None


def vector(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(count).astype(np.float32) * idf
    return v / max(float(np.linalg.norm(v)), 1e-12)


@dataclass
class Model:
    """languages, and for each centroid its language's number; least: the cosine below which a text of the language is rejected."""

    languages: list[str]
    centroids: np.ndarray
    owner: np.ndarray
    idf: np.ndarray
    least: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected); no letter, or no model: (und, 0, True)."""
        count = counts(text)
        if count is None or not self.languages:
            return UNKNOWN, 0.0, True
        near = self.centroids @ vector(count, self.idf)
        at = int(near.argmax())
        score = float(min(1.0, max(0.0, near[at])))
        # a short text shares few n-grams with any centroid: less is asked of it, in proportion
        sure = min(1.0, float(count.sum()) / (3 * SURE_LETTERS))
        return self.languages[self.owner[at]], score, score < sure * self.least[self.owner[at]]


def _clusters(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means."""
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(12):
        own = (x @ centres.T).argmax(axis=1)
        for j in range(len(centres)):
            if (mine := own == j).any():
                c = x[mine].sum(axis=0)
                centres[j] = c / max(float(np.linalg.norm(c)), 1e-12)
    return centres


def fit(training: DataFrame, fit_docs: int = FIT_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a sample of rows with a language and a letter: about ``fit_docs`` in all, with equal shares for the languages."""
    rows = training.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(fit_docs).collect()}
    if not sizes:
        return Model([], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, np.int64), np.ones(DIMENSIONS, np.float32), np.zeros(0))
    each = max(1, fit_docs // len(sizes))
    # a share of each language's ids by hash, without sorting them; a quarter more than wanted, cut to size afterwards
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1_000_000))
    wanted = F.lit(False)
    for lang, n in sizes.items():
        wanted = wanted | ((F.col("lang") == lang) & (draw < max(1, int(1_000_000 * min(1.0, 1.25 * each / n + 8 / n)))))

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept_by("langid")
        for b in batches:
            got = [(lang, d, counts(t)) for lang, d, t in zip(b["lang"], b["draw"], b["text"], strict=True)]
            got = [(lang, d, (at := np.flatnonzero(c)).astype("<u2").tobytes(), c[at].astype("<u4").tobytes()) for lang, d, c in got if c is not None]
            yield pd.DataFrame(got, columns=["lang", "draw", "at", "n"])

    got = rows.withColumn("draw", draw).filter(wanted).select("lang", "draw", "text").mapInPandas(sparse, "lang string, draw long, at binary, n binary").toPandas()
    got = got.sort_values(["lang", "draw", "at", "n"]).groupby("lang", sort=True).head(each)
    x = np.zeros((len(got), DIMENSIONS), dtype=np.float32)
    for i, (at, n) in enumerate(zip(got["at"], got["n"], strict=True)):
        x[i, np.frombuffer(at, "<u2")] = np.frombuffer(n, "<u4")
    idf = (np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))) + 1).astype(np.float32)
    for row in x:  # in place: the driver holds the sample once
        row[:] = vector(row, idf)
    langs, rng = got["lang"].to_numpy(), np.random.default_rng(SEED)
    languages = sorted(set(langs))
    centres = [_clusters(x[langs == lang], CENTROIDS, rng) for lang in languages]
    least = np.array([REJECT_SHARE * np.quantile((x[langs == lang] @ c.T).max(axis=1), 0.01) for lang, c in zip(languages, centres, strict=True)])
    return Model(languages, np.concatenate(centres) if centres else np.zeros((0, DIMENSIONS), np.float32), np.repeat(np.arange(len(languages)), [len(c) for c in centres]), idf, least)


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(HOLD_OUT)) == HELD


def trained(docs: DataFrame) -> Model:
    """The model of all documents that are not held out."""
    return fit(docs.filter(~F.coalesce(held_out(), F.lit(False))))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, held_out, lang_pred, score, rejected.

    Null texts and texts without a letter are ``und`` with score 0, and rejected. A rejected text with letters keeps its nearest language.
    held_out is false for a null id. Only the text is an input of a prediction; rows that repeat give equal rows; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [model.predict(t) for t in b["text"]]
            out = pd.DataFrame(got, columns=["lang_pred", "score", "rejected"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return own.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, with all their columns, that are not rejected.

    Null texts, blank ones and ones without a letter are rejected; so is everything if nothing was learned. Rows that repeat stay as often as they occur.
    """

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        kept_by("langid")
        return pd.Series([not model.predict(t)[2] for t in texts], dtype=bool)

    return docs.filter(accepted("text"))


def predicted(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, then predict all: one row per document row, as ``identify`` gives them.

    Without a labelled document nothing is learned and all are ``und``, score 0. An empty table gives no rows. Other columns are ignored.
    """
    return identify(docs, trained(docs))
