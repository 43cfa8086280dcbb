"""License scans: exact phrases and fuzzy short notices.

A notice may occur with up to ``errors`` edits. Cut into errors + 1 seeds, at least one seed occurs unedited (pigeonhole). An
Aho-Corasick automaton over the seeds of all notices finds the seeds in one pass over a text; around each, the regex library's
bounded-error matching verifies the edits and gives the span.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Notice:
    """A short notice in normalised words, its label and the edits (of characters) it may have."""

    text: str
    label: str
    errors: int


NOTICES = (
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    Notice("under the mit license", "mit", 1),
    Notice("licensed under the mit license", "mit", 2),
    Notice("released under the mit license", "mit", 2),
    Notice("licensed under the apache license version 2", "apache-2", 3),
    Notice("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 7),
    Notice("gnu general public license", "gpl", 2),
    Notice("gnu lesser general public license", "lgpl", 2),
    Notice("mozilla public license", "mpl", 2),
    Notice("creative commons attribution noncommercial", "cc-by-nc", 3),
    Notice("creative commons attribution sharealike", "cc-by-sa", 3),
    Notice("this is free and unencumbered software released into the public domain", "unlicense", 5),
    Notice("all rights reserved", "all-rights-reserved", 1),
)

_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def normalise(text: str | None) -> bytes:
    """Lower-cased (A-Z) words, runs of ASCII letters, digits and non-ASCII characters, joined by one space."""
    return b" ".join((text or "").encode("utf-8", "replace").translate(_FOLD).split())


def word_starts(norm: bytes | str) -> np.ndarray:
    """Where each word of a normalised text starts."""
    codes = np.frombuffer(norm, np.uint8) if isinstance(norm, bytes) else np.frombuffer(norm.encode("utf-32-le"), "<u4")
    return np.concatenate([[0], np.flatnonzero(codes == 32) + 1])


def seeds_of(notice: Notice) -> list[tuple[int, str]]:
    """(offset, seed): errors + 1 pieces of near-equal length."""
    n, k = len(notice.text), notice.errors + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, notice.text[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Scanner:
    """Built once for each task from the phrases and notices."""

    def __init__(self, phrases: tuple[tuple[str, str], ...] = PHRASES, notices: tuple[Notice, ...] = NOTICES):
        import ahocorasick
        import regex

        self.phrases = [(p.encode(), re.compile(rb"(?<![^ ])(?=" + re.escape(p.encode()) + rb"(?![^ ]))"), label) for p, label in phrases]
        self.notices = notices
        self.patterns = [regex.compile(f"(?e)(?:{regex.escape(n.text)}){{e<={n.errors}}}") for n in notices]
        self.seeds = ahocorasick.Automaton()
        by_seed: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(notices):
            for offset, seed in seeds_of(n):
                by_seed.setdefault(seed, []).append((i, offset))
        for seed, places in by_seed.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()

    def places(self, norm: bytes) -> tuple[list[tuple[int, int, str]], list[str]]:
        """((first word, last word, label) of each phrase place, labels)."""
        out, starts = [], None
        for plain, pattern, label in self.phrases:
            if plain in norm:
                starts = word_starts(norm) if starts is None else starts
                at = np.searchsorted(starts, [m.start() for m in pattern.finditer(norm)])
                out += [(i, i + plain.count(b" "), label) for i in at.tolist()]
        return out, sorted({x[2] for x in out})

    def fuzzy(self, text: str) -> list[tuple[int, int, str, int, float]]:
        """(start, end, label, edits, similarity) in characters of the normalised text; of overlapping spans of a label the best."""
        # a seed puts the notice's start within `errors` of a place; places are taken in slots, so near seeds share one search
        regions: dict[tuple[int, int], None] = {}
        for end, (n, places) in self.seeds.iter(text):
            for i, offset in places:
                e = self.notices[i].errors
                regions[i, (end - n + 1 - offset) // (2 * e + 1)] = None
        found = []
        for i, slot in regions:
            notice = self.notices[i]
            width = 2 * notice.errors + 1
            start = slot * width
            lo, hi = max(0, start - notice.errors), min(len(text), start + width + len(notice.text) + 2 * notice.errors)
            if m := self.patterns[i].search(text, lo, hi):
                found.append((m.start(), m.end(), notice.label, sum(m.fuzzy_counts), 1 - sum(m.fuzzy_counts) / len(notice.text)))
        kept: list[tuple[int, int, str, int, float]] = []
        taken: dict[str, list[tuple[int, int]]] = {}  # of each label the spans kept so far, in order; none overlaps another
        for x in sorted(set(found), key=lambda x: (x[3], x[0] - x[1], x)):
            mine = taken.setdefault(x[2], [])
            at = bisect_left(mine, (x[1],))  # spans before ``at`` start before this one's end
            if not (at and mine[at - 1][1] > x[0]):
                insort(mine, (x[0], x[1]))
                kept.append(x)
        return sorted(kept)


COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first_word:long,last_word:long,label:string,edits:int>>"


def license_scan(docs: DataFrame, phrases: tuple[tuple[str, str], ...] = PHRASES, notices: tuple[Notice, ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` lists every place, exact ones with 0 edits, in words from 0 (last word included). score: 1 with an exact phrase, else the
    greatest 1 - edits / length of a notice, else 0. Null and empty texts have no words and no places. Rows that repeat give equal
    rows. An empty table gives no rows. Other columns are ignored. Texts are scanned whole; the time grows with the text and its seeds, not with their product.

    The fuzzy search covers ``notices``. Of the contract's phrases, "under the mit license" is one of them (one edit); "apache license version 2" is searched only behind "licensed
    under the", and "cc by nc" not at all: one edit makes other versions and licenses of them ("version 1", "cc by nd").
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(phrases, notices)
        for b in batches:
            rows = []
            for t in b["text"]:
                norm = normalise(t)
                places, base = scanner.places(norm)
                fuzzy = scanner.fuzzy(text := norm.decode("utf-8")) if norm else []
                spans = [(s, e, label, 0) for s, e, label in places]
                if fuzzy:
                    begin = word_starts(text)
                    first = np.searchsorted(begin, [s + (text[s : s + 1] == " ") for s, *_ in fuzzy], side="right") - 1
                    last = np.searchsorted(begin, [e - (text[e - 1 : e] == " ") for _, e, *_ in fuzzy]) - 1
                    spans += [(i, j, label, edits) for i, j, (_, _, label, edits, _) in zip(first.tolist(), last.tolist(), fuzzy, strict=True)]
                starts = [s for s, _, _ in places]
                rows.append((norm.count(b" ") + 1 if norm else 0, len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *(x[2] for x in fuzzy)})), 1.0 if places else max((x[4] for x in fuzzy), default=0.0), sorted(set(spans))))
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]).astype({"first_word": "Int64", "last_word": "Int64"})
            out["spans"] = [[dict(zip(("first_word", "last_word", "label", "edits"), x, strict=True)) for x in xs] for xs in out["spans"]]
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, COLUMNS)
