"""Importance resampling against a plain version, and its cases of nulls, ties, repeats and widened brackets."""

import hashlib
import math
import re
import zlib

import pytest

from qforge.llm import importance
from tests.llm.fixtures import docs, empty, texts

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(rows, target, share=5, least=20):
    """(doc_id, n_features, weight, score, rank) of (id, text) rows."""
    s, t = [0] * 10_000, [0] * 10_000
    for _, x in rows:
        for b in features(x)[1]:
            s[b] += 1
    for x in target:
        for b in features(x)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10_000) / ((x + 1) * (sum(t) + 10_000)))) for x, y in zip(s, t, strict=True)]
    out = []
    for i, x in rows:
        n, f = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    pool = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(pool[: share * len(pool) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


TARGET = [texts()[1], "An item about w1 w2 w3", None, "", "Straße w17 w18"]


@pytest.mark.parametrize("share", [5, 50])
def test_against_plain(spark, share, monkeypatch):
    monkeypatch.setattr(importance, "SLICE", 64)
    table, target = docs(spark), spark.createDataFrame([(t, 1) for t in TARGET], "text string, score int")
    got = importance.importance(table, target, share=share).select("doc_id", "n_features", "weight", "score", "rank")
    assert got.dtypes == [("doc_id", "bigint"), *((c, "bigint") for c in ("n_features", "weight", "score", "rank"))]
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    want = plain([(r["doc_id"], r["text"]) for r in table.collect()], TARGET, share)
    assert rows == want
    drawn = importance.resampled(table, target, share=share)
    assert drawn.columns == table.columns
    assert sorted(str(r["doc_id"]) for r in drawn.collect()) == sorted(str(r[0]) for r in want if r[4])


def test_ranks_of_ties_and_missed_brackets(spark):
    """Equal scores go by id, equal ids by row; a bracket too narrow for the sketch's error is widened until it holds the cutoff."""
    table = spark.range(5000).selectExpr("id div 2 as doc_id", "id as text_hash", "if(id < 4900, 30L, 3L) as n_words", "id as n_features", "id as weight", "if(id % 3 = 0, 7L, id % 50) as score", "id as row")
    for share, error in ((5, 0.002), (5, 0.3), (60, 0.01), (100, 0.002), (0, 0.002)):
        got = {r["row"]: r["rank"] for r in importance.ranked(table, share=share, error=error).collect()}
        pool = sorted((r for r in table.collect() if r["n_words"] >= 20), key=lambda r: (-r["score"], r["doc_id"], r["row"]))
        want = {r["row"]: k + 1 for k, r in enumerate(pool[: share * len(pool) // 100])}
        assert len(got) == 5000
        assert {k: v for k, v in got.items() if v} == want


def test_a_wrong_sketch_is_found_out(spark, monkeypatch):
    """Exact counts outside reject a bracket that misses the cutoff on either side."""
    table = spark.range(1000).selectExpr("id as doc_id", "id as text_hash", "30L as n_words", "id as n_features", "id as weight", "id as score", "id as row")
    kind = type(table.stat)
    real = kind.approxQuantile
    for shift in (-400, 400):
        calls = []

        def off(self, col, at, error, shift=shift, calls=calls):
            calls.append(at)
            return [x + shift for x in real(self, col, at, error)] if len(calls) == 1 else real(self, col, at, error)

        monkeypatch.setattr(kind, "approxQuantile", off)
        got = importance.ranked(table, share=50, error=0.001)
        assert sorted((r["rank"], r["doc_id"]) for r in got.collect() if r["rank"]) == [(k + 1, 999 - k) for k in range(500)]
        assert len(calls) > 1


def test_empty_tables(spark):
    none = empty(spark)
    assert importance.importance(none, none).collect() == []
    got = importance.importance(docs(spark), none).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain([(r["doc_id"], r["text"]) for r in docs(spark).collect()], [])


def test_very_long_words_and_texts():
    for text in ("x" * 3_000_000, "ab " * 800_000, " ." * 500_000, "é" * 1_200_000 + " b c"):
        n, f = features(text)
        parts = list(importance.slices(text))
        assert sum(p[0] for p in parts) == n
        assert sorted(x for p in parts for x in p[1].tolist()) == sorted(f)


def test_slices_of_any_size(monkeypatch):
    for size in (1, 7, 50, 1000):
        monkeypatch.setattr(importance, "SLICE", size)
        for text in texts()[::5]:
            n, f = features(text)
            parts = list(importance.slices(text))
            assert (sum(p[0] for p in parts), sorted(x for p in parts for x in p[1].tolist())) == (n, sorted(f))
