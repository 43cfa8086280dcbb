"""Nearest neighbours and WARC files."""

import glob
import gzip
import html
import math
import os
import re
import time

import numpy as np
import pytest

from qforge.llm import neighbours, warc
from qforge.llm.common import scratch

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1200, 16)).astype(np.float32)
    x[400:700] = x[0]  # a frequent vector: ties to the smaller id
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    odd = [(5000, None, ""), (5100, [0.0] * 16, ""), (5200, [math.nan] * 16, ""), (5300, [math.inf] + [1.0] * 15, ""), (5400, [1.0, 2.0], ""), (5500, [None] + [1.0] * 15, ""), (None, [1.0] * 16, ""), rows[7], (5600, [], "")]
    got = neighbours.search(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, list string")).toPandas()
    hit = n = 0
    for q in range(0, 1200, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(1200), d)) if i != q][:10]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11))
        assert np.allclose(mine["score"], d[mine["vec_id"]], rtol=1e-12)
        hit, n = hit + len(set(order) & set(mine["vec_id"])), n + 10
    assert hit / n >= 0.9
    assert got[got["query_id"] == 500]["vec_id"].tolist()[:3] == [0, 400, 401]
    assert set(got["query_id"]) == set(range(0, 1200, 100))
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_few_vectors(spark):
    got = neighbours.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 2), (0, 2, 1)]


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<html lang=de><title>T &amp; U</title><script>x<p></script><p>one\r\n\r\ntwo</p>three<a href='/l?a&amp;b'>four"), (2, None, None), (None, "u\r\nv", ""), (1, "http://a/", "é")], "page_id long, url string, html string")
    records = warc.responses(pages)
    derived = warc.derive(records)
    columns = ["warc_type", "record_id", "refers_to", "date", "content_type", "headers", "block_digest", "content_length", "block"]
    for file_bytes in (1, 1 << 20):
        path, other = scratch(spark, "warc"), scratch(spark, "warc")
        warc.write_warc(derived, path, file_bytes)
        warc.write_derivatives(pages, other, file_bytes=file_bytes)
        for p in (path, other):
            assert sorted(map(str, warc.read_warc(spark, p).select(columns).collect())) == sorted(map(str, derived.select(columns).collect()))
        files = sorted(glob.glob(f"{path}/part-*"))
        assert len(files) == derived.count() if file_bytes == 1 else len(files) <= derived.rdd.getNumPartitions()
        for f in files:
            with gzip.open(f) as g:  # other readers see one stream; it starts with warcinfo
                assert g.read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    got = {(r.refers_to, r.warc_type): r for r in derived.collect()}
    source = {r.record_id: r for r in records.collect()}
    assert {k[0] for k in got} == set(source) and len(got) == 8
    for (refers_to, kind), r in got.items():
        assert dict(r.headers)["WARC-Source-Payload-Digest"] == source[refers_to].payload_digest and r.block_digest == warc.digest(bytes(r.block))
        if kind == "metadata":
            assert f"conversion: {got[refers_to, 'conversion'].record_id}".encode() in bytes(r.block)
    one = next(r for r in records.collect() if b"html lang=de" in bytes(r.block))
    assert bytes(got[one.record_id, "conversion"].block).decode() == "T & U\none\ntwo\nthreefour"
    assert b"outlink: /l?a&b\r\n" in bytes(got[one.record_id, "metadata"].block) and b"language: de\r\n" in bytes(got[one.record_id, "metadata"].block)


def test_warc_damage_is_found():
    data = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <x>\r\nWARC-Date: d\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert next(warc.parse(gzip.decompress(gzip.compress(data))))[-1] == b"abc"
    for bad in (data[:-5], data.replace(b"Content-Length: 3", b"Content-Length: 2")):
        try:
            list(warc.parse(bad))
        except ValueError:
            continue
        raise AssertionError("damage went unseen")


def plain_page(page):
    """Text, title and links of a well-formed page, by substitution."""
    shown = re.sub(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->", " ", page)
    text = re.sub(r"(?i)</?(p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|title|blockquote|pre|hr)\b[^>]*>", "\n", shown)
    lines = [" ".join(x.split()) for x in html.unescape(re.sub(r"<[a-zA-Z/!?][^>]*>", "", text)).split("\n")]
    title = re.search(r"(?is)<title\b[^>]*>(.*?)</title\s*>", shown)
    links = [html.unescape(next(g for g in m if g)) for m in re.findall(r"(?i)<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]+)\"|'([^']+)'|([^\s>\"']+))", shown)]
    return "\n".join(x for x in lines if x), " ".join(html.unescape(title[1]).split()) if title else "", links


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_warc_of_all_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {}
    for r in warc.derive(warc.responses(pages)).collect():
        got.setdefault(r.refers_to, {})[r.warc_type] = r
    expected = []
    for r in pages.collect():
        text, title, links = plain_page(r.html or "")
        expected.append((r.url, text, *([f"title: {title}"] if title else []), *(f"outlink: {x}" for x in links)))
    mine = []
    for r in got.values():
        fields = bytes(r["metadata"].block).decode().split("\r\n")
        mine.append((r["metadata"].target_uri, bytes(r["conversion"].block).decode(), *(x for x in fields if x.startswith(("title: ", "outlink: ")))))
    assert sorted(mine, key=repr) == sorted(set(expected), key=repr)


@pytest.mark.parametrize("page", ["<a " * 2_000_000, "<title>" * 700_000, "<script>" * 700_000, "<" * 5_000_000, "<html " * 800_000 + ">", "<!--" * 1_200_000, "<a" + " href" * 1_000_000 + ">", "<title>" * 600_000 + "</title>", "<script>" + "</script " * 600_000])
def test_hostile_pages_take_seconds(page):
    began = time.process_time()
    warc.read_page(page)
    assert time.process_time() - began < 15


def test_no_page(spark):
    d = spark.createDataFrame([], "page_id long, url string, html string, block string, record_id string")
    assert warc.derivatives(d, scratch(spark, "warc")).count() == 0
    one = spark.createDataFrame([(1, "u", "<p>a" * 1_000_000, "b", "r")], d.schema)
    assert warc.derivatives(one, scratch(spark, "warc")).count() == 2


def test_one_id_with_several_vectors(spark):
    x = np.random.default_rng(8).standard_normal((300, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, x[5].tolist()), (7, (x[9] + 1).tolist()), (7, x[7].tolist())]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    best = {}
    for i, v in rows:
        best[i] = min(best.get(i, v), v)
    ids = np.array(sorted(best))
    v = np.array([best[i] for i in ids])
    for q in (0, 100, 200):
        mine = got[got["query_id"] == q].sort_values("rank")
        assert len(mine) == 10 and mine["vec_id"].is_unique and q not in set(mine["vec_id"])
        assert np.allclose(mine["score"], [np.linalg.norm(v[list(ids).index(i)] - best[q]) for i in mine["vec_id"]], rtol=1e-12)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_recall_on_embeddings(spark):
    table = spark.read.parquet(f"{LARGER}/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    got = neighbours.search(table).toPandas().groupby("query_id")["vec_id"].apply(set).to_dict()
    recall = []
    for at in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((v - v[at]) ** 2).sum(axis=1))
        order = [ids[i] for i in np.lexsort((ids, d)) if i != at][:10]
        recall.append(len(got[ids[at]] & set(order)) / len(order))
    assert len(got) == len(recall) and np.mean(recall) >= 0.9
