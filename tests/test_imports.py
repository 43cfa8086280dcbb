"""Readers, outside services and what imports leave behind."""

import json

from pyspark.sql import functions as F

from qforge.operators import imports
from qforge.sources import external, readers
from qforge.streaming import ingest


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\r\ntwo\n\nthree")
    (tmp_path / "b.json").write_text(json.dumps([{"id": 1}, {"id": 2}]))
    (tmp_path / "bad.json").write_text("[{")
    (tmp_path / "test3-questions.txt").write_text("1. q\nState\n2. r")
    assert [(r.line_no, r.line) for r in readers.text_lines(spark, str(tmp_path), "a.txt").orderBy("line_no").collect()] == [(1, "one"), (2, "two"), (3, ""), (4, "three")]
    assert sorted(r.id for r in readers.json_arrays(spark, str(tmp_path), "id int").collect() if r.id) == [1, 2]
    assert sorted(r.word for r in readers.word_list(spark, f"{tmp_path}/a.txt").collect()) == ["one", "three", "two"]
    assert readers.listing(spark, str(tmp_path), ".json").count() == 2
    assert {(r.test, r.portion, r.kind) for r in readers.practice_tests(spark, str(tmp_path)).filter("test is not null").collect() if r.kind} == {(3, "National", "questions"), (3, "State", "questions")}
    t = spark.createDataFrame([("application/pdf", "x"), (None, "a.PDF"), ("image/png", "y"), (None, "b.jpeg"), (None, "c.md")], "m string, n string").coalesce(1)
    assert [r.k for r in t.select(readers.file_kind(F.col("m"), F.col("n")).alias("k")).collect()] == ["pdf", "pdf", "image", "image", "text"]
    parts = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, None), (1, 4, " ")], "k int, o int, t string")
    assert readers.combined(parts, "k", "o", "t").first()["text"] == "a\n\nb"


def test_outside_services(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "boom")], "id int, q string")

    def call(q):
        if q == "boom":
            raise ValueError("no")
        return q.upper()

    got = {r.id: (r.reply, r.error) for r in external.asked(rows, "id", "q", call, at_once=2).collect()}
    assert got == {1: ("A", None), 2: (None, "no")}
    assert all(r.reply is None for r in external.asked(rows, "id", "q").collect())
    tries = []

    def flaky(_):
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError
        return "ok"

    assert external.retried(flaky, wait=0)("x") == "ok"
    r = spark.range(1).select(external.first_reply(F.lit(""), F.lit(None).cast("string"), F.lit("x")).alias("a"), external.without_reasoning(F.lit("<think>a\nb</think> c")).alias("b"), external.message(F.lit('{"choices":[{"message":{"content":"hi"}}]}')).alias("c")).first()
    assert tuple(r) == ("x", "c", "hi")


def test_imports(spark):
    bank = spark.createDataFrame([("a", "qa", True, "ready"), ("b", "qb", True, "ready")], "id string, question string, active boolean, reviewStatus string")
    chunks, rest = imports.to_chunks(bank, spark.createDataFrame([("a",)], "id string"))
    assert [tuple(r) for r in chunks.collect()] == [("chunk-a", "context", "qa")]
    assert sorted((r.id, r.active, r.reviewStatus) for r in rest.collect()) == [("a", False, "unresolved"), ("b", True, "ready")]
    s = spark.createDataFrame([(1, "pending"), (2, "approved"), (3, "pending")], "id int, status string")
    d = spark.createDataFrame([(1, "rejected"), (2, "rejected")], "id int, status string")
    assert {r.id: r.status for r in imports.decided(s, d).collect()} == {1: "rejected", 2: "approved", 3: "pending"}
    t = {n: spark.createDataFrame([(1,), (2,)], "topic_id int") for n in ("sessions", "questions", "chunks")}
    after = imports.reset(t, spark.createDataFrame([(1,)], "topic_id int"), "history")
    assert {n: x.count() for n, x in after.items()} == {"sessions": 1, "questions": 1, "chunks": 2}
    c = spark.createDataFrame([(1, 1, "Chapter 1:\n- Rivers\n2. rivers\nix. Lakes and ponds\nabc\nOutline\n* Taxes")], "k int, o int, t string")
    assert sorted((r.chapter, r.item) for r in imports.suggested_scope(c, "k", "o", "t").collect()) == [("Chapter 1", "Lakes and ponds"), ("Chapter 1", "Rivers"), ("Imported structure", "Taxes")]
    sizes = imports.settled_size(spark.createDataFrame([(1, 5), (2, 5)], "s int, question_count int"), spark.createDataFrame([(1,), (1,)], "s int"), "s")
    assert {r.s: r.question_count for r in sizes.collect()} == {1: 2, 2: 0}
    assert not imports.fully_audited(bank, F.col("id") == "a") and imports.fully_audited(bank, F.lit(True))
    m = spark.range(1).select(imports.summary_merged(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m")).first()["m"]
    assert m == {"a": "1", "b": "3"}


def test_stream_takes_each_file_once(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.createDataFrame([(1, "click")], "id int, kind string").coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    go = lambda: ingest.ingest(spark, src, schema, f"{tmp_path}/state", f"{tmp_path}/out", lambda s: s).count()
    assert go() == 1 and go() == 1
    spark.createDataFrame([(2, "click")], "id int, kind string").coalesce(1).write.mode("append").parquet(src)
    assert go() == 2
