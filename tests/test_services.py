"""Outside services: deadlines and kills, pools, replies with many parts, pages read in columns, validated replies."""

import json
import os
import subprocess
import threading
import time

import pytest
from pyspark.sql import functions as F

from qforge.sources import external, pages


def alive(mark):
    return subprocess.run(["ps", "-eo", "stat,args"], capture_output=True, text=True).stdout.count(mark) - subprocess.run(["ps", "-eo", "stat,args"], capture_output=True, text=True).stdout.count("<defunct> " + mark)


def test_a_child_that_forks_and_hangs_is_killed_with_its_group(spark):
    mark = f"sleep 98{os.getpid()}"
    hang = external.command(["sh", "-c", f"{mark} & {mark} & wait; echo $0"], 1.5)
    began = time.time()
    with pytest.raises(TimeoutError, match="killed after 1.5 s"):
        hang("x")
    assert time.time() - began < 10 and alive(mark) == 0
    # what is left of the group after a good reply goes too
    assert external.command(["sh", "-c", f"{mark} >/dev/null & echo got $0"], 20)("it") == "got it\n" and alive(mark) == 0
    assert external.command(["cat"], 20, as_argument=False)("input") == "input"
    with pytest.raises(RuntimeError, match="code 3"):
        external.command(["sh", "-c", "exit 3"], 20)("x")
    rows = spark.createDataFrame([(1, "0"), (2, "30")], "id int, q string")
    got = {r.id: (r.reply, r.error) for r in external.asked(rows, "id", "q", external.command(["sh", "-c", "sleep $0; echo slept $0"], 3)).collect()}
    assert got[1] == ("slept 0\n", None) and got[2][0] is None and "killed" in got[2][1]


def test_a_callable_has_a_deadline_too():
    slow = external.within(lambda s: time.sleep(s) or "done", 0.5)
    assert slow(0) == "done"
    with pytest.raises(TimeoutError, match="within 0.5 s"):
        slow(5)
    with pytest.raises(ValueError):
        external.within(int, 5)("x")


def test_a_pool_keeps_order_and_bound_and_holds_its_input_back():
    lock, now, most, taken = threading.Lock(), 0, 0, 0

    def call(x):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(0.1)
        with lock:
            now -= 1
        if x == 7:
            raise ValueError("seven")
        return x * 2

    def source():
        nonlocal taken
        for i in range(48):
            taken += 1
            yield i

    began, got = time.time(), []
    for item, reply, error in external.pooled(source(), call, 8):
        got.append((item, reply, error))
        assert taken <= len(got) + 8
    assert [g[0] for g in got] == list(range(48)) and got[7] == (7, None, "seven") and got[8] == (8, 16, None)
    assert most == 8 and time.time() - began < 48 * 0.1 / 4


def test_calls_in_flight_in_a_task(spark):
    rows = spark.range(1, 33).select("id", F.col("id").cast("string").alias("q")).coalesce(1)
    took = {}
    for n in (1, 8):
        began = time.time()
        got = {r.id: r.reply for r in external.asked(rows, "id", "q", lambda q: time.sleep(0.15) or q, in_flight=n).collect()}
        took[n] = time.time() - began
        assert got == {i: str(i) for i in range(1, 33)}
    assert took[1] - took[8] > 2.5  # 4.8 s against 0.6 s and what a job takes


def image(*words):
    return bytearray(json.dumps([dict(zip(("line_id", "left", "right", "top", "bottom", "text"), w, strict=True)) for w in words]).encode())


def read(data):
    words = json.loads(data)
    if any(w["text"] == "broken" for w in words):
        raise ValueError("unreadable")
    return words


def crop(data, start, stop):
    """What lies right of start and left of stop, lines numbered anew, as an engine does that sees one column only."""
    return json.dumps([w for w in json.loads(data) if (start is None or w["left"] >= start) and (stop is None or w["right"] <= stop)]).encode()


def test_pages_of_documents(spark):
    """A two-column page is read as two crops, a banded one band by band; what the first engine can't read falls to the next; errors are told."""
    two = image(*[(i, x, x + 300.0, 40.0 * i, 40.0 * i + 20, f"{side}{i}") for i in range(4) for x, side in ((0.0, "left"), (500.0, "right"))])
    two = bytearray(json.dumps([w | {"line_id": w["line_id"] * 2 + (w["left"] > 0)} for w in json.loads(two)]).encode())
    one = image((0, 0.0, 800.0, 0.0, 20.0, "all along"), (1, 0.0, 800.0, 40.0, 60.0, "the page"))
    seen = image((0, 0.0, 800.0, 0.0, 20.0, "for the model"))
    broken = image((0, 0.0, 8.0, 0.0, 2.0, "broken"))
    docs = spark.createDataFrame([("d", bytearray(b"2")), ("e", bytearray(b"x"))], "doc string, content binary")

    def render(content):
        if content != b"2":
            raise ValueError("no document")
        return [two, one, seen, broken]

    sheets = pages.rendered(docs, "doc", "content", render)
    assert sorted((r.doc, r.page, r.error) for r in sheets.filter("error is not null").collect()) == [("e", None, "no document")]

    def vision(data):
        if b"for the model" not in data:
            raise ConnectionError("busy")
        return " said by the model "

    got = {r.page: (r.text, r.engine, r.error) for r in pages.page_texts(sheets.filter("error is null"), ["doc", "page"], read, crop, vision, in_flight=2).collect()}
    assert got == {1: ("left0\nleft1\nleft2\nleft3\nright0\nright1\nright2\nright3", "columns", None), 2: ("all along\nthe page", "bands", None), 3: ("said by the model", "vision", None), 4: ("", None, "unreadable")}
    plain = {r.page: r.text for r in pages.page_texts(sheets.filter("error is null"), ["doc", "page"], read, crop).collect()}
    assert plain[3] == "for the model"


def test_verifier_candidates(spark):
    o = [(x, x) for x in "ABCD"]
    rows = [(1, "q", o, [], False), (2, "q", o, ["A"], False), (3, "q", o[:3], [], False), (4, " ", o, [], False), (5, "q", o, [], True), (6, "q", [*o[:3], ("D", " ")], [], False), (7, "q", o, None, False)]
    df = spark.createDataFrame(rows, "id int, q string, o array<struct<id:string,text:string>>, labels array<string>, polluted boolean")
    assert sorted(r.id for r in external.candidates(df, F.col("q"), F.col("o"), F.col("labels"), F.col("polluted")).collect()) == [1, 7]


def test_replies_against_shapes(spark):
    from qforge.functions import schema as S

    shape = S.Record({"n": S.Whole(2, 10), "t": S.Text(1, 3), "b": S.Truth(optional=True), "l": S.Items(S.Text(), 1, 2, optional=True, nullable=True), "r": S.Record({"x": S.Whole()}, nullable=True, optional=True)}, strict=True)
    cases = {
        '{"n": 2, "t": "a"}': [],
        'so: {"n": 10.0, "t": "abc", "b": false, "l": null, "r": {"x": -5}} ok': [],
        '{"n": 1, "t": "", "l": []}': ["n: number under 2", "t: length under 1", "l: size under 1"],
        '{"n": 11, "t": "abcd", "l": ["a", "b", "c"], "b": null}': ["n: number over 10", "t: length over 3", "b: null", "l: size over 2"],
        '{"n": 2.5, "t": 1, "b": "true", "l": ["a", 2], "r": {"x": null}}': ["n: no whole number", "t: no text", "b: no truth value", "l[1]: no text", "r.x: null"],
        '{"t": "a", "r": [], "z": 1}': ["n: no value", "r: no object", "z: not known"],
        "nothing": [": no JSON"], "{broken": [": no JSON"], "{a}": [": no JSON"], "": [": no JSON"], None: [": no JSON"],
    }
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "id int, t string")
    got = {r.t: r.r for r in df.select("t", S.validated(F.col("t"), shape).alias("r")).collect()}
    for text, errors in cases.items():
        assert list(got[text]["errors"]) == errors, text
        assert (got[text]["value"] is None) == bool(errors)
    v = got['so: {"n": 10.0, "t": "abc", "b": false, "l": null, "r": {"x": -5}} ok']["value"]
    assert (v["n"], v["t"], v["b"], v["l"], v["r"]["x"]) == (10, "abc", False, None, -5)
    for shape in (S.TOPIC, S.FORMAT, S.SCOPE, S.QUESTIONS):
        assert spark.range(1).select(S.validated(F.lit("{}"), shape)["value"].alias("v")).dtypes[0][1] == S.ddl(shape).replace("`", "")
    good = '{"chapters": [{"title": "a", "items": [{"title": "b"}, {"title": "c", "details": "d", "more": 1}]}]}'
    (r,) = spark.range(1).select(S.validated(F.lit(good), S.SCOPE).alias("r")).first()
    assert r["errors"] == [] and [x["details"] for x in r["value"]["chapters"][0]["items"]] == [None, "d"]


def test_requests_name_the_fields_their_replies_have(spark):
    from qforge.functions import schema as S
    from qforge.operators import audits as A

    for build, shape in ((A.topic_prompt, S.TOPIC), (A.format_prompt, S.FORMAT), (A.scope_prompt, S.SCOPE)):
        text = spark.range(1).select(build(F.lit("Land law")).alias("t")).first()["t"]
        assert "Land law" in text and all(f'"{k}"' in text for k in shape.fields)
        assert spark.range(1).select(build(F.lit(None).cast("string")).alias("t")).first()["t"]


def test_first_match_of_many_titles(spark):
    """Against a plain search: short, empty, null and repeated titles, several alphabets, ties of order, a long text without a match."""
    import random

    from qforge.operators import scope

    r = random.Random(6)
    letters = "abcé😀 "
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(150)] + ["", None, "A" * 200_000, "xyz"]
    for k in range(3):
        titles = [(i, "".join(r.choice(letters) for _ in range(r.randrange(1 + k, 9))).upper() or "q", r.randrange(40)) for i in range(120)] + [(900, None, 0), (901, "aaaaab", 0)]
        titles += [(902, "", 7)] if k == 0 else []
        rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(4)
        items = spark.createDataFrame(titles, "item int, title string, n int")
        got = {x.id: x.matched for x in scope.first_match(rows, "id", F.col("t"), items, "item", "title", "n").collect()}
        for i, t in enumerate(texts):
            hits = [(n, str(j)) for j, x, n in titles if t is not None and x is not None and x.lower() in t.lower()]
            assert got[i] == (min(hits)[1] if hits else None), (t, got[i])
    assert all(x.matched is None for x in scope.first_match(rows, "id", F.col("t"), items.limit(0), "item", "title", "n").collect())


def test_a_classifier_is_asked_about_the_first_sections(spark):
    from qforge.operators import audits as A

    rows = [("d", i, f"Quiz {i}", "chapter_question", f"text {i}") for i in range(30)] + [("e", 1, "Quiz", "chapter_question", "text")]
    sections = spark.createDataFrame(rows, "doc_id string, start int, section string, source string, text string")

    def call(request):
        n = json.loads(request)["text"]
        if n.endswith("3"):
            raise TimeoutError("late")
        return f"saw {n}"

    told, counts = A.classified(sections, call, first=20, in_flight=3)
    assert {r.doc_id: (r.classified, r.failed) for r in counts.collect()} == {"d": (18, 2), "e": (1, 0)}
    got = {(r.doc_id, r.start): (r.reply, r.error) for r in told.collect()}
    assert len(got) == 21 and got["d", 3] == (None, "late") and got["d", 19] == ("saw text 19", None)


def test_sources_without_records_have_zeros(spark):
    from qforge.operators import analytics as A

    rows = spark.createDataFrame([("a", "ready", False, True), ("a", "needs_repair", True, False)], "source string, status string, again boolean, answered boolean")
    expected = spark.createDataFrame([("a",), ("b",)], "source string")
    got = {r.source: (r.total, r.ready, r.duplicates, r.unmatched, r.repair_debt_rate) for r in A.extraction_report(rows, F.col("status"), F.col("again"), F.col("answered"), "source", expected=expected).collect()}
    assert got == {"a": (2, 1, 1, 1, 0.5), "b": (0, 0, 0, 0, 0.0)}


def test_requests_are_answered_in_their_shapes(spark):
    from qforge.operators import audits as A

    rows = spark.createDataFrame([(1, "Land law"), (2, "Boats"), (3, "Nothing")], "id int, t string")

    def call(request):
        if "Nothing" in request:
            raise ConnectionError("refused")
        return '{"choicesCount": 4, "isMultiSelect": false, "rationale": "usual"}' if "Land" in request else 'Sure: {"choicesCount": 11, "isMultiSelect": false}'

    got = {r.id: (r.value and (r.value.choicesCount, r.value.isMultiSelect), list(r.errors)) for r in A.answered(rows, "id", F.col("t"), "format", call, in_flight=2).collect()}
    assert got == {1: ((4, False), []), 2: (None, ["choicesCount: number over 10", "rationale: no value"]), 3: (None, [": refused"])}
