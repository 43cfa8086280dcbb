"""Operators on small literal inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from qforge.functions import text as X
from qforge.operators import analytics as A
from qforge.operators import bank as B
from qforge.operators import layout, lines, near_duplicates, parse, practice, repair_engine, repair_text, sampling, scope, verdicts, vocabulary
from qforge.storage import settled


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_weak_subtopics(spark):
    rows = [(["Alpha"], False), (["Alpha"], False), (["Alpha"], True), (["Beta"], False), (["Beta"], True), (None, False)]
    got = A.by_weakness(A.weak_subtopics(spark.createDataFrame(rows, "tags array<string>, ok boolean"), F.col("tags"), F.col("ok") == False)).collect()  # noqa: E712
    assert [tuple(r) for r in got] == [("Alpha", 2, 3, 67), ("Beta", 1, 2, 50)]


def test_scores(spark):
    rows = [(1, [0], [0]), (1, [1, 2], [2, 1]), (1, [1], [1, 1]), (1, [3], None)]
    got = A.session_scores(spark.createDataFrame(rows, "s int, c array<int>, g array<int>"), "s", F.col("c"), F.col("g")).collect()
    assert [tuple(r) for r in got] == [(1, 4, 2, 50)]
    assert A.session_scores(spark.createDataFrame([], "s int, c array<int>, g array<int>"), "s", F.col("c"), F.col("g")).count() == 0


def test_missed_needs_a_wrong_answer_in_scope(spark):
    rows = [(1, False, False, "a"), (2, None, False, "a"), (3, False, True, "a"), (4, False, False, "z"), (5, False, False, None), (6, True, False, "a")]
    t = spark.createDataFrame(rows, "id int, ok boolean, flag boolean, s string")
    got = A.missed(t, F.col("ok"), F.col("flag"), F.col("s"), spark.createDataFrame([("a",), ("b",)], "scope_id string"))
    assert sorted(r.id for r in got.collect()) == [1, 5]


def test_history_pages(spark):
    t = spark.createDataFrame([(i, None if i == 7 else f"2024-01-0{i % 3 + 1}") for i in range(8)], "id int, at string")
    assert [r.id for r in A.history_page(t, "at", "id", 1, 5).collect()] == [2, 5, 1, 4, 0]
    assert [r.id for r in A.history_page(t, "at", "id", 2, 5).collect()] == [3, 6]
    assert A.history_total(t, "at").first()["total"] == 7


def test_summary_of_nothing_has_rates_of_zero(spark):
    t = spark.createDataFrame([], "s string")
    r = A.status_summary(t, F.col("s")).first()
    assert (r.total, r.manual_review_rate, r.repair_debt_rate) == (0, 0.0, 0.0)


def test_published_rates(spark):
    rows = [("ready",)] * 451 + [("needs_repair",)] * 116 + [("needs_user_review",)] * 27
    r = A.status_summary(spark.createDataFrame(rows, "s string"), F.col("s")).first()
    assert (r.total, r.manual_review_rate, r.repair_debt_rate) == (594, 0.0455, 0.1953)


def test_content_hash_ignores_case_ends_and_punctuation(spark):
    h = lambda s: one(spark, X.content_hash(F.lit(s)))
    assert h("What is it?") == h("  what IS it ") == h("What is it") != h("What was it?")


@pytest.mark.parametrize(("a", "b", "agree"), [("", "x", True), ("the landlord", "the landlord of the house", True), ("abc", "abcd", False), ("pay in 4 weeks", "pay 4 weeks", True), ("yes", "no", False)])
def test_answers_agree(spark, a, b, agree):
    assert one(spark, X.answers_agree(X.folded(F.lit(a)), X.folded(F.lit(b)), F.lit(a), F.lit(b))) is agree


def test_insert_and_replace(spark):
    bank = lambda *r: spark.createDataFrame([(h, i, a) for i, (h, a) in enumerate(r)], "h string, seq int, active boolean")
    new = spark.createDataFrame([(h, i) for i, h in enumerate(["b", "c", "d", "b"])], "h string, seq int")
    assert sorted(r.h for r in B.insert_ignoring_conflicts(bank(("b", True)).drop("active"), new, "h", "seq").collect()) == ["c", "d"]
    rows, counts = B.replace_bank(bank(("a", True), ("b", True), ("c", True)), new, "h", "active", "seq")
    assert sorted((r.h, r.active) for r in rows.collect()) == [("b", True), ("c", True), ("d", True)]
    assert tuple(counts.first()) == (3, 0, 3, 0)
    rows, counts = B.replace_bank(bank(("keep", True), ("drop", False), ("d", False)), new, "h", "active", "seq")
    assert sorted((r.h, r.active) for r in rows.collect()) == [("b", True), ("c", True), ("d", True), ("drop", False)]
    assert tuple(counts.first()) == (1, 1, 3, 1)  # an excluded row that comes in again comes in active


def test_repairs_that_do_not_fit_are_told(spark):
    bank = spark.createDataFrame([("a", "f1", "x"), ("b", "f2", "x"), ("c", "f3", "x")], "id string, f string, q string")
    fix = spark.createDataFrame([("a", "f1", "new"), ("b", "old", "new"), ("z", "f", "new"), ("c", "f3", "1"), ("c", "f3", "2")], "id string, f string, q string")
    rows, problems = B.apply_repairs(bank, fix, "id", "f", "q")
    assert sorted((r.id, r.q) for r in rows.collect()) == [("a", "new"), ("b", "x"), ("c", "x")]
    assert sorted(tuple(r) for r in problems.collect()) == [("b", "stale"), ("c", "repeated"), ("z", "missing")]


def test_cascades(spark):
    child, parent = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id int, p int"), spark.createDataFrame([(1,)], "id int")
    assert sorted(r.id for r in B.cascade(child, parent, "p", "id").collect()) == [1, 3]
    assert sorted((r.id, r.p or 0) for r in B.cascade(child, parent, "p", "id", "set null").collect()) == [(1, 1), (2, 0), (3, 0)]


def test_audit_outcome(spark):
    rows = [("needs_repair", True, True, True, "correct", False, True, True), ("ready", False, None, None, None, False, True, None), ("ready", True, True, False, "correct", False, True, True), ("ready", True, True, True, "unsure", False, True, True), ("ready", True, True, True, "wrong", True, True, True), ("ready", True, True, True, "correct", False, True, False), ("ready", True, True, True, "correct", False, True, None)]
    t = spark.createDataFrame(rows, "s string, a boolean, c boolean, o boolean, k string, v boolean, e boolean, m boolean").coalesce(1)
    got = [r.x for r in t.select(B.audit_outcome(*[F.col(c) for c in "sacokvem"]).alias("x")).collect()]
    assert got == ["not_servable", "unaudited", "structure", "key_disputed", "clean", "explanation_dropped", "clean"]


def test_demotion(spark):
    options = F.array(*[F.struct(F.lit(x).alias("id")) for x in "AB"])
    go = lambda *i: one(spark, B.demoted(F.lit("ready"), F.array(*map(F.lit, i)).cast("array<int>"), options))
    assert go(1) == "ready" and go() == go(2) == go(-1) == "needs_user_review"


@pytest.mark.parametrize(("ids", "n", "quotas"), [("abc", 10, [3, 3, 4]), ("ab", 5, [2, 3]), ("abc", 4, [1, 1, 2]), ("abc", 2, [1, 1]), ("abc", 0, [])])
def test_scope_plan(spark, ids, n, quotas):
    assert sorted(r.quota for r in sampling.scope_plan(spark.createDataFrame([(i,) for i in ids], "item string"), "item", n).collect()) == quotas


def test_scope_filter_falls_back(spark):
    t = spark.createDataFrame([("a", "Alpha"), ("beta", "B"), ("c", "Gamma")], "id string, title string")
    assert sorted(r.id for r in sampling.filtered_scope(t, "id", "title", ["BETA", "gamma"]).collect()) == ["beta", "c"]
    assert sampling.filtered_scope(t, "id", "title", ["none"]).count() == 3


def test_stratified_sample(spark):
    pool = lambda a, b: spark.createDataFrame([(i, "a") for i in range(a)] + [(100 + i, "b") for i in range(b)], "id int, s string")
    plan = lambda **q: spark.createDataFrame(list(q.items()), "item string, quota long")
    got = sampling.stratified_sample(pool(30, 30), "id", "s", plan(a=5, b=5), "item", 10).collect()
    assert sorted(r.s for r in got) == ["a"] * 5 + ["b"] * 5
    got = sampling.stratified_sample(pool(20, 5), "id", "s", plan(a=1, b=1, c=8), "item", 10).collect()
    assert len({r.id for r in got}) == 10


def test_known_words(spark):
    t = spark.createDataFrame([(w,) for w in ["payments", "fuing", "parties", "loan", "making"]], "word string")
    known = vocabulary.known(t, spark.createDataFrame([("payment",), ("fu",), ("party",), ("loan",), ("make",)], "word string"))
    assert sorted(r.word for r in known.collect()) == ["loan", "making", "parties", "payments"]


def test_garble(spark):
    docs = spark.createDataFrame([(1, "the xqzt of zzkw"), (2, "the house of Qwxy Zzyx"), (3, "common blorp"), (4, "common blorp blip")], "id int, t string")
    got = vocabulary.garbled(docs, "id", F.col("t"), docs, X.letter_words(F.col("t")), spark.createDataFrame([("house",)], "word string"))
    assert [tuple(r) for r in got.collect()] == [(1, 2)]


QUESTIONS = [
    (1, "What right does an owner of land beside a river hold", ["Riparian rights", "Littoral rights", "Avulsion claims", "Reliction claims"]),
    (2, "What right does the owner of land beside a river hold", ["Riparian rights", "Littoral rights", "Avulsion claims", "Reliction claims."]),
    (3, "Which claim arises when land is lost by sudden force", ["Riparian rights", "Littoral rights", "Avulsion claims", "Reliction claims"]),
    (4, "What right does an owner of land beside a river hold", ["One", "Two", "Three", "Four"]),
    (5, "owner of land beside a river hold", ["Riparian rights", "Littoral rights", "Avulsion claims", "Reliction garbage here"]),
]


def test_near_duplicates(spark):
    t = spark.createDataFrame(QUESTIONS + [(6, *QUESTIONS[0][1:])], "id int, q string, o array<string>")
    got = {r.id: r.cluster for r in near_duplicates.groups(near_duplicates.features(t, "id", F.col("q"), F.col("o"))).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1, 6: 1}


def test_near_duplicates_match_brute_force(spark):
    import random

    r = random.Random(1)
    words = [f"word{i}" for i in range(12)]
    rows = [(i, " ".join(r.sample(words, 8)), [f"option {r.randrange(6)}" for _ in range(4)]) for i in range(150)]
    got = {x.id: x.cluster for x in near_duplicates.groups(near_duplicates.features(spark.createDataFrame(rows, "id int, q string, o array<string>"), "id", F.col("q"), F.col("o"))).collect()}

    def same(a, b):
        (_, p, x), (_, q, y) = a, b
        shared = sum(min(x.count(o), y.count(o)) for o in set(x))
        p, q = set(p.split()), set(q.split())
        j, c = len(p & q) / len(p | q), len(p & q) / min(len(p), len(q))
        return shared >= 4 and j >= 0.6 or shared >= 3 and c >= 0.7 or shared >= 2 and j >= 0.8

    label = list(range(150))
    for a in rows:
        for b in rows:
            if a[0] < b[0] and label[a[0]] != label[b[0]] and same(a, b):
                old, new = max(label[a[0]], label[b[0]]), min(label[a[0]], label[b[0]])
                label = [new if x == old else x for x in label]
    assert got == dict(enumerate(label)) and len(set(label)) < 150


def test_survivor_and_conflict(spark):
    rows = [(1, 1, 1, "abc", "abc", True), (1, 2, 0, "abc", "abc", True), (2, 3, 0, "yes", "yes", True), (2, 4, 0, "no", "no", False), (3, 5, 0, "yes", "yes", True), (3, 6, 0, "no", "no", True)]
    t = spark.createDataFrame(rows, "cluster int, id int, flags int, k string, t string, passes boolean")
    best = near_duplicates.survivors(t, "cluster", F.col("flags"), F.col("id"))
    assert sorted((r.cluster, r.id, r.removed) for r in best.collect()) == [(1, 2, 1), (2, 3, 1), (3, 5, 1)]
    assert [r.cluster for r in near_duplicates.conflicts(t, "cluster", best, "k", "t", "passes").collect()] == [3]


def test_scope_algebra(spark):
    t = lambda *x: spark.createDataFrame([(i,) for i in x], "item string")
    assert sorted(tuple(r) for r in scope.frozen(t("a", "b", "c"), t("c", "d"), t("a", "d"), "item").collect()) == [("a", True), ("c", False), ("d", False)]
    assert sorted(tuple(r) for r in scope.merged(t("Alpha", "Beta"), t(" alpha ", "Gamma"), "item").collect()) == [("Alpha", "current"), ("Beta", "current"), ("Gamma", "suggested")]


QUIZ = """Chapter 1: Water Rights
Chapter Quiz
1. Which right applies to rivers?
A. Littoral
B. Riparian
and more
C. Avulsion
D. Reliction
Answer Key
1. B. Riparian rights apply.
They follow rivers. 2. C next one
Sample Questions
What does a deed need most of all?
A. Ink
B. A grantor
C. Paper
D. A seal
B. The grantor has to sign.
And so on.
Which fee is the largest there is today?
A. One
B. Two
C. Three
D. Four
Sample Exam I
7. Which exam question is this one here?
A. First
B. Second
C. Third
D. Fourth
Answer Key
7. D
"""


def test_question_parser(spark):
    got = {r.prompt: r for r in repair_engine.records(spark.createDataFrame([(1, QUIZ), (2, None), (3, "nothing\nhere")], "doc_id int, text string")).collect()}
    r = got["Which right applies to rivers?"]
    assert (r.source, r.label, list(r.correct), r.status, r.chapter.number, r.options[1].text) == ("chapter_question", "B", [1], "ready", 1, "Riparian and more")
    assert r.explanation.startswith("Riparian rights apply. They follow rivers.") or r.explanation == "Riparian rights apply."
    r = got["What does a deed need most of all?"]
    assert (r.source, r.label, r.explanation) == ("example_question", "B", "The grantor has to sign. And so on.")
    r = got["Which fee is the largest there is today?"]
    assert (r.label, r.status) == ("C", "ready")  # its number is in the chapter's key
    r = got["Which exam question is this one here?"]
    assert (r.source, r.label, r.context) == ("exam_question", "D", "exam:1")
    assert len(got) == 4


def test_repairs(spark):
    r = one(spark, parse.resegmented(F.lit("Which one is it? A. red B. green C. blue D. white")))
    assert r.prompt == "Which one is it?" and [tuple(o) for o in r.options] == [("A", "red"), ("B", "green"), ("C", "blue"), ("D", "white")]
    assert one(spark, parse.resegmented(F.lit("See B. green C. blue"))) is None
    r = one(spark, parse.merged_question(F.lit("Who signs the deed? 12. Who pays the tax?"), F.lit(11)))
    assert tuple(r) == ("Who signs the deed?", 12, "Who pays the tax?", True)
    assert not one(spark, parse.merged_question(F.lit("Who signs the deed? 12. Who pays?"), F.lit(12))).fits
    assert one(spark, parse.trimmed_option(F.lit("the owner. B. the agent"))) == "the owner."
    assert one(spark, parse.trimmed_option(F.lit("the owner 12. Which"))) == "the owner"
    options = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(t).alias("text")) for i, t in (("A", "the tenant pays"), ("B", "the owner pays taxes"))])
    assert one(spark, parse.label_by_overlap(F.lit("Because the owner always pays his taxes"), options)) == "B"
    assert one(spark, parse.label_by_overlap(F.lit("nothing"), options)) is None


def test_practice_parsers(spark):
    text = "1. What is due?\nA. Rent\n=====\nCc. 4 times\n2. Which? A. x 3. How long must it be?\n4. Pick:\nA.\nB.\nC.\nD.\none\ntwo\nthree\nfour"
    got = {r.number: r for r in parse.practice_questions(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()}
    assert [tuple(o) for o in got[1].options] == [("A", "Rent"), ("C", "4 times")]
    assert got[3].prompt == "How long must it be?"
    assert [tuple(o) for o in got[4].options] == [("A", "one"), ("B", "two"), ("C", "three"), ("D", "four")]
    keys = "18.  C)A date\n22.\nD) 1 year\n29. __D) Agency\n67. 8B) x\n33. A)$0\nmore\n25. no letter"
    got = {r.number: (r.label, r.explanation) for r in parse.practice_answers(spark.createDataFrame([(1, keys)], "doc_id int, text string")).collect()}
    assert got == {18: ("C", "A date"), 22: ("D", "1 year"), 29: ("D", "Agency"), 67: ("B", "x"), 33: ("A", "$0 more"), 25: (None, "no letter")}


def test_lines(spark):
    docs = spark.createDataFrame([(1, "first paragraph that is long enough\nsecond line\n\nshort\n \nlast paragraph that is long enough too")], "doc_id int, text string")
    assert [(r.line_start, r.line_end) for r in lines.paragraphs(docs).orderBy("line_start").collect()] == [(1, 2), (6, 6)]
    ranges = spark.createDataFrame([(1, 2, 4)], "doc_id int, start int, stop int")
    assert [r.line_start for r in lines.outside(lines.paragraphs(docs), ranges, "doc_id").collect()] == [6]


def test_layout(spark):
    page = "\n".join(["Header that runs over the whole width of this page"] + [f"left text {i:02d}            right text {i:02d}" for i in range(8)] + ["Footer that runs over the whole width of this page"])
    plain = "one\ntwo\nthree\nfour"
    got = {r.page: r for r in layout.ordered_pages(spark.createDataFrame([(1, page), (2, plain), (3, None)], "page int, text string")).collect()}
    order = got[1].text.split("\n")
    assert order[0].startswith("Header") and order[-1].startswith("Footer") and order[1:9] == [f"left text {i:02d}" for i in range(8)] and order[9:17] == [f"right text {i:02d}" for i in range(8)]
    assert got[2].text == plain and not got[2].two_columns and got[3].text == ""


def _boxes(spark, rows):
    return spark.createDataFrame([(1, i, float(x), float(y), float(x + w), float(y + 10), t) for i, x, y, w, t in rows], "page int, line_id string, left double, top double, right double, bottom double, text string")


def test_word_boxes(spark):
    tsv = "level\tpage\n" + "\n".join(["5\t1\t1\t1\t1\t1\t10\t20\t30\t8\t96\tHello", "4\t1\t1\t1\t1\t1\t10\t20\t30\t8\t96\tline", "5\t1\t1\t1\t1\t2\t50\t20\t30\t8\t-1\tbad", "5\t1\t1\t1\t1\t3\t50\t20\tx\t8\t90\tbad", "5\t1\t1\t1\t1\t4\t50\t20\t9\t8\t90\t "])
    got = layout.word_boxes(spark.createDataFrame([(1, tsv)], "page int, tsv string"), "page").collect()
    assert [tuple(r) for r in got] == [(1, "1:1:1:1", 10.0, 20.0, 40.0, 28.0, "Hello")]


def test_column_split_and_orders(spark):
    two = [(f"l{i}", 0, 20 * i, 400, f"L{i}") for i in range(8)] + [(f"r{i}", 600, 20 * i, 400, f"R{i}") for i in range(8)]
    assert layout.column_split(_boxes(spark, two), "page").first()["split"] == 500
    assert layout.column_split(_boxes(spark, two + [("x", 100, 300, 800, "spans")]), "page").first()["split"] is None
    assert layout.column_major(_boxes(spark, two), "page").first()["text"].split("\n") == [f"L{i}" for i in range(8)] + [f"R{i}" for i in range(8)]
    mixed = [("b", 0, 0, 1000, "Body")] + [(f"m{i}", 0, 40 + 20 * i, 400, f"L{i}") for i in range(6)] + [(f"m{i}", 600, 40 + 20 * i, 400, f"R{i}") for i in range(6)]
    assert layout.banded(_boxes(spark, mixed), "page").first()["text"].split("\n") == ["Body", *[f"L{i}" for i in range(6)], *[f"R{i}" for i in range(6)]]


VOCABULARY = "agent duties include the following defined defined branch office office manage today loan by law firm firm final final first first hired a and offer listing listing listing listing listing writes an is as in of influenced influenced"


def test_text_repair(spark):
    v = vocabulary.vocabulary(spark.createDataFrame([(VOCABULARY,)], "t string"), F.col("t"), F.lit(True))
    cases = {
        "A quitclaim deed conveys：": "A quitclaim deed conveys:",
        "（11. A 17-year-old purchased a house.": "A 17-year-old purchased a house.",
        "Alisting agent writes an offer": "A listing agent writes an offer",
        "Agent duties include the following": "Agent duties include the following",
        "a loan de ned by law": "a loan defined by law",
        "manage a branch of ce today": "manage a branch office today",
        "the rm hired a nal agent and a rst offer": "the firm hired a final agent and a first offer",
        "is in uenced": "is influenced",
        "": "",
    }
    rows = list(enumerate(cases))
    got = {r.id: r.t for r in repair_text.repaired(spark.createDataFrame(rows, "id int, t string"), "id", "t", v).collect()}
    assert {c: got[i] for i, c in rows} == cases


@pytest.mark.parametrize(("output", "n"), [('[{"n":1,"complete":true,"optionsClean":true,"keyVerdict":"correct"},{"n":2,"complete":true,"optionsClean":false,"keyVerdict":"unsure"}]', 2), ('x [{"n":1,"complete":true,"optionsClean":true,"keyVerdict":"correct","issues":["} ]"]},{"n":2,"comp', 1), ('[{"n":2,"complete":true,"optionsClean":true,"keyVerdict":"correct"}]', 0), ('[{"n":1,"complete":"yes","optionsClean":true,"keyVerdict":"correct"}]', 0), ("nothing", 0), ("", 0), (None, 0), ("[[1]]", 0)])
def test_verdict_reader(spark, output, n):
    assert len(verdicts.leading(output, 5)) == n


def test_verdict_rows(spark):
    out = '[{"n":1,"complete":true,"optionsClean":true,"keyVerdict":"wrong","modelAnswer":"E","issues":[1]}]'
    got = verdicts.read(spark.createDataFrame([(7, out), (8, "")], "b int, o string"), "b", "o", 3).collect()
    assert [tuple(r) for r in got] == [(7, 1, True, True, None, "wrong", None, ["1"])]


def test_small_functions(spark):
    assert one(spark, X.countdown(F.lit(125))) == "2:05"
    assert [one(spark, X.score_band(F.lit(s))) for s in (70, 50, 49)] == ["high", "middle", "low"]
    assert one(spark, X.upper_median(F.array(*map(F.lit, (4, 1, 3, 2))))) == 3
    assert one(spark, X.normal_line(F.lit("\f“a”  ‘b’ –\t—"))) == "\"a\" 'b' - -"
    assert one(spark, X.cleaned(F.lit("[PDF_PAGE 3] a fi fi b |_ c"))) == "a b c"
    assert one(spark, X.safe_file_name(F.lit("a b/c.pdf"))) == "a_b_c.pdf"
    assert one(spark, X.chunk_kind(F.lit("Chapter 1\n1. Intro"))) == "structure" and one(spark, X.chunk_kind(F.lit("answer in English"))) == "definition"
    assert one(spark, A.shared_explanation(F.array(F.lit("x"), F.lit(""), F.lit("x")))) == "x" and one(spark, A.shared_explanation(F.array(F.lit("x"), F.lit("y")))) is None
    assert one(spark, X.toggled(F.array(F.lit(1), F.lit(2)), F.lit(2), F.lit(True))) == [1] and one(spark, X.toggled(F.array(F.lit(1)), F.lit(2), F.lit(False))) == [2]


def raws(spark, *rows):
    """Parsed questions with the lines around them: (prompt, options by label, label, explanation, number, start, end)."""
    schema = "doc_id int, context string, number int, source string, prompt string, options array<struct<id:string,text:string>>, inline_label string, inline_explanation string, line_start int, line_end int, chapter struct<number:int,title:string>, exam int, polluted boolean"
    return spark.createDataFrame([(1, "chapter:1", n, "chapter_question", p, list(o.items()), label, e, a, b, (1, "One"), 2, p.startswith("fi")) for p, o, label, e, n, a, b in rows], schema)


def heads(spark, lines):
    from pyspark.sql import types as T

    schema = T._parse_datatype_string("doc_id int, line_no int, line string, heading string")
    return spark.createDataFrame([(1, i, t, h) for i, t, h in lines], schema)


def test_repair_engine(spark):
    """Every repair on a question that needs it, with its place in the log."""
    four = {"A": "the first one", "B": "the second one", "C": "the third one", "D": "the fourth one"}
    lines = [(1, "Which river is the longest of all?", None), (2, "It is in a land.", None), (3, "A. Nile", None), (4, "B. Rhine", None), (5, "and its arms", None), (6, "C. Don", None), (7, "D. Po", None), (8, "9. Next question here", None), (9, "C. Never read", None)]
    rows = [
        ("Is it so? A. yes B. no C. both", {"A": "x", "D": "neither"}, "B", "", 1, 20, 21),
        ("Who signs the deed first? 12. Who pays the tax then?", four, "A", "", 11, 22, 23),
        ("Who signs the deed first? 3. Who pays the tax then?", four, "A", "", 11, 24, 25),
        ("What is swallowed in the options?", {**four, "B": "the owner. C. the agent"}, "A", "", 4, 26, 27),
        ("What has the recovery of options?", {"A": "Nile", "D": "Po"}, "A", "", 5, 3, 7),
        ("Short", four, "A", "", 6, 4, 7),
        ("Which label is mapped by its words?", {k: v for k, v in four.items() if k != "A"}, "A", "it was the second one of them", 7, 40, 41),
        ("Which label is found elsewhere here?", four, None, "", 8, 50, 51),
    ]
    keys = spark.createDataFrame([(1, "exam:2", 8, "D", "From the exam.")], "doc_id int, context string, number int, label string, explanation string")
    got = {(r["at"], r["prompt"][:12], r["number"]): r for r in repair_engine.repaired(raws(spark, *rows), heads(spark, lines), keys).collect()}
    log = lambda r: {a["type"]: a["status"] for a in r["log"]}
    order = [a["type"] for a in got[20, "Is it so?", 1]["log"]]
    assert order == ["repair_ocr_layout_pollution", "resegment_prompt_and_options", "split_merged_numbered_questions", "trim_swallowed_option_text", "recover_options_from_source_context", "recover_prompt_from_previous_lines", "repair_answer_option_mapping", "retry_answer_key_lookup"]
    r = got[20, "Is it so?", 1]
    assert (r.A, r.B, r.C, r.D) == ("yes", "no", "both", "neither") and log(r)["resegment_prompt_and_options"] == "applied"
    first, second = got[22, "Who signs th", 11], got[22, "Who pays the", 12]
    assert (first.prompt, second.prompt, second.part, second.line_start, list(second.labels)) == ("Who signs the deed first?", "Who pays the tax then?", 1, 23, []) and second.A == ""
    assert log(got[24, "Who signs th", 11])["split_merged_numbered_questions"] == "failed"
    r = got[26, "What is swal", 4]
    assert r.B == "the owner." and log(r)["trim_swallowed_option_text"] == "applied"
    r = got[3, "What has the", 5]
    assert (r.A, r.B, r.C, r.D) == ("Nile", "Rhine and its arms", "Don", "Po") and log(r)["recover_options_from_source_context"] == "applied"
    r = got[4, "Which river ", 6]
    assert r.prompt == "Which river is the longest of all?" and log(r)["recover_prompt_from_previous_lines"] == "applied"
    r = got[40, "Which label ", 7]
    assert list(r.labels) == ["B"] and log(r)["repair_answer_option_mapping"] == "applied" and log(r)["recover_options_from_source_context"] == "failed"
    r = got[50, "Which label ", 8]
    assert (list(r.labels), r.explanation) == (["D"], "From the exam.") and log(r)["retry_answer_key_lookup"] == "applied" and list(r.asked) == ["retry_answer_key_lookup"]


def test_answer_key_windows(spark):
    """A key's window starts before its heading, and ends at a chapter or at the next key once entries were seen."""
    text = "Chapter 1: One\n1. A before it\nAnswer Key\n2. B two\ngoes on\n2. C\n41. D too large\nChapter 2: Two\n3. D not of one\nAnswer Key\n4. A four\nAnswer Key\n5. B five"
    heads = parse.headed(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    got = {(r.context, r.number): (r.label, r.explanation) for r in parse.answer_keys(heads).collect()}
    assert got["chapter:1", 1] == ("A", "before it") and got["chapter:1", 2] == ("C", "two goes on 41. D too large")
    assert ("chapter:1", 3) not in got and ("chapter:1", 41) not in got
    assert got["chapter:2", 4] == ("A", "four") and got["chapter:2", 5] == ("B", "five") and got["chapter:2", 3] == ("D", "not of one")


def test_hot_prefixes_make_no_pairs_of_their_own(spark, monkeypatch):
    """Two lines that all records have: only records with like words are one group."""
    monkeypatch.setattr(near_duplicates, "HOT", 3)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(10)), ["same first option", "same second option", f"own option {i} a"]) for i in range(12)]
    rows += [(100 + i, rows[i][1] + " more", rows[i][2][:2] + [f"other {i}"]) for i in range(5)] + [(200, "", ["same first option", "same second option"]), (201, "!", ["same first option", "same second option", "third of it all"])]
    feats = near_duplicates.features(spark.createDataFrame(rows, "id int, q string, o array<string>"), "id", F.col("q"), F.col("o"))
    got = {r.id: r.cluster for r in near_duplicates.groups(feats).collect()}
    assert got == {i: i for i in range(12)} | {100 + i: i for i in range(5)} | {200: 200, 201: 200}


def test_merge(spark):
    """A copy in a later bank, a scan with a lost ligature, a garbled record, and two copies that disagree."""
    from qforge.operators import merge

    def row(i, bank, q, options, correct, failed=False, explanation="because the first and final deed says so"):
        return (f"r{i}", i, bank, q, list(zip("ABCD", options, strict=True)), explanation, "ready", [], [], ["A"], [correct], f"h{q}{options}", bank == 0, failed)

    deed = ["the grantor signs", "the grantee signs", "the notary signs", "nobody signs it"]
    lease = ["the tenant alone does", "an owner of land", "their agents only", "some city council"]
    rows = [
        row(1, 0, "Who has to sign the deed of the first final branch office here?", deed, 0), row(2, 1, "Who has to sign the deed of the first final branch office here?", deed, 0),
        row(3, 1, "Who has to sign the deed of the rst nal branch office here?", [*deed[:3], "nobody signs"], 0),
        row(4, 1, "Which of them pays the rent of a lease each month?", lease, 0), row(5, 1, "Which of them pays the rent of a lease each month now?", lease, 1),
        row(6, 1, "What is the zqxv wkjj of the matter here?", ["alpha one", "beta two", "gamma three", "delta four"], 0),
    ]
    schema = "id string, seq int, bank_no int, question string, options array<struct<id:string,text:string>>, explanation string, status string, flags array<string>, actions array<struct<type:string,status:string>>, labels array<string>, correct array<int>, content_hash string, trusted boolean, failed boolean"
    known = spark.createDataFrame([(w,) for r in rows for t in (r[3], r[5], *(o for _, o in r[4])) for w in t.lower().replace("?", "").split() if w not in ("zqxv", "wkjj", "rst", "nal")], "word string")
    out, counts = merge.merged(spark.createDataFrame(rows, schema), known)
    got = {r.id: r for r in out.collect()}
    assert set(got) == {"r1", "r4", "r6"} and counts.first().asDict() == {"duplicates": 3, "normalized": 1, "garbled": 1, "conflicts": 1}
    assert got["r1"].status == "ready" and got["r4"].status == "needs_user_review" and list(got["r4"].flags) == ["model_audit_key_disputed"]
    assert got["r6"].status == "needs_repair" and [a["type"] for a in got["r6"].actions] == ["garbled_text_check"]


def test_changes_are_the_texts_that_repair_makes_others(spark):
    v = vocabulary.vocabulary(spark.createDataFrame([(VOCABULARY,)], "t string"), F.col("t"), F.lit(True))
    rows = list(enumerate(["a loan de ned by law", "（11. A 17-year-old purchased a house.", "Agent duties include the following", "two  spaces", "", None, "is in uenced"]))
    rows = spark.createDataFrame(rows, "id int, t string")
    whole = {r.id: r.t for r in repair_text.repaired(rows, "id", "t", v).collect()}
    got = {r.id: r.t for r in repair_text.changes(rows, "id", "t", v).collect()}
    assert got == {i: whole[i] for i in (0, 1, 3, 6)} and [whole[i] for i in (2, 4, 5)] == ["Agent duties include the following", "", None]


def test_a_merge_repairs_texts_once(spark, monkeypatch):
    """What the features and the records of a merge are made of is written first; else both repair all texts again. Two options of one id keep a text each."""
    from qforge.operators import merge

    plans = []

    def settled(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return storage.settled(df, name)

    from qforge import storage

    for m in (merge, near_duplicates):
        monkeypatch.setattr(m, "settled", settled)
    row = ("r1", 1, 0, "Which office has to sign it?", [("A", "a loan de ned by law"), ("A", "two")], "a loan defined by law, defined at last", "ready", [], [], ["A"], [0], "h", False, False)
    schema = "id string, seq int, bank_no int, question string, options array<struct<id:string,text:string>>, explanation string, status string, flags array<string>, actions array<struct<type:string,status:string>>, labels array<string>, correct array<int>, content_hash string, trusted boolean, failed boolean"
    out, counts = merge.merged(spark.createDataFrame([row], schema), spark.createDataFrame([("loan",)], "word string"))
    assert [(o.id, o.text) for o in out.first().options] == [("A", "a loan defined by law"), ("A", "two")] and counts.first().normalized == 1
    assert [name for name, plan in plans if "mended" in plan] == ["repaired"]


def test_copies_over_templates_make_linear_candidates(spark):
    """Thousands of records of three templates with the same options, a few words of each its own: stars link them, and few pairs are left to try."""
    r = random.Random(3)
    options = ["the grantor signs", "the grantee signs", "the notary signs", "nobody signs it"]
    rows = [(1000 * t + i, " ".join([*(f"common{t}x{k}" for k in range(20)), f"own{t}x{i}", f"more{t}x{r.randrange(50)}"]), options) for t in range(3) for i in range(900)]
    feats = settled(near_duplicates.features(spark.createDataFrame(rows, "id int, q string, o array<string>"), "id", F.col("q"), F.col("o")), "feats")
    got = {x.id: x.cluster for x in near_duplicates.groups(feats).collect()}
    assert got == {1000 * t + i: 1000 * t for t in range(3) for i in range(900)}
    classes = feats.withColumn("cls", F.col("id"))
    each = classes.select("cls", F.explode("prefixes").alias("p"))
    counted = settled(each.join(each.groupBy("p").agg(F.count("*").alias("n")), "p"), "counted")
    _, component = near_duplicates.linked(classes, counted)
    assert near_duplicates.candidates(classes, counted, component).count() < 2 * len(rows)


def test_words_end_at_letters_beyond_ascii(spark):
    """Java's word boundary is none between an umlaut and an ASCII letter; the reference's is."""
    assert [one(spark, X.chunk_kind(F.lit(t))) for t in ("ütest un", "der testä", "contest", "test_1")] == ["definition", "definition", "context", "context"]
    flags = X.repair_flags(F.lit("Was gilt üA. eins B. zwei C. drei"), F.array().cast("array<struct<id:string,text:string>>"), F.array(F.lit("A")), F.array(F.lit(0)))
    assert "prompt_contains_options" in one(spark, flags)


def test_frequent_prefixes_and_words_apart_make_no_candidates(spark, monkeypatch):
    """Records that have frequent words in common but other frequent prefixes, or the prefixes but only a few words, are not tried; null texts keep a group of their own."""
    monkeypatch.setattr(near_duplicates, "HOT", 3)
    r = random.Random(5)
    pool = [f"word{k}" for k in range(2000)]
    rows = [(i, " ".join(r.sample(pool, 20)), [f"line {i % 5} one", f"line {i % 5} two", f"line {i % 5} three"]) for i in range(300)]
    feats = settled(near_duplicates.features(spark.createDataFrame([*rows, (900, None, None), (901, None, None)], "id int, q string, o array<string>"), "id", F.col("q"), F.col("o")), "feats")
    got = {x.id: x.cluster for x in near_duplicates.groups(feats).collect()}
    assert set(got) == {*range(300), 900, 901} and got[900] == 900 and got[901] == 901
    classes = feats.filter("id < 900").withColumnRenamed("id", "cls")
    each = classes.select("cls", F.explode("prefixes").alias("p"))
    counted = settled(each.join(each.groupBy("p").agg(F.count("*").alias("n")), "p"), "counted")
    tried = near_duplicates.candidates(classes, counted, classes.select("cls", F.col("cls").alias("component"))).count()
    assert tried < 300 * 59 / 2 / 10  # of all pairs with the same prefixes


def test_text_repair_keeps_every_row_and_asks_for_few(spark):
    """A null text stays a row, of overlapping pairs the first and third are taken, and words that no damage makes are not shuffled with their texts."""
    v = vocabulary.vocabulary(spark.createDataFrame([(VOCABULARY + " offi offi cefice cefice",)], "t string"), F.col("t"), F.lit(False))
    rows = [(1, None), (2, "of ce fice today"), (3, "Anotice of it. Alisting here. Alisting")]
    got = {r.id: r.t for r in repair_text.repaired(spark.createDataFrame(rows, "id int, t string"), "id", "t", v).collect()}
    assert got == {1: None, 2: "office fice today", 3: "Anotice of it. A listing here. A listing"}
    table = repair_text.damaged(v, 2, 5)
    assert {r.key: r.new for r in table.collect()}["of ce"] == "office" and table.count() < 2 * v.count()


def test_normal_lines_and_headings_by_one_pattern(spark):
    """Lines that stay as they are, and lines that are changed; a line is normalised once in the plan, before it is told from noise."""
    given = ["a plain line", " led", "two  spaces", "end ", "tab\there", "“quoted”\x0c", "a b", "", "é"]
    assert [one(spark, X.normal_line(F.lit(t))) for t in given] == ["a plain line", "led", "two spaces", "end", "tab here", '"quoted"', "a b", "", "é"]
    text = "CHAPTER 2: Two\nfi fi\n12\n[PDF_PAGE 3]\nsample questions\nchapter quiz\n**Answer key**\nSAMPLE EXAM I\nAnswers are here\nfi"
    heads = parse.headed(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    assert [(r.line_no, r.heading) for r in heads.orderBy("line_no").collect()] == [(1, "none"), (5, "samples"), (6, "quiz"), (7, "key"), (8, "exam"), (9, None), (10, None)]
    plan = heads._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1


def test_page_layout_reads_its_words_once(spark):
    """Lines, middles and sides of a page come of one pass over its words: no step is joined back to them."""
    boxes = spark.createDataFrame([("p", "a", 0.0, 0.0, 300.0, 10.0, "x"), ("p", "b", 600.0, 0.0, 900.0, 10.0, "y"), ("q", "a", 0.0, 0.0, 300.0, 10.0, "7")], "k string, line_id string, left double, top double, right double, bottom double, text string")
    for got in (layout.column_split(boxes, "k", least_lines=2), layout.column_major(boxes, "k")):
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(layout.column_split(boxes, "k", least_lines=2).collect()) == [("p", 450), ("q", None)]


def test_duplicate_of_hashes_texts_once(spark, tmp_path):
    from qforge.plans import analytics_queries

    spark.createDataFrame([(1, "A b."), (2, "a b"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = analytics_queries.duplicate_of(spark, str(tmp_path))
    assert "sha2" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(got.collect()) == [(1, None), (2, "1"), (3, None)]


def test_pages_are_put_in_order_a_few_at_a_time(spark):
    """A worker's frames stay small, however many rows Spark hands it."""
    pages = spark.range(3 * layout.ROWS + 1).selectExpr("id page", "concat('line ', id) text").coalesce(1)
    got = layout.ordered_pages(pages, "page", "text").collect()
    assert [tuple(r) for r in sorted(got)] == [(i, f"line {i}", False) for i in range(3 * layout.ROWS + 1)]


def test_practice_parsers_hold_one_document(spark):
    """Parsers of practice tests neither shuffle nor sort lines, however long a document is and however often its numbers repeat."""
    docs = spark.createDataFrame([(1, "\n".join(f"{i % 999 + 1}. What is {i}?\nA. {i}\nB. no" for i in range(5000))), (2, None), (3, "no number"), (None, "1. What?\nA. a")], "doc_id int, text string")
    got = parse.practice_questions(docs)
    assert {(r.doc_id, r.number): r.prompt for r in got.collect()} == {(1, i % 999 + 1): f"What is {i}?" for i in range(5000)} | {(None, 1): "What?"}
    answers = parse.practice_answers(docs)
    assert answers.filter("doc_id = 1").count() == 999
    for df in (got, answers):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Exchange", "Sort", "Window")), plan


def test_practice_records_are_dealt_by_size(spark, monkeypatch):
    """Questions meet answers in as many tasks as the texts need, which a shuffle's bytes would not say."""
    monkeypatch.setattr(practice, "TASK_BYTES", 1 << 10)
    rows = [(i, "National", "\n".join(f"{j}. What is {i} {j}?\nA. a\nB. b\nC. c\nD. d" for j in range(1, 41)), "\n".join(f"{j}. B) so" for j in range(1, 31))) for i in range(20)]
    tests = spark.createDataFrame(rows, "test int, portion string, q string, a string")
    questions = tests.select("test", "portion", F.col("q").alias("text"))
    assert practice.tasks(questions) == -(-sum(len(q) for _, _, q, _ in rows) // 1024) > 20
    got = practice.records(questions, tests.select("test", "portion", F.col("a").alias("text")))
    assert got.count() == 800 and got.filter("label = 'B'").count() == 600
    assert f", {practice.tasks(questions)}), REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()


def test_keyed_tries_contexts_one_after_another(spark):
    """Contexts of any number, null, blank or repeated; questions without any; rows that repeat; answers without a label. A question that has found its answer is not shuffled again."""
    q = spark.createDataFrame([(1, 1, ["a", "b"]), (2, 1, [None, "x", "x", "b"]), (3, 2, ["a", "b", "c", "d"]), (4, 1, []), (5, 1, None), (6, None, ["a"]), (7, 1, ["z"]), (1, 1, ["a", "b"]), (None, 1, ["b"])], "id int, number int, c array<string>")
    a = spark.createDataFrame([("a", 1, "A"), ("b", 1, "B"), ("a", 2, None), ("d", 2, "D")], "context string, number int, label string")
    got = lines.keyed(q, a, F.col("c"), ["id"])
    want = [(1, "A", "a")] * 2 + [(2, "B", "b"), (3, "D", "d"), (4, None, None), (5, None, None), (6, None, None), (7, None, None), (None, "B", "b")]
    assert sorted(((r.id, r.label, r.matched_context) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert got.columns == ["id", "number", "c", "label", "matched_context"]
    path = settled(spark.range(20000).select("id", F.lit(1).alias("number")), "questions")
    key = settled(spark.range(0, 20000, 2).select(F.col("id").cast("string").alias("context"), F.lit(1).alias("number"), F.lit("L").alias("label")), "answers")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = lines.keyed(path, key, F.array(*[(F.col("id") + i).cast("string") for i in range(3)]), ["id"])
        assert df.count() == 20000 and df.filter("label = 'L'").count() == 20000 - 1
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert len(re.findall(r"[-] Exchange hashpartitioning\(_ctx", plan)) == 3, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_places_of_words_are_not_sorted(spark):
    """Garbled records are found without a sort of all words of all texts, and words that every record has cost no more."""
    texts = [(i, "the same words everywhere " * 50 + (f"qxz{chr(97 + i)} wvk{chr(97 + i)}" if i % 2 else "")) for i in range(20)]
    docs = spark.createDataFrame(texts, "id int, t string")
    got = vocabulary.garbled(docs, "id", F.col("t"), docs, X.letter_words(F.col("t")), spark.createDataFrame([("house",)], "word string"))
    assert {r.id: r.unknown for r in got.collect()} == {i: 2 for i in range(1, 20, 2)}
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"ShuffledHashJoin \[word#\d+\], \[word#\d+\], LeftAnti, BuildRight", plan)) >= 2
    assert not re.search(r"SortMergeJoin.* LeftAnti", plan)


def test_near_duplicates_leave_little_behind(spark, tmp_path, monkeypatch):
    """Tables between steps go with their step; only the words of records that are tried as pairs are shuffled."""
    from qforge import storage

    monkeypatch.setattr(storage, "shared_path", lambda spark, name: f"{tmp_path}/{name}-{len([*tmp_path.iterdir()])}-{random.random()}")
    rows = [(i, " ".join(f"own{i}x{k}" for k in range(30)), [f"{i} one", f"{i} two", f"{i} three"]) for i in range(50)]
    rows += [(100 + i, rows[i][1] + " more", rows[i][2]) for i in range(5)] + [(200, "alone", ["one line"])]
    got = near_duplicates.groups(near_duplicates.features(spark.createDataFrame(rows, "id int, q string, o array<string>"), "id", F.col("q"), F.col("o")))
    assert {r.id: r.cluster for r in got.collect()} == {i: i for i in [*range(50), 200]} | {100 + i: i for i in range(5)}
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["groups"]


def test_repairs_take_a_text_apart_once(spark):
    """What a repair has made of a text is not made anew for each mention; texts with odd white space are seen as before."""
    t = spark.createDataFrame([("What is it? A. one B. two  C.\tthree D. four",), ("Nothing inline here.",), (None,)], "t string")
    got = t.select(parse.resegmented(F.col("t")).alias("r"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 2
    assert [r.r and (r.r.prompt, [(o.id, o.text) for o in r.r.options]) for r in got.collect()] == [("What is it?", [("A", "one"), ("B", "two"), ("C", "three"), ("D", "four")]), None, None]
    cut = t.select(parse.merged_question(F.col("t"), F.lit(1)).alias("m"))
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("regexp_instr") == 1 and not any(r.m for r in cut.collect())
    two = spark.createDataFrame([("Which one is it now? 7. What else?", 3)], "t string, n int")
    assert two.select(parse.merged_question(F.col("t"), F.col("n")).alias("m")).first().m == ("Which one is it now?", 7, "What else?", True)
    assert [one(spark, parse.trimmed_option(F.lit(x))) for x in ("the first  9.\tNext one", " the  first ", "the first. B. second", "word " * 100)] == ["the first", "the first", "the first.", ("word " * 84).strip()]
    assert [one(spark, X.cleaned(F.lit(x))) for x in ("a  b", "a fi fi b", "a | b_c", "[PDF_PAGE 3] x", "of it", " x")] == ["a b", "a b", "a b c", "x", "of it", "x"]


def test_text_repair_asks_only_for_what_may_be_damaged(spark):
    """Words that no damage has are dropped before the join, so that a damage too large to be broadcast doesn't shuffle all words of all texts."""
    v = vocabulary.vocabulary(spark.createDataFrame([(VOCABULARY + " offi offi cefice cefice",)], "t string"), F.col("t"), F.lit(False))
    damage = repair_text.damaged(v, 2, 5)
    texts = spark.createDataFrame([(1, "of ce today"), (2, " ".join(f"plain{chr(97 + i % 26)}{chr(97 + i // 26)} word" for i in range(300))), (3, None)], "id int, t string")
    got = {r.id: r.keys for r in texts.select("id", repair_text.asking(damage)(F.col("t")).alias("keys")).collect()}
    assert got[1] == ["of ce"] and len(got[2]) < 3 and got[3] == []
    every = damage.filter("key not like '% %' and key not like '+%' and length(key) > 1 and key = lower(key)").select(F.col("key").alias("t"))
    assert every.filter(F.array_contains(repair_text.asking(damage)(F.col("t")), F.col("t"))).count() == every.count() > 0
