"""The pipeline's near-dedup stage against every pair's 5-word Jaccard similarity."""

import random

import numpy as np

import corpus_pipeline
from qforge.llm import jaccard
from tests.llm import plain
from tests.llm.fixtures import DOCS, texts


def test_near_dedup_stage(spark):
    r = random.Random(9)
    out = [t for t in texts() if t is None or len(t) < 20_000]
    for edits in (1, 2, 3, 4, 5, 6, 8):  # of 200 words: similarity about 0.95 to 0.65
        for _ in range(8):
            w = [f"v{r.randrange(5000)}" for _ in range(200)]
            out.append(" ".join(w))
            for at in r.sample(range(200), edits):
                w[at] = "changed"
            out.append(" ".join(w))
    base = [f"h{i}" for i in range(150)]  # one group of copies that meet mostly at their base
    for i in range(60):
        w = list(base)
        w[r.randrange(150)] = w[r.randrange(150)] = f"x{i}"
        out.append(" ".join(w))
    rows = list(enumerate(out))
    docs = spark.createDataFrame([(i, t, "en", "a", None, "x", "y", "k", "c") for i, t in rows], DOCS).repartition(5)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(x.doc_id for x in got.collect()) == sorted(i for i, _ in plain.near_dedup(rows))


def test_no_short_pair_is_lost(spark):
    """The bound lets each of 50,000 pairs of sets at a similarity of 0.8 and up meet; of a short text and the same without its last word one stays."""
    r = random.Random(2)
    alone = np.random.default_rng(1)
    for _ in range(50_000):
        n = r.randrange(5, 120)
        apart = r.randrange(0, (2 * n) // 9 + 1)
        h = np.unique(alone.integers(0, 1 << 63, n + apart, dtype=np.uint64))
        a, b = h[: len(h) - apart // 2], np.concatenate([h[: len(h) - apart], h[len(h) - apart // 2 :]])
        if jaccard.alike(np.sort(a), np.sort(b)):
            x, y = (np.frombuffer(jaccard.parities(v), np.uint64) for v in (a, b))
            assert jaccard.may(x, y, len(a), len(b))
    rows = []
    for i in range(4_000):
        w = [f"w{r.randrange(1_000_000)}" for _ in range(r.randrange(9, 13))]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:-1]))]  # of 5 shingles or more four fifths
    docs = spark.createDataFrame([(i, t, "en", "a", None, "x", "y", "k", "c") for i, t in rows], DOCS).repartition(5)
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()) == list(range(0, 8_000, 2))


def test_the_verdict_of_two_texts_that_fingerprints_part(spark):
    """Similarity is exactly 0.8, fingerprints differ in 27 bits."""
    t = "w109283 w51576 w108960 w145341 w564647 w689998 w973176 w961669 w377788"
    docs = spark.createDataFrame([(1, t, "en", "a", None, "x", "y", "k", "c"), (2, t.rpartition(" ")[0], "en", "a", None, "x", "y", "k", "c")], DOCS)
    assert [x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [1]


def test_a_worker_lets_go_of_what_another_operator_kept():
    """A near-dedup worker would else hold the token file's pieces beside its own sets."""
    from qforge.llm import common, langid, tokens

    encoder = tokens._encoder(None)
    assert tokens._encoder(None) is encoder and "tokens" in common._KEPT
    common.kept_by("jaccard")
    assert "tokens" not in common._KEPT and tokens._encoder(None) is not encoder
    assert all(m.kept_by is common.kept_by for m in (jaccard, langid, tokens))


def test_later_links_join_labels(spark):
    """Labels of earlier rounds stand in for their links, also where a new link joins two components at nodes that are not their smallest."""
    label = spark.createDataFrame([(2, 1), (3, 1), (6, 5), (7, 5)], "node long, component long")
    links = spark.createDataFrame([(7, 3), (9, 8)], "src long, dst long")
    assert {r.node: r.component for r in jaccard.joined(label, links).collect()} == {2: 1, 3: 1, 5: 1, 6: 1, 7: 1, 9: 8}
    assert jaccard.joined(label, links.limit(0)) is label


def test_rounds_without_links_run_few_jobs(spark):
    """Each exchange and broadcast of a round leaves threads in the driver for a minute; a round that finds nothing ends at once."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40)), "en", "a", None, "x", "y", "k", "c") for i in range(40)]
    rows += [(100, rows[0][1] + " end", "en", "a", None, "x", "y", "k", "c")]
    docs = spark.createDataFrame(rows, DOCS)
    spark.sparkContext.setJobGroup("few", "few")
    try:
        got = sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect())
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == list(range(40))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) <= 70
