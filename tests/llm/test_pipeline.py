"""Every stage of the pipeline, on what its predecessor kept, and run() as a whole, against plain Python versions."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from qforge.llm import langid, tokens
from tests.llm import plain
from tests.llm.fixtures import DOCS, docs, empty


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def key(rows):
    return sorted(rows, key=repr)


def more(spark):
    """Near copies of two languages, contaminated documents, and a text of no language."""
    r = random.Random(12)
    rows = []
    for i in range(60):
        words = [f"{'qu' if i % 2 else 'th'}{r.choice('aeiou')}{r.choice('nrst')}{r.randrange(900)}" for _ in range(r.choice((40, 120)))]
        text = " ".join(words)
        rows.append((2000 + 3 * i, text, "fr" if i % 2 else "en", "ab"[i % 2]))
        if i % 3 == 0:
            words[r.randrange(len(words))] = "edited"
            rows.append((2001 + 3 * i, " ".join(words), "fr" if i % 2 else "en", "ab"[i % 2]))
        if i % 5 == 0:
            rows.append((2002 + 3 * i, text[:60] + " " + " ".join(f"p{k}" for k in range(5, 25)), "en", "a"))
    rows.append((3000, "щ" * 400, None, "a"))
    return spark.createDataFrame([(i, t, lang, source, None, "x", "y", "k", "c") for i, t, lang, source in rows], DOCS)


def write(spark, d, folder):
    d.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"p{i}" for i in range(5, 25)))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_and_run(spark, tmp_path):
    write(spark, docs(spark).unionByName(more(spark)), tmp_path)
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, now = read.columns, read
    stages = dict(corpus_pipeline.STAGES)

    def step(name, now):
        out = stages[name](spark, now, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    model = langid.trained(now)
    out = step("language_id", now)
    assert key(pairs(out)) == key((i, t) for i, t in pairs(now) if not plain.language(t, model)[2])
    assert 0 < out.count() < now.count() and not out.filter("doc_id = 3000").count()
    now, out = out, step("near_dedup", out)
    assert key(pairs(out)) == key(plain.near_dedup(pairs(now)))
    assert out.count() < now.count() - 20
    now, out = out, step("decontamination", out)
    bench = plain.windows([(1, " ".join(f"p{i}" for i in range(5, 25)))])
    assert key(pairs(out)) == key((i, t) for i, t in pairs(now) if not plain.contaminated(t, bench))
    assert out.count() < now.count() - 5
    now, out = out, step("mix", out)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in now.collect():
        sizes[r.source] += plain.size(r.text)
        largest[r.source] = max(largest[r.source], plain.size(r.text))
    before, after = Counter(map(tuple, now.collect())), Counter(map(tuple, out.collect()))
    assert set(after) <= set(before) and all(after[x] <= 3 * before[x] for x in after)
    for x, n in after.items():
        taken[x[columns.index("source")]] += n * plain.size(x[columns.index("text")])
    for source, target in plain.targets(sizes).items():
        assert abs(taken[source] - target) <= largest[source] / 2 + 1
    now, out = out, stages["token_file"](spark, out, str(tmp_path))
    expected = plain.token_rows(pairs(now), tokens.Encoder(tokens.default_tokenizer()))
    assert key(map(tuple, out.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == key(expected)
    final = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert key(map(tuple, final.collect())) == key(expected)


@pytest.mark.parametrize("kind", ["empty", "null", "long"])
def test_run_on_odd_tables(spark, tmp_path, kind):
    if kind == "long":
        r = random.Random(3)
        d = spark.createDataFrame([(i, " ".join(f"{r.choice('abcde')}{r.choice('xyz')}w" for _ in range(150_000)), "en", "s", None, None, None, None, None) for i in range(2)], DOCS)
    else:
        d = empty(spark) if kind == "empty" else spark.createDataFrame([(None,) * 9] * 3, DOCS)
    write(spark, d, tmp_path)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert key(got) == key(plain.token_rows(pairs(d) if kind == "long" else [], tokens.Encoder(tokens.default_tokenizer())))
