"""Small tables with the awkward cases: nulls, blanks, repeats, ties, a long text, extra columns with clashing names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, blob string, _key string, chunk string"


def texts():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.choice([5, 30, 80, 200]))) for _ in range(40)]
    out = list(base)
    for t in base[:12]:
        out.append(t)  # exact copies
        w = t.split()
        w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w))  # near copies
    passage = " ".join(f"p{i}" for i in range(30))
    out += [f"{t}\n{passage}\t{t[:40]}" for t in base[12:20]]  # a passage that many share
    out += [" ".join(r.choice(vocabulary) for _ in range(30_000)), "z " * 60, "z " * 30, "Ünïcode wörds — ça va 😀 " * 5, "one", "One", "", "  \t\n ", None, None, "12345 !!"]
    return out


def docs(spark):
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "a", "b", "b"][i % 4], None, "x", "y", "k", "c") for i, t in enumerate(texts())]
    rows += [rows[3], rows[3], (None, texts()[5], "en", "a", 1, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def empty(spark):
    return spark.createDataFrame([], DOCS)
