"""Every registered query of the question bank against its DuckDB SQL on the smallest tables."""

import math
import os
import re
import sys
from pathlib import Path

import duckdb
import pytest

from qforge.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    return round(x, 9) if isinstance(x, float) and not math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(columns).collect()), key=repr)
    if name not in registry.ORACLE_SQL:
        assert columns
        return
    out = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in out.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=repr)
    assert got == expected


def test_entry_works_with_and_without_the_corpus_operators(spark, monkeypatch):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    for name in ("qforge.llm", "qforge.llm.queries"):
        monkeypatch.setitem(sys.modules, name, None)  # the import fails
    assert set(e.queries()) == set(registry.QUERIES)


def test_nothing_else_imports_the_corpus_operators():
    root = Path(__file__).resolve().parent.parent / "qforge"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"qforge\.llm|from \.+llm", path.read_text()), path
