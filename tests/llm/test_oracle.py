"""The corpus queries that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from qforge.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    out = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in out.description]
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(out.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_whole_table(spark, name):
    """Queries without SQL give a row for each row of their table, or whole ranks."""
    df = queries.QUERIES[name](spark, DATA)
    table = spark.read.parquet(f"{DATA}/{'pages' if 'op2_' in name or 'op12_' in name else 'embeddings' if 'op5_' in name else 'documents'}.parquet")
    if "op13_" in name:
        assert df.count() == spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id").distinct().count()
    elif "op5_" in name:
        assert df.count() == 10 * table.filter("vec_id % 100 = 0").count()
    else:
        assert df.count() == table.count() * (2 if "op2_" in name else 1)
