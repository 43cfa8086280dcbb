"""A query gets k rows wherever the table has them."""

import numpy as np

from qforge.llm import neighbours


def test_outliers_among_copies(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 8))
    x[300:900] = x[1]  # copies, whose neighbours are all in the first list
    x[0], x[100], x[200] = 1000.0, -1000.0, [1000.0, -1000.0] * 4  # each alone in its list, if it is a centroid
    got = neighbours.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas()
    assert got.groupby("query_id").size().to_dict() == dict.fromkeys(range(0, 900, 100), 10)
    assert not (got["query_id"] == got["vec_id"]).any() and not got.duplicated(["query_id", "vec_id"]).any()


def test_short_queries_look_further(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "probes_for", lambda *a, **b: 1)
    x = np.random.default_rng(5).standard_normal((400, 8))
    x[0] = 1000.0
    got = neighbours.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), every=20).toPandas()
    assert got.groupby("query_id").size().to_dict() == dict.fromkeys(range(0, 400, 20), 10)
