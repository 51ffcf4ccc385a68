"""Nearest neighbours: a task works out a bounded number of cosines at once."""

import inspect

import numpy as np

from veritally.operators import retrieval


def test_nearest_in_slices(spark, monkeypatch):
    """A task held the cosines of all queries with a whole batch of 10,000 rows, and the batch as Python numbers."""
    r = np.random.default_rng(4)
    x = r.normal(size=(70, 6)).round(2)
    rows = [(i, [float(v) for v in x[i]]) for i in range(70)] + [(98, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (99, [0.0] * 6)]
    base = spark.createDataFrame(rows, "item_id long, vector array<double>").coalesce(1)
    queries = base.where("item_id % 10 = 0").selectExpr("item_id AS query_id", "vector")
    monkeypatch.setattr(retrieval, "CELLS", 7 * 4)  # slices of four rows
    got = {(q["query_id"], q["rank"]): (q["item_id"], round(q["cosine"], 9)) for q in retrieval.top_cosine(queries, base, 3).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {}
    for q in range(0, 70, 10):
        near = sorted(range(70), key=lambda i: (-(unit[q] @ unit[i]), i))[:3]
        want |= {(q, n + 1): (i, round(float(unit[q] @ unit[i]), 9)) for n, i in enumerate(near)}
    assert got == want
    assert "to_pylist" not in inspect.getsource(retrieval.top_cosine)


def test_every_vector_is_a_query(spark, tmp_path):
    """Only every hundredth vector was a query; equal vectors go by id, whatever block they are in."""
    from veritally import catalog

    r = np.random.default_rng(5)
    x = r.normal(size=(130, 7)).astype(np.float32)
    x[100:] = x[:30]
    spark.createDataFrame([(i, [float(v) for v in x[i]], 0) for i in range(130)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(v["query_id"], v["rank"]): v["item_id"] for v in catalog.queries()["knn_top4"](spark, str(tmp_path)).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    cosine = np.round(unit @ unit.T, 12)
    want = {(i, n + 1): j for i in range(130) for n, j in enumerate(sorted((j for j in range(130) if j != i), key=lambda j: (-cosine[i, j], j))[:4])}
    assert got == want
