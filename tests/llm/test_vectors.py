import numpy as np
import pytest

from veritally.llm import vectors


def brute(x):
    ok = [i for i, v in enumerate(x) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = np.zeros(len(x), int)
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ok):
        for j in ok[n + 1 :]:
            a, b = np.array(x[i], float), np.array(x[j], float)
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (links[i], find(i)) for i in range(len(x))}


def test_recall_and_exactness(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(12, 64))
    x = [list(map(float, (c / np.linalg.norm(c) + rng.normal(size=64) * 0.033).astype(np.float32))) for c in centre for _ in range(20)]
    x += [x[0], x[0], [0.0] * 64, None, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [], [1.0, 2.0], [2.0, 4.0], [float("inf")] * 64]
    want = brute(x)
    df = spark.createDataFrame([(i, v, "extra", 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, id string, unit int")
    rows = {r["vec_id"]: r for r in vectors.near_vectors(df).collect()}
    assert len(rows) == len(x)
    assert all(rows[i]["n_links"] <= want[i][0] for i in rows)
    assert sum(r["n_links"] for r in rows.values()) >= 0.98 * sum(n for n, _ in want.values())
    assert np.mean([rows[i]["component_id"] == want[i][1] for i in rows]) >= 0.98
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows.values())


def test_large_buckets_are_cut_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(5)
    c = rng.normal(size=64)
    x = [list(map(float, c + rng.normal(size=64) * 0.05)) for _ in range(120)]
    want = brute(x)
    rows = vectors.near_vectors(spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows} == want


def test_repeated_and_null_ids(spark):
    """Every row counts, in whatever order: different vectors of one id have links of their own and share a component."""
    one, two = [1.0] + [0.0] * 15, [0.0, 1.0] + [0.0] * 14
    near = lambda v: [c + 0.01 for c in v]
    rows = [(1, one), (1, two), (2, near(one)), (3, near(two)), (3, near(two)), (4, None), (4, one), (9, None), (None, one), (None, None)]
    for order in (rows, rows[::-1]):
        got = vectors.near_vectors(spark.createDataFrame(order, "vec_id long, embedding array<double>")).collect()
        want = [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (3, 2, 1), (4, 0, 1), (4, 2, 1), (9, 0, 9), (None, 0, None), (None, 0, None)]
        assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == sorted(want, key=str)
        assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)


def test_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_hadamard():
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = vectors.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(vectors.hadamard(y), x)


@pytest.mark.parametrize("width", [1, 2, 3, 8, 64, 768])
def test_recall_by_width(width):
    """Pairs at a cosine of exactly .95 that share a bucket, of 800 (one component: all are equal or opposite)."""
    rng = np.random.default_rng(width)
    a, b = rng.normal(size=(2, 800, width))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(a)
    b = a if width == 1 else 0.95 * a + np.sqrt(1 - 0.95**2) * unit(b - (a * b).sum(1, keepdims=True) * a)
    x, y = vectors.keys(a), vectors.keys(b)
    met = [np.isin(x[i, :, 0], y[i]).any() or np.isin(y[i, :, 0], x[i]).any() for i in range(len(a))]
    assert np.mean(met) >= 0.99


def test_links_of_mixed_widths(spark):
    rng = np.random.default_rng(4)
    rows, base = [], {w: rng.normal(size=(12, w)) for w in (2, 5, 300)}
    for w, m in base.items():
        for k, v in enumerate(np.concatenate([m, m * 2, m + rng.normal(size=m.shape) * 0.1 * np.abs(m).mean()])):
            rows.append((1000 * w + k, [float(c) for c in v]))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    links = {i: {j for j, y in rows if i != j and len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95} for i, x in rows}
    assert {i: n for i, (n, _) in got.items()} == {i: len(v) for i, v in links.items()}
