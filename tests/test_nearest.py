"""Matching on a line: as walking all pairs, without making them."""

import numpy as np
import pytest

from veritally.operators import matching, nearest


def told(seed: int, n: int, m: int, steps: int):
    """Rows with many equal values and distances; the last has repeated ids."""
    r = np.random.default_rng(seed)
    a = [(int(i % 2), int(i // 2 % (9 if seed == 3 else n)), float(r.integers(steps)) / 4) for i in range(n)]
    b = [(int(i % 2), int(i // 2 % (7 if seed == 3 else m)), float(r.integers(steps)) / 4) for i in range(m)]
    return a, b


@pytest.mark.parametrize("seed,n,m,steps", [(0, 60, 40, 12), (1, 90, 30, 400), (2, 40, 90, 3), (3, 50, 40, 30)])
def test_as_all_pairs(spark, seed, n, m, steps):
    one, two = told(seed, n, m, steps)
    a, b = spark.createDataFrame([*one, (None, 1, 0.0), (0, None, 0.0), (0, 900, None)], "g int, a long, x double"), spark.createDataFrame([*two, (5, 1, 0.0), (0, 901, None)], "g int, b long, y double")
    from pyspark.sql import functions as F

    far = F.abs(F.col("x") - F.col("y"))
    pairs = a.join(b, "g")
    want = sorted(map(tuple, matching.greedy(pairs.withColumn("s", -far), "g", "a", "b", "s", least=-1e18).collect()))
    assert sorted(map(tuple, nearest.greedy(a, b, "g", "a", "b", "x", "y", "s", 1e18).collect())) == want
    for least, margin in ((0.42, 0.12), (0.9, 0.3)):
        want = sorted(map(tuple, matching.sequential(pairs.withColumn("s", 1 / (1 + far / 10)), "g", "a", "b", "s", least, margin).collect()))
        assert sorted(map(tuple, nearest.sequential(a, b, "g", "a", "b", "x", "y", "s", lambda d: 1 / (1 + d / 10), least, margin).collect())) == want


@pytest.mark.parametrize("name", ["greedy_pairs", "sequential_pairs"])
def test_no_pairs_are_made(spark, name):
    """All customers of a nation met all of its suppliers."""
    from tests.conftest import DATA
    from veritally import catalog

    assert "Join" not in catalog.queries()[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_nearest_pages(spark, seed):
    """All paragraphs of a page window were joined, and ranked only then."""
    r = np.random.default_rng(seed)
    some = lambda n: None if r.random() < 0.05 else int(r.integers(n))
    a = [(k % 2, k, some(70), some(12), int(r.integers(1, 35))) for k in range(60)]
    b = [(k % 2, k * 7 % 101, some(70), some(12)) for k in range(101)]
    one, two = spark.createDataFrame(a, "pair_id int, i long, page int, seq int, reach int"), spark.createDataFrame(b, "pair_id int, j long, page int, seq int")

    def order(x, y):
        off = None if x[3] is None or y[3] is None else abs(x[3] - y[3])
        return abs(x[2] - y[2]), off is not None, off or 0, y[3] is not None, y[3] or 0, y[1]

    near = {x[1]: sorted((y for y in b if y[0] == x[0] and None not in (x[2], y[2]) and abs(x[2] - y[2]) <= min(x[4], 30)), key=lambda y, x=x: order(x, y)) for x in a}
    got = lambda crowded: sorted((p["i"], p["j"]) for p in nearest.pages(one, two, 30, 6, crowded).collect())
    assert got(1000) == sorted((i, y[1]) for i, ys in near.items() for y in ys)
    assert got(0) == sorted((i, y[1]) for i, ys in near.items() for y in ys[:6])
