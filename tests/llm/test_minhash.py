import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from veritally.llm import kernels as K, minhash


def brute(rows, least=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        if any(x and y and len(x & y) / len(x | y) >= least for x in sets[a] for y in sets[b]):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def got(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: r["component_id"] for r in rows}


def chain(seed=3):
    """Copies, a chain of edited texts whose ends are far apart, and a large group about one original."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows, base = [], [word() for _ in range(120)]
    for i in range(40):
        base = base[:]
        base[(7 * i) % 120] = word()
        rows.append((100 + i, " ".join(base)))
    original = [word() for _ in range(150)]
    for i in range(60):
        t = original[:]
        for _ in range(r.randint(0, 5)):
            t[r.randrange(150)] = word()
        rows.append((300 - i, " ".join(t)))
    rows += [(500 + i, " ".join(original)) for i in range(5)] + [(600, " ".join(word() for _ in range(80)))]
    return rows


def test_against_brute_force(table):
    rows = chain()
    assert got(minhash.near_duplicates(table(rows))) == brute(rows)


def test_edges(edges, empty):
    found = got(minhash.near_duplicates(edges))
    assert found == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8}
    assert minhash.near_duplicates(empty).collect() == []


def test_weighted_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    w = rng.gamma(1, 3, (24, 200))
    w[12:] = w[:12] * rng.uniform(0.3, 1.7, (12, 200))
    w[rng.random(w.shape) < 0.3] = 0
    row, col = np.nonzero(w)
    sig = minhash.signatures(K.mix(np.arange(1, 201).astype(np.uint64))[col], row, w[row, col], 24, 512)
    error = [(sig[i] == sig[i + 12]).mean() - np.minimum(w[i], w[i + 12]).sum() / np.maximum(w[i], w[i + 12]).sum() for i in range(12)]
    assert np.abs(error).max() < 0.09 and abs(np.mean(error)) < 0.03


def test_the_pass_across_components(spark):
    """Without hub links, the exact pass must find every link by itself, over several blocks."""
    rng = np.random.default_rng(1)
    base = np.sort(rng.choice(2**32, 100, replace=False).astype(np.uint32))
    rows = []
    for i in range(600):
        s = base.copy()
        s[rng.choice(100, 5, replace=False)] = rng.choice(2**32, 5).astype(np.uint32)
        rows.append((1, i, i, 100, np.sort(s).tobytes()))
    members = spark.createDataFrame([(b, i, r, n, bytearray(e)) for b, i, r, n, e in rows], "bucket long, id long, root long, n int, elements binary")
    links = {(r["a"], r["b"]) for r in minhash.across(members, 0.8).collect()}
    sets = [set(np.frombuffer(r[4], np.uint32).tolist()) for r in rows]
    want = {(j, i) for i in range(600) for j in range(i + 1, 600) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    assert links == want
    assert minhash.across(members.where("false"), 0.8).count() == 0


def test_components(spark):
    from veritally.llm.components import components

    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(70)] + [(5, 5), (None, 3), (7, 6), (7, 6)]
    root = {i: i for e in edges for i in e if i is not None}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    out = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: find(i) for i in root if find(i) != i}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
