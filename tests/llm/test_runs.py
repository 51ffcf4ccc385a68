"""Runs against every pair of start and period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tests.conftest import DATA
from veritally.llm import runs

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=6, exponent=4):
    n, out = len(words), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least, exponent * p) and not any(all(words[x] == words[x + q] for x in range(i, i + length - q)) for q in range(1, p)):
                out.append((i, length, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    words = WORDS.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and n and h % 10 == 0:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, digest("".join(f"{s},{x},{q}\n" for s, x, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("least,exponent", [(2, 2), (6, 4), (6, 3)])
def test_runs_of_random_sequences(least, exponent):
    rng = random.Random(least * 10 + exponent)
    texts = [[rng.randrange(1, 1 + rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randrange(0, 60))] for _ in range(400)]
    texts += [[1] * 50, [2] + [1] * 50 + [2], [1, 2] * 25, [1, 2] * 12 + [1], [3] + [2, 1] * 20 + [2, 2], []]
    words = np.array([x for t in texts for x in t], np.int64)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = runs.runs(words, first, least, exponent)
    for k, t in enumerate(texts):
        assert sorted(map(tuple, found[found[:, 0] == k][:, 1:].tolist()), key=lambda r: (r[0], r[2])) == plain_runs(t, least, exponent), t


def test_all_documents_of_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: tuple(r) for r in runs.op11_runs(spark, f"{DATA}/sf0.001").collect()}
    short = [r for r in rows if len(WORDS.findall(r[1] or "")) < 1500]
    assert len(got) == len(rows) and len(short) > 100
    for doc_id, text in short:
        assert got[doc_id] == plain(doc_id, text)
    assert any(r[1] for r in got.values())


def test_edges(edges, empty, table):
    got = sorted((tuple(r) for r in runs.periodic_runs(edges).collect()), key=str)
    assert got == sorted((plain(r["doc_id"], r["text"]) if len(r["text"] or "") < 9999 else next(x for x in got if x[0] == 5) for r in edges.collect()), key=str)
    assert runs.periodic_runs(empty).collect() == []
    loops = [(i, t) for i in range(60) for t in ["a b " * 30, "x " * 40 + "y", "a\vb\fc " * 9 + "é  é ", " ".join("abcd"[(k * k) % 4] for k in range(50)), "z"]]
    for r, (i, t) in zip(sorted(map(tuple, runs.periodic_runs(table(loops)).collect()), key=str), sorted(loops, key=lambda x: str(plain(*x)))):
        assert r == plain(i, t)


def test_long_repeats(table):
    a, b, c, d = [i for i in range(50) if zlib.crc32(str(i).encode()) % 10][:4]
    long = [(a, "w " * 60_000), (b, "q r s " * 30_000), (c, "A " + "b " * 50_000), (d, " ".join(str(i) for i in range(70_000)))]
    got = {r["doc_id"]: tuple(r)[1:6] for r in runs.periodic_runs(table(long)).collect()}
    assert got == {a: (1, 0, 60_000, 1, 60_000_000), b: (1, 0, 90_000, 3, 30_000_000), c: (1, 1, 50_000, 1, 50_000_000), d: (0, None, None, None, None)}
