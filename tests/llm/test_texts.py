"""Line and substring deduplication, packing, language model."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import DATA, same
from tests.llm.conftest import EDGES
from veritally.llm import ctw, kernels as K, lines, packing, registry, substrings

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def repeated_texts(seed=1, n=60):
    r = random.Random(seed)
    phrases = [" ".join(r.choice("alpha beta gamma delta eps".split()) + str(r.randrange(40)) for _ in range(r.randint(10, 30))) for _ in range(8)]
    return [(i, "\n".join(r.choice(phrases) if r.random() < 0.6 else " ".join(str(r.randrange(1000)) for _ in range(20)) for _ in range(r.randint(0, 7)))) for i in range(n)]


def substrings_by_force(rows, size=13):
    first = {}
    for i, t in rows:
        w = WORD.findall((t or "").encode())
        for k in range(len(w) - size + 1):
            if i is not None:
                first[tuple(w[k : k + size])] = min(i, first.get(tuple(w[k : k + size]), i))
    out = []
    for i, t in rows:
        w = WORD.findall((t or "").encode())
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone |= set(range(k, k + size))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [repeated_texts(), EDGES, []])
def test_substrings(table, rows):
    got = substrings.remove_repeats(table(rows)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got), key=str) == substrings_by_force(rows)
    for r in got:
        assert sum(s["end"] - s["first"] for s in r["spans"]) == r["n_removed"]


@pytest.mark.parametrize("cuts", [1, 2])
def test_substrings_in_many_small_groups(table, monkeypatch, cuts):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 500)
    plain = substrings.groups
    monkeypatch.setattr(substrings, "groups", lambda n, group: (*plain(n, group)[:2], cuts))
    monkeypatch.setattr(substrings, "PART_BYTES", 4000)
    rows = repeated_texts(5, 40)
    got = substrings.remove_repeats(table(rows), group=50).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got), key=str) == substrings_by_force(rows)


def lines_by_force(rows, least=lines.LEAST_CHARS):
    order = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None})
    ones, twos, out = set(), set(), {}
    for has, i, t in order:
        ls = t.split("\n")
        used = [x.strip(" ") != "" for x in ls]
        gone = set()
        for k, x in enumerate(ls):
            if used[k]:
                if x in ones and len(x) >= least:
                    gone.add(k)
                ones.add(x)
            if k + 1 < len(ls) and used[k] and used[k + 1]:
                if (x, ls[k + 1]) in twos:
                    gone |= {k, k + 1}
                twos.add((x, ls[k + 1]))
        out[(i if has else None, t)] = (len(ls), len(gone), "\n".join(x for k, x in enumerate(ls) if k not in gone))
    return sorted((((i, *out[(i, t)]) if t is not None else (i, 0, 0, None)) for i, t in rows), key=str)


@pytest.mark.parametrize("rows", [repeated_texts(2), [e for e in EDGES if e[0] != 3], []])
def test_lines(table, rows):
    got = lines.dedup_lines(table(rows)).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in got), key=str) == lines_by_force(rows)
    assert all(r["gone"] == "z" for r in got)


def test_longest_runs(table):
    run = "\n".join(f"line number {i}" for i in range(9))
    got = lines.dedup_lines(table([(1, run), (2, "own\n" + run)])).orderBy("doc_id").collect()
    assert [(r["n_removed"], r["longest_run"]) for r in got] == [(0, 0), (9, 9)]


@pytest.mark.parametrize("seed", [1, 2])
def test_longest_earlier_runs_of_every_line(table, seed):
    """Maximal repeats against all pairs of positions, of lines that repeat in runs of all lengths, across and within documents."""
    r = random.Random(seed)
    source = [r.choice("abcdef") for _ in range(60)]
    docs = []
    for i in range(12):
        ls = []
        while len(ls) < 40:
            a = r.randrange(55)
            ls += source[a : a + r.randint(1, 25)] if r.random() < 0.7 else [r.choice(["", f"own {i} {len(ls)}"])]
        docs.append((i, "\n".join(ls)))
    sequences = lines.positions(table(docs))
    number = {r["doc"]: r["doc_id"] for r in sequences.collect()}
    got = {(number[r["pos"] >> lines._LINE], r["pos"] & ((1 << lines._LINE) - 1)): r["length"] for r in lines.repeated_runs(sequences).collect()}
    flat = [(i, k, docs[i][1].split("\n")) for i in range(12) for k in range(len(docs[i][1].split("\n")))]
    want = {}
    for n, (i, k, ls) in enumerate(flat):
        best = 0
        for _, m, other in flat[:n]:
            x = 0
            while k + x < len(ls) and m + x < len(other) and ls[k + x] == other[m + x] != "":
                x += 1
            best = max(best, x)
        if best:
            want[i, k] = best
    assert got == want


def test_encoder_equals_tokenizers_on_a_corpus(spark):
    """Every document, page and turn of the smallest tables, byte for byte."""
    own = packing.encoder(packing.vocabulary())
    for name, column in (("documents", "text"), ("pages", "html"), ("conversations", "text")):
        for r in spark.read.parquet(f"{DATA}/sf0.001/{name}.parquet").select(column).collect():
            assert own.encode(r[0] or "") == own.tokenizer.encode(r[0] or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracles(spark, duck, name):
    same(registry.queries()[name](spark, f"{DATA}/sf0.001"), duck("sf0.001").sql(registry.oracle_sql()[name]).df())


def best_fit(lengths):
    """Sequences that best-fit decreasing needs, one piece after the other."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(1024 - n)
    return len(gaps)


@pytest.mark.parametrize("rows", [EDGES, [(i, "tok " * (i * 37 % 1500)) for i in range(80)], []])
def test_packing(table, rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.vocabulary())
    pieces = packing.stored(packing.tokenise(table(rows), packing.vocabulary(), with_ids=True))
    got = packing.pack(pieces).collect()
    want = collections.Counter()
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        head = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, p, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b])), tuple(ids[a:b]))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    room = collections.defaultdict(list)
    for r in got:
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in room.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(room) == best_fit([r["length"] for r in got])


def test_encoder_equals_tokenizers():
    own = packing.encoder(packing.vocabulary())
    assert own.fast is not None
    for t in ["", " ", "a  b\n\n c's 12,3", "<|endoftext|> x", "ÉÈ ü ß 漢字 　x", "x" * 5000, "\x00\x1f"]:
        assert own.encode(t) == own.tokenizer.encode(t, add_special_tokens=False).ids


def test_language_model_base_and_edges(table):
    rows = repeated_texts(4, 50) + EDGES
    got = ctw.log_probability(table(rows)).collect()
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = lambda t: WORD.findall((t or "").encode().translate(low)) + [b"\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(x for i, t in rows if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 4)) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got), key=str) == want
    assert all(-1e7 < r["score"] < 0 for r in got)


def test_language_model_of_nothing(empty):
    assert ctw.log_probability(empty).collect() == []


def ctw_by_force(rows):
    """log10 score of every text, from dictionaries of nodes."""
    depth, held = ctw.DEPTH, lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    stream = lambda t: b" ".join(WORD.findall((t or "").encode().translate(low))) + b"\n"
    seen, kids = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)

    def paths(t):
        s = b"\n" * depth + stream(t)
        for x in range(depth, len(s)):
            for j in range(8):
                yield s[x] >> (7 - j) & 1, [(s[x - d : x], 1 << j | s[x] >> (8 - j)) for d in range(depth + 1)]

    for i, t in rows:
        for bit, path in () if held(i) else paths(t):
            for d, k in enumerate(path):
                seen[k][bit] += 1
                if d:
                    kids[path[d - 1]].add(k)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    pw = {}
    for k in sorted(seen, key=lambda k: -len(k[0])):
        e = kt(*seen[k])
        pw[k] = e if len(k[0]) == depth else np.logaddexp(e, sum(pw[c] for c in kids[k])) - math.log(2)
    out = []
    for i, t in rows:
        total = 0.0
        for bit, path in paths(t):
            q = None
            for k in reversed(path):
                if k in seen:
                    own = (seen[k][1] + 0.5) / (sum(seen[k]) + 1)
                    w = math.exp(kt(*seen[k]) - pw[k] - math.log(2))
                    q = own if q is None else w * own + (1 - w) * q
            total += math.log10((0.5 if q is None else q if bit else 1 - q))
        out.append((i, round(total, 2)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shares", [False, True])
def test_context_tree_weighting_is_exact(table, monkeypatch, shares):
    """No node is lost, however little is held at once and however many tasks share the parts."""
    if shares:
        monkeypatch.setattr(ctw, "SHARE", 2)
        monkeypatch.setattr(ctw, "HELD", 300)
    r = random.Random(3)
    rows = [(i, " ".join("".join(r.choice("abcdeXYé") for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 60)))) for i in range(50)] + [e for e in EDGES if e[0] != 5]
    got = ctw.log_probability(table(rows)).collect()
    want = ctw_by_force(rows)
    assert len(got) == len(want)
    for (i, w), g in zip(want, sorted(((x["doc_id"], round(x["score"], 2)) for x in got), key=str)):
        assert i == g[0] and abs(w - g[1]) < 0.05
    data, first, _ = ctw.stream(pa.array(["abcabc abd", "abx"]))
    gram, count = np.unique(ctw.grams(data, first), return_counts=True)
    levels, above = ctw.subtrees(gram, count)
    every = (gram[3] & np.uint64((1 << 8 * ctw.DEPTH) - 1)) | np.arange(256).astype(np.uint64) << np.uint64(8 * ctw.DEPTH)
    assert abs((10 ** ctw.log10_of(every, levels | ctw.upper(*above))).sum() - 1) < 1e-6


def test_kernels_hash_as_spark(spark):
    x = np.array([0, 1, -1, 2**62, -(2**63), 12345], np.int64)
    got = [r[0] for r in spark.createDataFrame([(int(v),) for v in x], "x long").selectExpr("xxhash64(x)").collect()]
    assert K.spark_hash(x).tolist() == got


def test_kernel_words():
    w = K.words(pa.array([" a bb\tc ", None, "", "bb"]))
    assert w.counts.tolist() == [3, 0, 0, 1] and w.hash[1] == w.hash[3] and len(set(w.hash.tolist())) == 3
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


def test_subtrees_of_frequent_words_are_dealt_evenly():
    """All prefixes of two and four words went to one subtree, whatever their number: it grew with the corpus."""
    n = np.full((3, substrings.CLASSES), 1000, np.int64)
    n[0] = 0
    n[0, :400] = 4_096_000 // 400  # every first word is frequent
    of, count, _ = substrings.groups(n, 2000)
    assert (of[0, :400] < 0).all() and (of[1] >= 0).all()
    load = np.bincount(of[1], n[1], minlength=count)
    assert load.max() <= 2 * n[1].sum() / count
