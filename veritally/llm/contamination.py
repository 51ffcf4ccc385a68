"""Benchmark decontamination by latent semantic retrieval.

1. The words of the benchmark are the vocabulary.  One pass over all documents counts in how many passages (blocks of
   consecutive words) each occurs, for inverse document frequencies; no word has less than a least weight.
2. A randomised SVD (subspace iteration on A'A, A the TF-IDF rows of all passages and of all items, begun in the span
   of the items; a bounded number of tasks return partial products of vocabulary size x rank) gives the latent space.
   Its rank exceeds the number of items, so that it can hold each of them.
3. One more pass projects every passage of every document, takes as candidates the items whose latent
   cosine is large enough or that share a run of words (a seed) with it, and verifies them: the longest common
   subsequence of words must hold most of the item, or less (a paraphrase) if it holds the item's answer, its last
   words.  Seeds are exact, so a copy is found however common its words are.

The benchmark is a query set: it is handled in blocks of a bounded number of items, some blocks in each pass, so nothing
that is broadcast grows with the corpus.  Items of a block are of like length (within a factor of LENGTHS), as passages are cut to it: a short
item would not stand out in passages as long as a long one needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .common import read

#: Share of an item's words in common order; the same with its answer in it; words of the answer.
LCS, PARAPHRASE, ANSWER = 0.7, 0.5, 8
#: Least rank of the SVD, its rank above the number of items, and items handled at a time (about).
RANK, SPARE, ITEMS = 192, 40, 400
#: Blocks of items that share a pass over the documents.
TOGETHER = 8
#: The longest item of a block has fewer than so many times the words of the shortest.
LENGTHS = 4
#: A passage is a candidate for items of this cosine, over the norm of all its words; least weight of a word.
COSINE, LEAST_IDF = 0.27, 0.1
#: A passage is a candidate too if it holds a run of so many words of an item (all words of a shorter item).
SEED = 5
#: Rows of a matrix that are summed at a time; rows of a partial product that are added up by one task.
PIECE, ROWS = 32, 512
#: An item counts as such a share of all passages in the SVD: its space must hold the benchmark first.
ITEM_WEIGHT = 0.01


@dataclass
class Space:
    vocabulary: np.ndarray  # sorted word hashes
    idf: np.ndarray
    other: float  # weight of words outside the vocabulary: the median of those in it
    basis: np.ndarray  # vocabulary x rank
    block: int
    items: np.ndarray  # unit rows, items x rank
    ids: np.ndarray
    words: list[np.ndarray]
    seeds: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]  # run length, sorted hashes, first owner of each, owners


def normal(column: pa.Array) -> K.Words:
    """Words of letters and digits without regard to case."""
    return K.words(column, "punct", lower=True)


def look_up(vocabulary: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Number of each hash in the vocabulary, -1 if it is none."""
    if not len(vocabulary):
        return np.full(len(h), -1)
    # A table by the first bits narrows nearly all words down to one comparison.
    bits = max(1, int(len(vocabulary) * 16).bit_length())
    first = _first(vocabulary, bits)
    place = first[(h >> np.uint64(64 - bits)).astype(np.int64)]
    out = np.full(len(h), -1)
    live = np.flatnonzero(place >= 0)
    at = place[live]
    for _ in range(len(vocabulary)):
        same = vocabulary[at] == h[live]
        out[live[same]] = at[same]
        more = ~same & (at + 1 < len(vocabulary)) & (vocabulary[np.minimum(at + 1, len(vocabulary) - 1)] <= h[live])
        if not more.any():
            return out
        live, at = live[more], at[more] + 1
    return out


_TABLES: dict[tuple[int, bytes], np.ndarray] = {}


def _first(vocabulary: np.ndarray, bits: int) -> np.ndarray:
    """First number in the vocabulary for each value of the first bits of a hash (-1: none); kept by the vocabulary's content."""
    key = (bits, hashlib.blake2b(np.ascontiguousarray(vocabulary).view(np.uint8), digest_size=16).digest())
    if key not in _TABLES:
        if len(_TABLES) >= 8 * TOGETHER:
            _TABLES.clear()
        top = (vocabulary >> np.uint64(64 - bits)).astype(np.int64)
        table = np.full(1 << bits, -1)
        table[top[::-1]] = np.arange(len(top))[::-1]
        _TABLES[key] = table
    return _TABLES[key]


def blocks(w: K.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block of each word, text of each block); blocks of `size` words, the last of a text may be shorter."""
    count = -(-w.counts // size)
    base = np.cumsum(count) - count
    return base[w.text_of] + K.ranges(w.counts) // size, np.repeat(np.arange(len(count)), count)


def document_frequency(documents: DataFrame, each: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, int]]:
    """(passages that hold each word, passages) of all documents, for each vocabulary and size of passages; in one pass."""
    shared = documents.sparkSession.sparkContext.broadcast(each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.lean()
        sums = [np.zeros(len(known) + 1, np.int64) for known, _ in shared.value]
        for b in batches:
            for i, j in K.slices(b["text"]):
                w = normal(b["text"].slice(i, j - i))
                for (known, size), n in zip(shared.value, sums):
                    block, text = blocks(w, size)
                    number = look_up(known, w.hash)
                    hit = number >= 0
                    n[1:] += np.bincount(np.unique(block[hit] * len(known) + number[hit]) % max(1, len(known)), minlength=len(known))
                    n[0] += len(text)
        for k, n in enumerate(sums):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k, np.int32)), pa.array(np.arange(-1, len(n) - 1)), pa.array(n)], ["space", "word", "n"])

    rows = documents.select("text").mapInArrow(run, "space int, word long, n long").groupBy("space", "word").agg(F.sum("n").alias("n")).collect()
    out = [np.zeros(len(known) + 1, np.int64) for known, _ in each]
    for r in rows:
        out[r["space"]][r["word"] + 1] = r["n"]
    return [(n[1:], int(n[0])) for n in out]


def seeds_of(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of SEED words of each item, or of all its words if it has fewer, by length of run."""
    w = normal(column)
    out = []
    for n in np.unique(np.minimum(w.counts[w.counts > 0], SEED)).tolist():
        h, _, item = K.windows(w, n)
        use = np.minimum(w.counts[item], SEED) == n
        order = np.lexsort((item[use], h[use]))
        h, item = h[use][order], item[use][order]
        fresh = np.append(True, (h[1:] != h[:-1]) | (item[1:] != item[:-1]))
        hashes, first = np.unique(h[fresh], return_index=True)
        out.append((n, hashes, np.append(first, fresh.sum()), item[fresh]))
    return out


def seeded(w: K.Words, block: np.ndarray, seeds: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], items: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, item) of each block in which a seed of the item begins."""
    keys = [np.zeros(0, np.int64)]
    for n, hashes, first, owner in seeds:
        h, at, _ = K.windows(w, n)
        number = look_up(hashes, h)
        hit = np.flatnonzero(number >= 0)
        many = first[number[hit] + 1] - first[number[hit]]
        item = owner[np.repeat(first[number[hit]], many) + K.ranges(many)]
        keys.append(np.unique(np.repeat(block[at[hit]], many) * items + item))
    key = np.unique(np.concatenate(keys))
    return key // items, key % items


def tfidf(number: np.ndarray, row: np.ndarray, n: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, weight) of unit rows; number -1 and words of weight 0 are left out."""
    use = (number >= 0) & (idf[number] > 0)
    key, tf = np.unique(row[use] * len(idf) + number[use], return_counts=True)
    row, word = key // len(idf), key % len(idf)
    weight = (1 + np.log(tf)) * idf[word]
    norm = np.sqrt(np.bincount(row, weight * weight, minlength=n))
    return row, word, weight / norm[row]


def segment_sums(matrix: np.ndarray, at: np.ndarray, weight: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of matrix[at] * weight over the segments that begin at `start` (none is empty)."""
    count = np.diff(np.append(start, len(at)))
    pieces = -(-count // PIECE)
    place = K.ranges(pieces) * PIECE
    first = np.repeat(start, pieces) + place
    length = np.minimum(np.repeat(count, pieces) - place, PIECE)
    order = np.argsort(-length, kind="stable")
    out = np.empty((len(first), matrix.shape[1]), matrix.dtype)
    for i in range(0, len(order), 1024):  # few enough for the cache; term by term, as reduceat is slow by rows
        own = order[i : i + 1024]
        sums = np.zeros((len(own), matrix.shape[1]), matrix.dtype)
        for k in range(int(length[own[0]])):
            j = first[own[: np.searchsorted(-length[own], -k)]] + k
            sums[: len(j)] += matrix[at[j]] * weight[j, None]
        out[own] = sums
    return out if len(out) == len(start) else np.add.reduceat(out, np.cumsum(pieces) - pieces, axis=0)


def project(row: np.ndarray, word: np.ndarray, weight: np.ndarray, n: int, matrix: np.ndarray) -> np.ndarray:
    """Sparse rows (sorted) times the matrix."""
    out = np.zeros((n, matrix.shape[1]), matrix.dtype)
    if len(row):
        at = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[at]] = segment_sums(matrix, word, weight.astype(matrix.dtype), at)
    return out


def _gram(row, word, weight, n, matrix) -> np.ndarray:
    """A'(A matrix) of sparse rows."""
    y = project(row, word, weight, n, matrix)
    order = np.argsort(word, kind="stable")
    out = np.zeros_like(matrix)
    if len(order):
        at = np.flatnonzero(np.diff(word[order], prepend=-1))
        out[word[order][at]] = segment_sums(y, row[order], weight[order].astype(matrix.dtype), at)
    return out


@dataclass
class Query:
    """A block of items: what is looked for, and (once counted) the weights of its words."""

    ids: np.ndarray
    words: list[np.ndarray]
    seeds: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]
    size: int
    vocabulary: np.ndarray
    idf: np.ndarray | None = None
    total: int = 0

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        number = look_up(self.vocabulary, np.concatenate(self.words))
        return *tfidf(number, np.repeat(np.arange(len(self.words)), [len(x) for x in self.words]), len(self.words), self.idf), len(self.words)


def query_of(items: DataFrame) -> Query | None:
    got = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL").toArrow()
    w = normal(got["text"].combine_chunks())
    every = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
    keep = [i for i, x in enumerate(every) if len(x)]
    if not keep:
        return None
    words = [every[i] for i in keep]
    seeds = seeds_of(got["text"].combine_chunks().take(pa.array(keep)))
    return Query(got["item_id"].to_numpy()[keep], words, seeds, max(8, -(-max(map(len, words)) // 2)), np.unique(np.concatenate(words)))


def latent(passages: DataFrame, queries: list[Query], rank: int, rounds: int = 1) -> list[np.ndarray]:
    """Bases (vocabulary x rank) of the randomised SVD of all passages of passages (text) and of the items, one for each block of items.

    Each task has partial products of its passages; they are added up by rows of the matrix in Spark, so what
    reaches the driver is one matrix for each block of items.
    """
    spark, start = passages.sparkSession, []
    for q in queries:
        row, word, weight, n = q.rows()
        wide = min(max(rank, n + SPARE), len(q.vocabulary))
        m = np.random.default_rng(3).standard_normal((len(q.vocabulary), wide)).astype(np.float32)
        known = np.zeros((len(q.vocabulary), n), np.float32)
        known[word, row] = weight
        m[:, : min(n, wide)] = known[:, :wide]
        start.append(np.linalg.qr(m)[0])

    def products(bases: list[np.ndarray]) -> list[np.ndarray]:
        shared = spark.sparkContext.broadcast([(q.vocabulary, q.idf, q.size, m) for q, m in zip(queries, bases)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            K.lean()
            sums = [np.zeros_like(m) for *_, m in shared.value]
            for b in batches:
                for i, j in K.slices(b["text"]):
                    w = normal(b["text"].slice(i, j - i))
                    for (known, idf, size, m), y in zip(shared.value, sums):
                        block, text = blocks(w, size)
                        y += _gram(*tfidf(look_up(known, w.hash), block, len(text), idf), len(text), m)
            for k, y in enumerate(sums):
                cut = range(0, len(y), ROWS)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(cut), pa.int32()), pa.array(list(cut), pa.int32()), pa.array([y[a : a + ROWS].tobytes() for a in cut], pa.binary())], ["space", "row", "y"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for r in range(b.num_rows):
                    y = np.frombuffer(b["y"][r].as_buffer(), np.float32)
                    total = y.astype(np.float64) if total is None else total + y
                    first = b.select(["space", "row"]).slice(r, 1)
            yield pa.RecordBatch.from_arrays([*first.columns, pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["space", "row", "y"])

        # One task a core: there is one partial product for each.
        each = passages.select("text").coalesce(max(2, spark.sparkContext.defaultParallelism)).mapInArrow(run, "space int, row int, y binary")
        out = [np.zeros_like(m) for m in bases]
        for r in each.groupBy("space", "row").applyInArrow(add, "space int, row int, y binary").collect():
            m = out[r["space"]]
            m[r["row"] : r["row"] + ROWS] = np.frombuffer(r["y"], np.float32).reshape(-1, m.shape[1])
        return out

    for _ in range(rounds):
        found = products(start)
        start = [np.linalg.qr(_gram(*q.rows(), m) * np.float32(max(1.0, ITEM_WEIGHT * q.total)) + y)[0].astype(np.float32) for q, m, y in zip(queries, start, found)]
    return start


def lcs(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Length of the longest common subsequence of words, and of that of b's last ANSWER words (bit-parallel)."""
    def length(x: list[int], y: list[int]) -> int:
        where: dict[int, int] = {}
        for i, v in enumerate(y):
            where[v] = where.get(v, 0) | 1 << i
        full = (1 << len(y)) - 1
        s = full
        for v in x:
            m = where.get(v)
            if m:
                u = s & m
                s = ((s + u) | (s - u)) & full
        return len(y) - bin(s).count("1")

    x, y = a.tolist(), b.tolist()
    return length(x, y), length(x, y[-ANSWER:])


def spaces_of(documents: DataFrame, queries: list[Query], rank: int) -> list[Space]:
    """The latent spaces of some blocks of items, by two passes over the documents."""
    for q, (n, total) in zip(queries, document_frequency(documents, [(q.vocabulary, q.size) for q in queries])):
        q.idf, q.total = np.maximum(np.log((total + 1) / (n + 1)), LEAST_IDF), total
    out = []
    for q, basis in zip(queries, latent(documents, queries, rank)):
        y = project(*q.rows(), basis)
        unit = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
        out.append(Space(q.vocabulary, q.idf.astype(np.float32), float(np.median(q.idf)), basis, q.size, unit, q.ids, q.words, q.seeds))
    K.trim()
    return out


def search(column: pa.Array, s: Space, least: float) -> list[tuple[int, int, float, float, bool]]:
    """(text, item number, cosine, share of the longest common subsequence, answer found) of verified passages.

    A passage is three consecutive blocks, so that it holds every run of words as long as the longest item; runs of
    one and two blocks are tried too, since short items stand out more in them.  A seed makes a candidate of the
    passage about it, whatever its cosine.
    """
    w = normal(column)
    if not len(w.hash):
        return []
    block, text = blocks(w, s.block)
    number = look_up(s.vocabulary, w.hash)
    weight = np.where(number >= 0, s.idf[number], s.other)
    square = np.bincount(block, weight * weight, minlength=len(text))
    use = np.flatnonzero((number >= 0) & (weight > 0))
    y = project(block[use], number[use], weight[use], len(text), s.basis)
    start = np.flatnonzero(np.diff(block, prepend=-1))
    end = np.append(start[1:], len(block))
    found: dict[tuple[int, int], tuple[float, int]] = {}
    for span in (1, 2, 3):
        at = np.flatnonzero(text[span - 1 :] == text[: len(text) - span + 1]) if len(text) >= span else np.zeros(0, int)
        z = sum(y[at + k] for k in range(span))
        norm = np.sqrt(sum(square[at + k] for k in range(span)))
        able = np.flatnonzero(np.sqrt(np.einsum("ij,ij->i", z, z)) >= least * norm)  # no item can reach more
        able = able[norm[able] > 0]
        at = at[able]
        cosine = (z[able] / norm[able, None]) @ s.items.T
        for i, j in zip(*np.nonzero(cosine >= least)):
            key = (int(at[i]), int(j))
            if key not in found or found[key][0] < cosine[i, j]:
                found[key] = (float(cosine[i, j]), span)
    for b, j in zip(*(x.tolist() for x in seeded(w, block, s.seeds, len(s.ids)))):
        b -= b > 0 and text[b - 1] == text[b]  # an item begins at most two blocks before one of its seeds
        if (b, j) not in found:
            z, q, best = 0.0, 0.0, 0.0
            for k in range(b, min(b + 3, len(text))):
                if text[k] != text[b]:
                    break
                z, q = z + float(y[k] @ s.items[j]), q + square[k]
                best = max(best, z / float(np.sqrt(q))) if q > 0 else best
            found[b, j] = (best, 0)
    out, lists, seen = {}, [x.tolist() for x in s.words], (None, frozenset())
    for (b, j), (cosine, _) in sorted(found.items()):
        lo, hi = max(b - 1, 0), min(b + 4, len(text))
        while text[lo] != text[b]:
            lo += 1
        while text[hi - 1] != text[b]:
            hi -= 1
        item = s.words[j]
        if seen[0] != (lo, hi):
            seen = (lo, hi), frozenset(w.hash[start[lo] : end[hi - 1]].tolist())
        if sum(x in seen[1] for x in lists[j]) < PARAPHRASE * len(item):  # no subsequence can hold more
            continue
        common, answer = lcs(w.hash[start[lo] : end[hi - 1]], item)
        share, last = common / len(item), answer >= min(ANSWER, len(item))
        if share >= LCS or share >= PARAPHRASE and last:
            key = (int(text[b]), j)
            if key not in out or out[key][1] < share:
                out[key] = (max(cosine, out.get(key, (0,))[0]), share, last)
    return [(t, j, *v) for (t, j), v in out.items()]


HITS = "doc_id long, item_id long, cosine double, lcs double, answer boolean"


def by_length(benchmark: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(item_id, text, length class) of items with words, and the number of items of each class; class 0 has the longest."""
    n = F.size(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9[^\x00-\x7F]]+"), F.lit(0)))
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text", n.alias("__n")).where("__n > 0")
    longest = items.agg(F.max("__n")).first()[0] or 0
    steps = []
    while longest >= LENGTHS ** (len(steps) + 1):
        steps.append(F.when(F.col("__n") * LENGTHS ** (len(steps) + 1) <= longest, 1).otherwise(0))
    items = items.select("item_id", "text", sum(steps, F.lit(0)).alias("__class"))
    return items, {r["__class"]: r["count"] for r in items.groupBy("__class").count().collect()}


def spaces(documents: DataFrame, benchmark: DataFrame, rank: int) -> Iterator[list[Space]]:
    """The latent spaces of the blocks of at most about ITEMS items of like length, TOGETHER blocks at a time."""
    items, counts = by_length(benchmark)
    held: list[Query] = []
    for c, n in sorted(counts.items()):
        own, parts = items.where(F.col("__class") == c), max(1, -(-n // ITEMS))
        for k in range(parts):
            block = own.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) if parts > 1 else own
            if (q := query_of(block)) is not None:
                held.append(q)
            if len(held) == TOGETHER:
                yield spaces_of(documents, held, rank)
                held = []
    if held:
        yield spaces_of(documents, held, rank)


def contaminated(documents: DataFrame, benchmark: DataFrame, rank: int = RANK, least: float = COSINE) -> DataFrame:
    """doc_id, item_id, cosine, lcs (share of the item's words), answer for each pair of a document and an item it holds.

    Null and wordless texts and items match nothing; null ids are left out; rows that repeat an id count once, with
    their best passage; a share of exactly LCS (or PARAPHRASE) counts.  A very long text is searched passage by passage, to
    its end.  Other columns of documents and benchmark are not read.
    """
    out = documents.sparkSession.createDataFrame([], HITS)
    for s in spaces(documents, benchmark, rank):
        shared = documents.sparkSession.sparkContext.broadcast(s)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            K.lean()
            for b in batches:
                for i, j in K.slices(b["text"]):
                    for own in shared.value:
                        hits = search(b["text"].slice(i, j - i), own, least)
                        t, item, cosine, share, answer = zip(*hits) if hits else [()] * 5
                        yield pa.RecordBatch.from_arrays([b["doc_id"].slice(i, j - i).take(pa.array(t, pa.int64())), pa.array(own.ids[list(item)] if hits else [], pa.int64()), pa.array(cosine, pa.float64()), pa.array(share, pa.float64()), pa.array(answer, pa.bool_())], ["doc_id", "item_id", "cosine", "lcs", "answer"])

        out = out.union(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL").mapInArrow(run, HITS))
    return out.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"), F.max("answer").alias("answer"))


def clean(documents: DataFrame, benchmark: DataFrame, rank: int = RANK, least: float = COSINE) -> DataFrame:
    """The rows of documents (all columns) that hold no item of the benchmark, without a shuffle."""
    out = documents
    for s in spaces(documents, benchmark, rank):
        shared = documents.sparkSession.sparkContext.broadcast(s)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            K.lean()
            for b in batches:
                for i, j in K.slices(b["text"]):
                    keep = np.ones(j - i, bool)
                    for own in shared.value:
                        keep[[h[0] for h in search(b["text"].slice(i, j - i), own, least)]] = False
                    yield b.slice(i, j - i).filter(pa.array(keep))

        out = out.mapInArrow(run, documents.schema)
    return out


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
