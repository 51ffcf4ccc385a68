"""Periodic run detection (operator 11): the runs theorem, over the words of every document.

A run is a maximal stretch of words with a smallest period.  By the runs theorem every run that repeats twice or more holds
its Lyndon root as the longest Lyndon word from some place, under the order of words or its reverse.  So the candidates
are two for each word: from place i to the next smaller, and to the next greater, value of the inverse suffix array.
A candidate of period p is extended to both sides by longest common prefixes of suffixes i and i+p: of the text, and of the
reversed text.  Both come from LCP arrays and sparse tables of range minima.  What reaches the least length is a run.

Work is done in slices of documents in Arrow batches, without a shuffle: suffixes are ranked by prefix doubling with the
document as the first key, so documents never meet, and only suffixes that are not alone yet take part in a round.  A
slice holds documents of a bounded number of bytes, or one longer document; a table of minima takes 4 log2(n) bytes a word.
LCP arrays are only built where a candidate's first words agree, for the reversed text where a whole period agrees.

Words are `[^\\x20\\x09-\\x0D]+`, told apart by 64-bit hashes; any order of words will do.  Defined cases: a null or empty text
has no words, no runs (null fields) and the hash of the empty string; a null doc_id is reported and never folded; repeated rows
are reported each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernels
from .common import read

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Bytes of text in a slice of documents.
SLICE = 1 << 20
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


@dataclass
class Suffixes:
    """Inverse suffix array of texts laid end to end, each with an end mark; LCP of neighbours in the suffix array."""

    rank: np.ndarray
    order: np.ndarray
    levels: list[np.ndarray]


def suffixes(words: np.ndarray, text: np.ndarray) -> Suffixes:
    """words: numbers > 0 of words, 0 at each text's end; text: number of the text.  Ranks after 1, 2, 4, ... words, until each suffix has its own.

    Ranks count the suffixes that are less, so a suffix that is alone keeps its rank, and rounds sort only the rest.
    """
    n = len(words)
    key = text.astype(np.int64) << 32 | words
    order = np.argsort(key, kind="stable")
    rank = _places(key[order])
    at = np.empty(n, np.int64)
    at[order] = rank
    levels, width = [at], 1
    alone = np.flatnonzero(np.bincount(at, minlength=n)[at] > 1)
    while len(alone):
        # A repeated suffix never is an end mark, and its next `width` words lie in its own text.
        group, after = at[alone], at[np.minimum(alone + width, n - 1)]
        by = np.lexsort((after, group))
        alone, group, after = alone[by], group[by], after[by]
        first = np.ones(len(alone), bool)
        first[1:] = group[1:] != group[:-1]
        change = first.copy()
        change[1:] |= after[1:] != after[:-1]
        place = np.arange(len(alone))
        new = group + np.maximum.accumulate(np.where(change, place, 0)) - np.maximum.accumulate(np.where(first, place, 0))
        at = at.copy()
        at[alone] = new
        levels.append(at)
        width *= 2
        single = change.copy()
        single[:-1] &= change[1:]
        alone = alone[~single]
    order = np.empty(n, np.int64)
    order[at] = np.arange(n)
    return Suffixes(at, order, levels)


def _places(ordered: np.ndarray) -> np.ndarray:
    """Place of the first equal value, for sorted values."""
    change = np.ones(len(ordered), bool)
    change[1:] = ordered[1:] != ordered[:-1]
    return np.maximum.accumulate(np.where(change, np.arange(len(ordered)), 0))


def lcp(s: Suffixes) -> np.ndarray:
    """Words that each suffix shares with the one before it in the suffix array."""
    n = len(s.rank)
    a, b, out = s.order[:-1].copy(), s.order[1:].copy(), np.zeros(n, np.int64)
    for k in range(len(s.levels) - 1, -1, -1):
        level = s.levels[k]
        same = np.flatnonzero(level[np.minimum(a, n - 1)] == level[np.minimum(b, n - 1)])
        a[same] += 1 << k
        b[same] += 1 << k
        out[1:][same] += 1 << k
    return out


class Minima:
    """Sparse table of range minima."""

    def __init__(self, values: np.ndarray):
        self.rows = [values.astype(np.int32)]
        while 2 << (len(self.rows) - 1) <= len(values):
            last, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least of values[low:high], low < high."""
        out = np.empty(len(low), np.int64)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            m = level == k
            row = self.rows[k]
            out[m] = np.minimum(row[low[m]], row[high[m] - (1 << k)])
        return out

    def next_less(self, values: np.ndarray) -> np.ndarray:
        """For each i the least j > i with values[j] < values[i], else the number of values: ever shorter strides over ranges with no less value."""
        n, at = len(values), np.arange(1, len(values) + 1)
        for k in range(len(self.rows) - 1, -1, -1):
            row = self.rows[k]
            can = np.flatnonzero(at + (1 << k) <= n)
            on = can[row[at[can]] >= values[can]]
            at[on] += 1 << k
        return at


def extension(s: Suffixes, table: Minima, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that suffixes i and j share."""
    a, b = s.rank[i], s.rank[j]
    return table.of(np.minimum(a, b) + 1, np.maximum(a, b) + 1)


def runs(words: np.ndarray, first: np.ndarray, least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows (text, start, length, period), in order, of all runs of length >= max(least, exponent * period); exponent is 2 at least.

    words: numbers > 0; text t is words[first[t]:first[t + 1]].
    """
    count = np.diff(first)
    total = len(words) + len(count)
    text = np.repeat(np.arange(len(count)), count + 1)
    begin = first[:-1] + np.arange(len(count))
    end = begin + count  # places of the end marks
    laid = np.zeros(total, np.int64)
    laid[np.arange(len(words)) + np.repeat(np.arange(len(count)), count)] = words
    s = suffixes(laid, text)
    inverse = s.rank
    smaller = Minima(inverse).next_less(inverse)
    # Under the reverse order the end mark is greatest of all, so the longest Lyndon word may reach the end.
    greater = np.minimum(Minima(-inverse).next_less(-inverse), end[text])
    at = np.flatnonzero(laid > 0)
    i = np.concatenate([at, at])
    p = np.concatenate([smaller[at], greater[at]]) - i
    # The first root in a run begins less than p words in, so more than `exponent` - 2 periods follow the one it opens.
    fits = (i + (exponent - 1) * p < end[text[i]]) & (laid[i] == laid[np.minimum(i + p, total - 1)])
    i, p = i[fits], p[fits]
    if not len(i):
        return np.zeros((0, 4), np.int64)
    ahead = extension(s, Minima(lcp(s)), i, i + p)
    fits = ahead > (exponent - 2) * p
    i, p, ahead = i[fits], p[fits], ahead[fits]
    if not len(i):
        return np.zeros((0, 4), np.int64)
    # The same for the reversed texts of those documents only.
    docs, own = np.unique(text[i], return_inverse=True)
    sizes = count[docs] + 1
    starts = np.cumsum(sizes) - sizes
    place = kernels.ranges(sizes)
    source = np.repeat(end[docs], sizes) - 1 - place
    back = np.where(place < np.repeat(sizes - 1, sizes), laid[np.maximum(source, 0)], 0)
    r = suffixes(back, np.repeat(np.arange(len(docs)), sizes))
    mirror = starts[own] + end[docs[own]] - i  # the reversed suffix that begins with the word before i
    behind = extension(r, Minima(lcp(r)), mirror - p, mirror)
    length = ahead + behind + p
    found = np.stack([text[i], i - behind - begin[text[i]], length, p], 1)[length >= np.maximum(least, exponent * p)]
    return np.unique(found, axis=0)


def folded(n: int, doc_id: int | None) -> np.ndarray | None:
    """Source of each word where crc32 of the id is divisible by ten: from word a on, the first p words there come round again."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + np.arange(n - a) % p
    return out


def joined(w: kernels.Words, chosen: np.ndarray) -> bytes:
    """The words of these numbers, joined by one space."""
    if not len(chosen):
        return b""
    size = w.end[chosen] - w.start[chosen] + 1
    offset = kernels.ranges(size)
    out = w.buf[np.minimum(np.repeat(w.start[chosen], size) + offset, len(w.buf) - 1)]
    out[np.cumsum(size) - 1] = 0x20
    return out[:-1].tobytes()


def report(ids: list[int | None], texts: pa.Array) -> list[tuple]:
    """Rows of SCHEMA for a slice of documents."""
    w = kernels.words(texts)
    first = w.first
    source = np.arange(len(w.hash))
    for k, doc_id in enumerate(ids):
        fold = folded(int(first[k + 1] - first[k]), doc_id)
        if fold is not None:
            source[first[k] : first[k + 1]] = first[k] + fold
    number = np.unique(w.hash[source], return_inverse=True)[1] + 1
    found = runs(number, first)
    cut = np.searchsorted(found[:, 0], np.arange(len(ids) + 1))
    out = []
    for k, doc_id in enumerate(ids):
        own, n = found[cut[k] : cut[k + 1], 1:], int(first[k + 1] - first[k])
        chosen = source[first[k] : first[k + 1]]
        if len(own):
            start, length, period = own.T
            steps = np.zeros(n + 1, np.int64)
            np.add.at(steps, start + period, 1)
            np.add.at(steps, start + length, -1)
            chosen = chosen[np.cumsum(steps)[:n] == 0]
            best = 0
            for j in range(1, len(own)):  # exact fractions; the first of equals has the least start, then period
                if int(length[j]) * int(period[best]) > int(length[best]) * int(period[j]):
                    best = j
            top = [int(x) for x in own[best]]
            top.append(1000 * top[1] // top[2])
        else:
            top = [None] * 4
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in own.tolist())
        out.append((doc_id, len(own), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(joined(w, chosen)).hexdigest()))
    return out


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kernels.lean()
    types = [pa.int64()] * 6 + [pa.string()] * 2
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        for a, b in kernels.slices(texts, SLICE):
            rows = report(ids[a:b], texts.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def periodic_runs(documents: DataFrame) -> DataFrame:
    """Per document the number of its runs, its most repetitive run, and hashes of all runs and of the text without repeats."""
    return documents.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(_reports, SCHEMA)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(read(spark, sf_dir, "documents"))
