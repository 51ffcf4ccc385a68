"""MinHash near-duplicates with DartMinHash signatures.

A document is a weighted set of word shingles.  Every element owns a strip of the plane (weight x rank) in which a
fixed Poisson process of darts lies, drawn from hashes of the element alone.  A document sees the darts below
its weights and below a rank that leaves about k ln k + 2k of them; each dart belongs to one of k coordinates and the
earliest of each coordinate is the signature (where a coordinate stays empty, the rank is raised).  Two documents
agree on a coordinate with the probability of their weighted Jaccard similarity, at a cost of O(elements + k log k).

Bands of the signature give buckets.  Copies with equal shingle sets are merged first.  Then every document of a
bucket is compared with one hub of it, chosen at random for each band (a hub of many partners in shares of FAN); pairs are
verified on the exact shingle sets and joined to components.  A bucket whose documents aren't of one component yet goes to a second pass that
compares all its pairs across components, in blocks.  So no bucket emits all its pairs, and no link between
components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .common import dropped, read, stored
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
#: 26 bands of 5: a pair of similarity 0.8 shares no band with probability 3e-5, one of 0.4 shares one with 0.24.
BANDS, ROWS = 26, 5


def shingles(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hash, text) of every distinct shingle with repeats as neighbours; texts of 1 to size-1 words are one shingle."""
    w = K.words(column)
    h, _, text = K.windows(w, size)
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    return np.concatenate([h, K.whole(w)[short]]), np.concatenate([text, short])


def sets(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) sorted, and how often each occurs."""
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return h[at], text[at], np.diff(np.append(at, len(h)))


def _poisson(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Poisson counts of u in [0, 1) for each mean (few different means)."""
    out = np.zeros(len(u), np.int64)
    for m in np.unique(mean):
        rows = np.flatnonzero(mean == m)
        k = np.arange(int(m + 12 * np.sqrt(m) + 24))
        with np.errstate(divide="ignore"):
            logs = k * np.log(m) - m - np.concatenate([[0], np.cumsum(np.log(k[1:]))])
        out[rows] = np.searchsorted(np.cumsum(np.exp(logs)), u[rows], side="right")
    return out


def darts(h: np.ndarray, weight: np.ndarray, most: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element, coordinate, rank, identity) of all darts below each element's weight and rank `most`.

    Cells: weights [0,1), [1,2), [2,4), ... by ranks [0,1), [1,2), [2,4), ...; the number of darts in a cell is
    Poisson with its area, and number, coordinate and place of each depend on the element and the cell only.
    """
    columns = 1 + np.ceil(np.log2(np.maximum(weight, 1.0))).astype(np.int64)
    layers = 1 + np.ceil(np.log2(np.maximum(most, 1.0))).astype(np.int64)
    e = np.repeat(np.arange(len(h)), columns * layers)
    cell = K.ranges(columns * layers)
    column, layer = np.divmod(cell, layers[e]) if columns.max(initial=1) > 1 else (np.zeros(len(cell), np.int64), cell)
    edge = np.concatenate([[0.0], 2.0 ** np.arange(64)])  # lower ends
    span = np.concatenate([[1.0], 2.0 ** np.arange(64)])
    seed = K.mix(h[e] ^ (column.astype(np.uint64) << np.uint64(32) | layer.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    n = _poisson(K.unit(seed), span[layer] * span[column])
    at = np.repeat(np.arange(len(n)), n)
    own = K.mix(seed[at] + (K.ranges(n).astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
    rank = edge[layer][at] + K.unit(K.salted(own, 5)) * span[layer][at]
    below = np.flatnonzero(rank <= most[e[at]])
    at, own, rank = at[below], own[below], rank[below]
    inside = np.flatnonzero(edge[column][at] + K.unit(K.salted(own, 3)) * span[column][at] < weight[e[at]])
    at, own, rank = at[inside], own[inside], rank[inside]
    return e[at], (K.salted(own, 7) % np.uint64(k)).astype(np.int64), rank, own


def signatures(h: np.ndarray, text: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k identities of the earliest dart of each coordinate.  Texts without elements get zeros."""
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(text, weight, minlength=n)
    todo = np.flatnonzero(total > 0)
    most = np.zeros(n)
    most[todo] = (k * np.log(k) + 2 * k) / total[todo]
    while len(todo):
        pick = np.isin(text, todo, assume_unique=False) if len(todo) < n else np.ones(len(text), bool)
        number = np.full(n, -1)
        number[todo] = np.arange(len(todo))
        e, coordinate, rank, own = darts(h[pick], weight[pick], most[text[pick]], k)
        slot = number[text[pick][e]] * k + coordinate
        order = np.argsort(rank)[::-1]  # the last that is written is the earliest dart
        sig, have = np.zeros(len(todo) * k, np.uint64), np.zeros(len(todo) * k, bool)
        sig[slot[order]], have[slot] = own[order], True
        done = have.reshape(-1, k).all(1)
        out[todo[done]] = sig.reshape(-1, k)[done]
        todo = todo[~done]
        most[todo] *= 2
    return out


def bands(sig: np.ndarray, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """n x count hashes; the band's number is part of each."""
    out = np.zeros((len(sig), count), np.uint64)
    for b in range(count):
        x = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            x = K.mix(x * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + r])
        out[:, b] = x
    return out


SIGNED = "id long, key1 long, key2 long, n int, bands array<long>, elements binary"


def sign(documents: DataFrame, size: int = SHINGLE, count: int = BANDS, rows: int = ROWS, multiset: bool = False) -> DataFrame:
    """Signature rows of documents (id long, text) that hold a word.

    key1, key2: checksum of the shingle set (equal for copies).  elements: sorted 32-bit hashes of the distinct
    shingles.  multiset: shingles weigh as often as they occur, else 1 each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.lean()
        for b in batches:
            for i, j in K.slices(b["text"], 2 << 20):
                h, text, times = sets(*shingles(b["text"].slice(i, j - i), size))
                weight = times.astype(float) if multiset else np.ones(len(h))
                n = np.bincount(text, minlength=j - i)
                one, two = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                w = weight.astype(np.uint64)
                np.add.at(one, text, K.salted(h, 11) * w)
                np.add.at(two, text, K.salted(h, 13) * w)
                keep = np.flatnonzero(n)
                signed = bands(signatures(h, text, weight, j - i, count * rows)[keep], count, rows).view(np.int64)
                small = (h >> np.uint64(32)).astype(np.uint32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keep) * count + 1, count, dtype=np.int32)), pa.array(signed.ravel()))
                yield pa.RecordBatch.from_arrays([b["id"].slice(i, j - i).take(pa.array(keep)), pa.array(one[keep].view(np.int64)), pa.array(two[keep].view(np.int64)), pa.array(n[keep].astype(np.int32)), lists, K.binary_array(small, n[keep])], ["id", "key1", "key2", "n", "bands", "elements"])

    return documents.select("id", "text").mapInArrow(run, SIGNED)


def alike(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity of the i-th sets of a and b (distinct items, joined; na, nb: their sizes)."""
    n = len(na)
    both = np.sort(np.concatenate([np.repeat(np.arange(n), na).astype(np.uint64) << np.uint64(32) | a.astype(np.uint64), np.repeat(np.arange(n), nb).astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)]))
    common = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=n) if len(both) else np.zeros(n)
    return common / np.maximum(na + nb - common, 1)


#: Rows of one hub that a task gets at a time: its elements are copied once for each so many partners.
FAN = 256


def verified(pairs: DataFrame, elements: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of `least` or more, from pairs (a, b, hub, salt, salts).

    A hub meets its partners under keys (hub, salt), so that one with very many of them spreads over tasks.
    """
    copies = pairs.groupBy("hub").agg(F.max("salts").alias("__k"))
    one = elements.select(F.col("id").alias("hub"), F.col("elements").alias("x")).join(copies.hint("merge"), "hub").select("hub", "x", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)).alias("salt"))
    two = elements.select(F.col("id").alias("other"), F.col("elements").alias("y"))
    met = pairs.withColumn("other", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a"))).hint("merge")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                c = batch.slice(i, 500)
                (x, nx), (y, ny) = K.rows(c["x"], np.uint32), K.rows(c["y"], np.uint32)
                yield c.select(["a", "b"]).filter(pa.array(alike(x, nx, y, ny) >= least - 1e-12))

    return met.join(two, "other").join(one.hint("merge"), ["hub", "salt"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


BLOCK = 256


def across(members: DataFrame, least: float) -> DataFrame:
    """Links between documents of different components in one bucket: members (bucket, id, root, n, elements).

    Buckets are cut into blocks by a hash; every pair of blocks is a group, so a large bucket spreads over tasks.
    In a group each document of one component is compared with those of all others whose size permits a link.
    """
    sized = members.join(members.groupBy("bucket").agg(F.count("*").alias("__m")), "bucket")
    cut = sized.withColumn("__k", F.ceil(F.col("__m") / BLOCK).cast("int")).withColumn("__i", F.pmod(F.xxhash64("id"), F.col("__k")).cast("int"))
    lower, upper = F.least("__i", "__j"), F.greatest("__i", "__j")
    dealt = cut.withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("__k") - 1))).withColumn("lo", lower).withColumn("hi", upper)
    return dealt.select("bucket", "lo", "hi", "id", "root", "n", "elements").groupBy("bucket", "lo", "hi").applyInArrow(lambda t: _compare(t, least), "a long, b long").distinct()


def _compare(t: pa.Table, least: float) -> pa.Table:
    ids, root, n = (t[c].to_numpy() for c in ("id", "root", "n"))
    flat, counts = K.rows(t["elements"], np.uint32)
    order = np.argsort(n, kind="stable")
    begin = np.cumsum(counts) - counts
    found = []
    owner = np.repeat(np.arange(len(ids)), counts)
    for at, i in enumerate(order):
        later = order[at + 1 :]
        later = later[(n[later] * least <= n[i]) & (root[later] != root[i])]
        if not len(later):
            continue
        mine = flat[begin[i] : begin[i] + counts[i]]
        pick = np.zeros(len(ids), bool)
        pick[later] = True
        rows = np.flatnonzero(pick[owner])
        hit = np.bincount(owner[rows], np.isin(flat[rows], mine), minlength=len(ids))[later]
        for j in later[hit / (n[i] + n[later] - hit) >= least - 1e-12]:
            found.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def near_duplicates(documents: DataFrame, size: int = SHINGLE, least: float = SIMILARITY, count: int = BANDS, rows: int = ROWS, multiset: bool = False) -> DataFrame:
    """doc_id, component_id (smallest id reachable by links), kept (doc_id = component_id), for every distinct id.

    Null and wordless texts link with nothing.  Rows that repeat an id count as one document with the links of all
    of them; a null id is left out.  Other columns of the input are not read.
    """
    base = documents.select(F.col("doc_id").cast("long").alias("id"), "text").where("id IS NOT NULL")
    signed = stored(sign(base, size, count, rows, multiset), "signed")
    lead = signed.groupBy("key1", "key2").agg(F.min("id").alias("rep"))
    member = stored(signed.select("id", "key1", "key2").join(lead, ["key1", "key2"]).select("id", "rep"), "member", small=True)
    # The joins with bands and elements are merge joins at every size, so that the cost keeps in proportion to the input.
    chosen = signed.select("id", "bands").join(member.where("id = rep").select("id").distinct().hint("merge"), "id", "left_semi")
    exploded = chosen.select("id", F.explode("bands").alias("bucket"))
    hub = exploded.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bucket", "id").alias("p"), F.col("id").alias("hub"))).alias("h"), F.count("*").alias("m")).where("m > 1").select("bucket", F.col("h.hub").alias("hub"), F.ceil(F.col("m") / FAN).cast("int").alias("salts"))
    bucketed = stored(exploded.join(hub, "bucket"), "bucketed", small=True)
    involved = bucketed.select("id").distinct()
    elements = stored(signed.select("id", "n", "elements").join(involved.hint("merge"), "id", "left_semi"), "elements")
    dropped(signed)
    met = bucketed.where("id != hub").select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b"), F.struct("salts", "hub", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt")).alias("s"))
    pairs = met.groupBy("a", "b").agg(F.min("s").alias("s")).select("a", "b", "s.hub", "s.salt", "s.salts")
    links = stored(verified(pairs, elements, least), "links", small=True)
    root = components(links)
    rooted = bucketed.select("bucket", "id").join(root, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
    rest = stored(rooted.join(mixed, "bucket", "left_semi"), "rest", small=True)
    more = stored(across(rest.join(elements, "id"), least), "links", small=True)
    dropped(elements, bucketed)
    own = member.where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    full = components(links.union(more).union(own))
    ids = base.select("id").distinct()
    return ids.join(full, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("root", "id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op1_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
