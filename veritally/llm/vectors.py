"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by three rounds of random signs and fast Hadamard transforms; its hash is the signed axis that it
then lies nearest to.  A table's bucket joins HASHES such axes.  Each vector is filed in one bucket of each of
TABLES tables (WIDE_TABLES if it is wide) and probes PROBES more: those reached by the second- or third-best axes that lose least.  A pair is a
candidate where one is filed and the other is filed or probes; every candidate is verified by its cosine in double
precision.  At a cosine of 0.95 in 64 dimensions this finds 0.9998 of the pairs, and more above.

Equal vectors are merged first.  Buckets are cut into blocks and pairs of blocks are compared by tasks of their own; only
sums of links and spanning edges leave a task, each pair being counted in the first bucket that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .common import read, stored
from .components import components

LEAST, TABLES, HASHES, PROBES = 0.95, 10, 3, 3
BLOCK = 1024
#: Vectors are padded to this width at least, so that rotations differ; from WIDE components on they have more tables.
LEAST_WIDTH, WIDE, WIDE_TABLES = 16, 257, 18


def tables_of(width: int) -> int:
    return WIDE_TABLES if width >= WIDE else TABLES


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the orthonormal Hadamard matrix; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, table: int, number: int) -> np.ndarray:
    width = max(LEAST_WIDTH, 1 << int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    for k in range(3):
        signs = np.random.default_rng([31, table, number, k, width]).choice([-1.0, 1.0], width)
        x = hadamard(x * signs)
    return x


def keys(x: np.ndarray, tables: int | None = None, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """n x tables x (1 + probes) bucket hashes of unit vectors: the own bucket, then the probes by loss."""
    n, tables = len(x), tables or tables_of(x.shape[1])
    out = np.zeros((n, tables, 1 + probes), np.uint64)
    rows = np.arange(n)
    for t in range(tables):
        axes, gains = [], []
        for k in range(hashes):
            y = rotate(x, t, k)
            size = np.abs(y)
            best = np.argsort(-size, axis=1)[:, :3]
            axes.append(best * 2 + (np.take_along_axis(y, best, 1) < 0))
            gains.append(np.take_along_axis(size, best, 1))
        own = np.stack([a[:, 0] for a in axes], 1)
        options = [[(k, r)] for k in range(hashes) for r in range(1, axes[k].shape[1])]
        options += [[(k, 1), (m, 1)] for k in range(hashes) for m in range(k)]
        loss = np.stack([sum(gains[k][:, 0] - gains[k][:, r] for k, r in o) for o in options], 1)
        order = np.argsort(loss, 1, kind="stable")[:, :probes]
        every = np.stack([own] + [own] * len(options), 1)
        for i, o in enumerate(options, 1):
            for k, r in o:
                every[:, i, k] = axes[k][:, r]
        for p in range(1 + probes):
            chosen = own if p == 0 else every[rows, 1 + order[:, p - 1]]
            h = np.full(n, t + 1, np.uint64)
            for k in range(hashes):
                h = K.mix(h * np.uint64(0x9E3779B97F4A7C15) + chosen[:, k].astype(np.uint64))
            out[:, t, p] = h
    return out


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a usable vector, their vectors): none that is null, empty, zero or has null or non-finite components."""
    lists = column.to_pylist() if column.null_count or column.values.null_count else None
    if lists is None:
        size = np.diff(column.offsets.to_numpy())
        width = int(size[0]) if len(size) else 0
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if (size == width).all():
            x = flat.reshape(len(size), width)
            ok = np.isfinite(x).all(1) & (x != 0).any(1) if width else np.zeros(len(size), bool)
            return np.flatnonzero(ok), x[ok]
        lists = column.to_pylist()
    rows = [i for i, v in enumerate(lists) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    return np.array(rows, int), [np.array(lists[i], float) for i in rows]


def hashed(vectors: DataFrame) -> DataFrame:
    """id, own keys of every usable vector; vectors of different lengths never share a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.lean()
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                rows, x = units(part["v"])
                widths = np.array([len(r) for r in x], int)
                for width in np.unique(widths):
                    pick = np.flatnonzero(widths == width)
                    m = np.stack([x[k] for k in pick])
                    m = m / np.abs(m).max(1, keepdims=True)  # no overflow in the norm
                    m /= np.linalg.norm(m, axis=1, keepdims=True)
                    found = K.mix(keys(m) + np.uint64(width)).reshape(len(m), -1)
                    yield pa.RecordBatch.from_arrays([part["id"].take(pa.array(rows[pick])), K.binary_array(m.ravel(), np.full(len(m), width)), pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.view(np.int64).ravel()))], ["id", "unit", "keys"])

    return vectors.mapInArrow(run, "id long, unit binary, keys array<long>")


def _first(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first bucket that pairs of key rows (n x tables x places) share with one of the two filed in it."""
    out = np.zeros(len(a), np.int64)
    todo = np.ones(len(a), bool)
    for t in range(a.shape[1]):
        best = np.full(len(a), np.iinfo(np.int64).max)
        for i in range(a.shape[2]):
            best = np.where(a[:, t, i] == b[:, t, 0], np.minimum(best, b[:, t, 0]), best)
            best = np.where(b[:, t, i] == a[:, t, 0], np.minimum(best, a[:, t, 0]), best)
        new = todo & (best != np.iinfo(np.int64).max)
        out[new] = best[new]
        todo &= ~new
    return out


def _compare(t: pa.Table, least: float) -> pa.Table:
    """Links in one shard of block pairs: id, links (copies of all linked vectors), root (an id it is linked to through links)."""
    bucket, lo, hi, block, ids, times = (t[c].to_numpy() for c in ("bucket", "lo", "hi", "block", "id", "times"))
    filed = t["filed"].to_numpy(zero_copy_only=False)
    order = np.lexsort((block, hi, lo, bucket))
    change = np.ones(len(order), bool)
    for c in (bucket, lo, hi):
        change[1:] &= c[order][1:] == c[order][:-1]
    change[0] = False
    edges = np.append(np.flatnonzero(~change), len(order))
    flat, n = K.rows(t["unit"], np.float64)
    at = np.cumsum(n) - n
    listed = t["keys"].combine_chunks()
    every, begins = listed.flatten().to_numpy(), np.concatenate([[0], np.cumsum(listed.value_lengths().to_numpy(zero_copy_only=False))])

    def own(rows: np.ndarray, width: int) -> np.ndarray:
        size = tables_of(width) * (1 + PROBES)
        return every[begins[rows][:, None] + np.arange(size)].reshape(len(rows), -1, 1 + PROBES)

    links, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for a, b in zip(edges[:-1], edges[1:]):
        rows = order[a:b]
        if len(rows) < 2 or not filed[rows].any():
            continue
        left, right = (rows, rows) if lo[rows[0]] == hi[rows[0]] else (rows[block[rows] == lo[rows[0]]], rows[block[rows] == hi[rows[0]]])
        width = n[rows[0]]
        x, y = (flat[at[r][:, None] + np.arange(width)] for r in (left, right))
        p, q = np.nonzero(x @ y.T >= least)
        p, q = left[p], right[q]
        use = (filed[p] | filed[q]) & ((p < q) if lo[rows[0]] == hi[rows[0]] else True)
        p, q = p[use], q[use]
        for k in range(0, len(p), 100_000):
            u, v = p[k : k + 100_000], q[k : k + 100_000]
            count = _first(own(u, width), own(v, width)) == bucket[rows[0]]
            links += np.bincount(u[count], times[v[count]], minlength=len(ids)).astype(np.int64)
            links += np.bincount(v[count], times[u[count]], minlength=len(ids)).astype(np.int64)
        # A spanning forest of the links: one sweep joins each vector to one partner, the next only what is still apart.
        first = np.unique(p, return_index=True)[1]
        for i in first:
            parent[root(p[i])] = root(q[i])
        tops = parent.copy()
        tops[rows] = [root(i) for i in rows]
        for i in np.flatnonzero(tops[p] != tops[q]):
            parent[root(p[i])] = root(q[i])
    top = np.array([ids[root(i)] for i in range(len(ids))])
    keep = np.flatnonzero((links > 0) | (top != ids))
    return pa.table({"id": ids[keep], "links": links[keep], "root": top[keep]})


def near_vectors(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding).

    Unusable vectors (null, zero, null or non-finite components) get 0 links and their own id.  Rows that repeat an
    id share one component; every row has the links of its own vector, and equal vectors link each other.  A row with a null
    id links with nothing: 0 links, no component, not kept.  Other columns are not read.
    """
    base = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    keyed = base.where("id IS NOT NULL").withColumn("key1", F.xxhash64("v")).withColumn("key2", F.xxhash64(F.lit(17), "v"))
    # Different vectors have numbers of their own, whatever ids they share; the table is written, so that they stay.
    lead = stored(keyed.groupBy("key1", "key2").agg(F.min("id").alias("rep"), F.count("*").alias("times"), F.first("v").alias("v")).withColumn("number", F.monotonically_increasing_id()), "lead", small=True)
    member = stored(keyed.select("id", "key1", "key2").join(lead.select("key1", "key2", "number", "rep", "times"), ["key1", "key2"]).select("id", "number", "rep", "times"), "member", small=True)
    chosen = stored(hashed(lead.select(F.col("number").alias("id"), "v")), "vectors")
    filed = chosen.select("id", F.posexplode("keys").alias("pos", "bucket")).withColumn("filed", F.col("pos") % (1 + PROBES) == 0)
    filed = filed.groupBy("bucket", "id").agg(F.max("filed").alias("filed"))
    full = filed.groupBy("bucket").agg(F.count("*").alias("m"), F.max("filed").alias("any")).where("m > 1 AND any").select("bucket", F.ceil(F.col("m") / BLOCK).cast("int").alias("k"))
    placed = stored(filed.join(full, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int")), "placed", small=True)
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("bucket", "id", "filed", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    rows = placed.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    shard = F.pmod(F.xxhash64("bucket", "lo", "hi"), F.lit(int(rows) // 8000 + 1))
    once = lead.select(F.col("number").alias("id"), "times")
    dealt = spread.join(chosen, "id").join(once, "id").withColumn("shard", shard)
    got = stored(dealt.groupBy("shard").applyInArrow(lambda t: _compare(t, least), "id long, links long, root long"), "links", small=True)
    linked = got.groupBy(F.col("id").alias("number")).agg(F.sum("links").alias("links"))
    named = lambda c: lead.select(F.col("number").alias(c), F.col("rep").alias(c + "_rep"))
    edges = got.where("id <> root").select("id", "root").distinct().join(named("id"), "id").join(named("root"), "root").select(F.col("id_rep").alias("a"), F.col("root_rep").alias("b"))
    usable = chosen.select(F.col("id").alias("number"), F.lit(True).alias("usable"))
    root = components(edges.union(member.join(usable, "number").select("id", "rep")))
    out = member.join(usable, "number", "left").join(linked, "number", "left").join(root, "id", "left")
    n = F.when(F.col("usable").isNull(), F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("times") - 1)
    unnamed = base.where("id IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = out.select("id", n.cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id")).union(unnamed)
    return every.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op8_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
