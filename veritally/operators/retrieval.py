"""Nearest neighbours by cosine, exact: blocks of queries meet blocks of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

#: Rows of a block of either side that a task holds at a time.
ROWS = 1 << 15
#: Cosines that a task works out at once, and pairs that it looks at again.
CELLS, PAIRS = 1 << 20, 1 << 16
#: Above the error of a product of matrices, whose last digits depend on their shapes.
SLACK = 1e-12


def _rows(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one width as a matrix of unit vectors; null components are no numbers, and zero vectors give none either."""
    vectors = vectors.combine_chunks()
    length = pc.list_value_length(vectors)
    width = length[0].as_py() if len(vectors) else 0
    if pc.any(pc.not_equal(length, width)).as_py():
        raise ValueError(f"vectors of another length than {width}")
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), width)
    norm = np.linalg.norm(x, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.where(norm > 0, norm, np.nan)[:, None]


def _best(q: np.ndarray, x: np.ndarray, item: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, item, cosine) of the k rows of x nearest to each row of q; ties go by item."""
    out = []
    step = max(1, CELLS // max(1, len(x)))
    for at in range(0, len(q), step):
        near = q[at : at + step] @ x.T
        least = np.partition(near, -k, axis=1)[:, -k, None] - SLACK if near.shape[1] > k else -np.inf
        row, col = np.nonzero(near >= least)
        # Worked out again in one order of the components, so that equal vectors have equal cosines.
        cosine = np.concatenate([np.empty(0), *[(q[at + row[i : i + PAIRS]] * x[col[i : i + PAIRS]]).sum(1) for i in range(0, len(row), PAIRS)]])
        order = np.lexsort((item[col], -cosine, row))
        row, col, cosine = row[order], col[order], cosine[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((at + row[keep], item[col[keep]], cosine[keep]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), item[:0], np.zeros(0))


def top_cosine(queries: DataFrame, base: DataFrame, k: int = 4, least: float = -1.0) -> DataFrame:
    """query_id, item_id, cosine, rank of the k nearest rows of base(item_id, vector) for each row of queries(query_id, vector).

    Both sides are dealt into blocks of about ROWS rows, and a task compares one of each, so nothing is held whole and
    nothing passes through the driver; k rows a query and block are shuffled.  A query's own id is not left out.  Rows
    without an id or a vector, and zero vectors, match nothing.
    """
    schema = f"query_id {dict(queries.dtypes)['query_id']}, item_id long, cosine double"
    q = queries.where("query_id IS NOT NULL AND vector IS NOT NULL").select("query_id", "vector")
    x = base.where("item_id IS NOT NULL AND vector IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "vector")
    a = max(1, -(-queries.count() // ROWS))
    b = max(1, -(-base.count() // ROWS), -(-3 * base.sparkSession.sparkContext.defaultParallelism // a))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    number = lambda own, other: (own * b + other).alias("task")
    one = q.select("query_id", "vector", place("query_id", a).alias("__a")).select("query_id", "vector", F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("__b"), "__a").select("query_id", "vector", number(F.col("__a"), F.col("__b")))
    two = x.select("item_id", "vector", place("item_id", b).alias("__b")).select("item_id", "vector", F.explode(F.sequence(F.lit(0), F.lit(a - 1))).alias("__a"), "__b").select("item_id", "vector", number(F.col("__a"), F.col("__b")))

    def run(some: pa.Table, others: pa.Table) -> pa.Table:
        names = ["query_id", "item_id", "cosine"]
        mine, theirs = _rows(some["vector"]), _rows(others["vector"])
        if len(mine) and len(theirs) and mine.shape[1] != theirs.shape[1]:
            raise ValueError(f"vectors of {theirs.shape[1]} components for queries of {mine.shape[1]}")
        own, item = ~np.isnan(mine).any(1), ~np.isnan(theirs).any(1)
        if not (own.any() and item.any()):
            return pa.table([some["query_id"].slice(0, 0), others["item_id"].slice(0, 0), pa.array([], pa.float64())], names)
        row, found, cosine = _best(mine[own], theirs[item], others["item_id"].to_numpy()[item], k)
        return pa.table([some["query_id"].take(pa.array(np.flatnonzero(own)[row])), pa.array(found), pa.array(cosine)], names)

    found = one.repartition(a * b, "task").groupBy("task").cogroup(two.repartition(a * b, "task").groupBy("task")).applyInArrow(run, schema)
    w = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "item_id")
    return found.where(F.col("cosine") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
