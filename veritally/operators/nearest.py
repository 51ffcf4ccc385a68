"""One-to-one matching of rows on a line: the results of `matching` where the score falls with the distance of two values.

No pairs are made.  Rows of one value are a class, and classes lie in order; the closest two that are left are neighbours.
A group passes through one task with its rows, in n log n steps.  Rows without a group, an id or a finite value match nothing.
`pages` finds the nearest rows by page and place in the same way.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..sources.shared import cut


class _Side:
    """Ids of one side by class, ascending; those taken are passed over."""

    def __init__(self, ids: list, classes: list[int], count: int):
        self.ids: list[list] = [[] for _ in range(count)]
        for c, i in sorted(zip(classes, ids)):
            self.ids[c].append(i)
        self.at, self.taken = [0] * count, set()

    def first(self, c: int):
        """The least free id of a class, or None."""
        ids, at = self.ids[c], self.at[c]
        while at < len(ids) and ids[at] in self.taken:
            at += 1
        self.at[c] = at
        return ids[at] if at < len(ids) else None

    def free(self, c: int, start: int = 0) -> Iterator:
        for k in range(max(start, self.at[c]), len(self.ids[c])):
            if self.ids[c][k] not in self.taken:
                yield self.ids[c][k]


def _classes(l: list, x: np.ndarray, r: list, y: np.ndarray) -> tuple[list[float], _Side, _Side]:
    values, number = np.unique(np.append(x, y), return_inverse=True)
    of = number.tolist()
    return values.tolist(), _Side(l, of[: len(l)], len(values)), _Side(r, of[len(l) :], len(values))


def _greedy(l: list, x: np.ndarray, r: list, y: np.ndarray, most: float) -> Iterator[tuple]:
    """(left, right, distance) in order of distance, left, right, each taken if both ends are free."""
    values, a, b = _classes(l, x, r, y)
    n = len(values)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[float, int, int]] = []

    def near(i: int, j: int) -> None:
        """Neighbours i and j (or the two ends of one class) may hold a pair."""
        if 0 <= i and j < n and (a.first(i) is not None and b.first(j) is not None or b.first(i) is not None and a.first(j) is not None):
            heapq.heappush(heap, (abs(values[i] - values[j]), i, j))

    for c in range(n):
        near(c, c)
        near(c, c + 1)
    gone = [False] * n
    while heap and heap[0][0] <= most:
        d = heap[0][0]
        touched, rights = set(), {}
        while heap and heap[0][0] == d:
            _, i, j = heapq.heappop(heap)
            if gone[i] or gone[j]:
                continue
            touched |= {i, j}
            for p, q in {(i, j), (j, i)}:
                if a.first(p) is not None and b.first(q) is not None:
                    rights.setdefault(p, []).append(q)
        lefts = [(i, c, k) for c in rights for k, i in [(a.at[c], a.first(c))]]
        heapq.heapify(lefts)
        while lefts:
            left, own = lefts[0][0], []
            while lefts and lefts[0][0] == left:
                _, c, k = heapq.heappop(lefts)
                own.append((c, k))
            free = [i for i in {q: b.first(q) for c, _ in own for q in rights[c]}.values() if i is not None]
            if free and left not in a.taken:
                right = min(free)
                a.taken.add(left)
                b.taken.add(right)
                yield left, right, d
            for c, k in own:
                if k + 1 < len(a.ids[c]) and any(b.first(q) is not None for q in rights[c]):
                    heapq.heappush(lefts, (a.ids[c][k + 1], c, k + 1))
        for c in touched:
            if not gone[c] and a.first(c) is None and b.first(c) is None:
                gone[c] = True
                p, q = before[c], after[c]
                if p >= 0:
                    after[p] = q
                if q < n:
                    before[q] = p
                near(p, q)


def _sequential(l: list, x: np.ndarray, r: list, y: np.ndarray, score: Callable[[float], float], least: float, margin: float) -> Iterator[tuple]:
    """(left, right, score, ambiguous) in order of left: the best free right, then the least."""
    values, number = np.unique(y, return_inverse=True)
    values = values.tolist()
    n = len(values)
    b = _Side(r, number.tolist(), n)
    step = {-1: list(range(n + 1)), 1: list(range(n + 1))}  # of class + 1 down, of class up: to the next that is not empty

    def find(way: int, c: int) -> int:
        """The nearest class from c on in one direction that holds a free row; -1 or n if there is none."""
        links, k = step[way], c + 1 if way < 0 else c
        path, end = [], 0 if way < 0 else n
        while k != end:
            if links[k] == k:
                if b.first(k - 1 if way < 0 else k) is not None:
                    break
                links[k] = k + way
            path.append(k)
            k = links[k]
        for p in path:
            links[p] = k
        return k - 1 if way < 0 else k

    def outward(v: float) -> Iterator[tuple[float, int]]:
        """(score, class) of classes with free rows, nearest first on either side."""
        up = find(1, bisect.bisect_left(values, v))
        down = find(-1, bisect.bisect_left(values, v) - 1)
        while down >= 0 or up < n:
            if up >= n or down >= 0 and abs(v - values[down]) <= abs(v - values[up]):
                yield score(abs(v - values[down])), down
                down = find(-1, down - 1)
            else:
                yield score(abs(v - values[up])), up
                up = find(1, up + 1)

    for left, same in groupby(sorted(zip(l, x.tolist())), key=lambda p: p[0]):
        mine, best, own = None, least, [v for _, v in same]
        for v in own:
            for s, c in outward(v):
                if s < best or not s >= least:
                    break
                right = b.first(c)
                if mine is None or s > best or right < mine:
                    mine, best = right, s
        if mine is None:
            continue
        second = -np.inf
        for v in own:
            for s, c in outward(v):
                if s <= second or s < least:
                    break
                if next((i for i in b.free(c) if i != mine), None) is not None:
                    second = s
                    break
        b.taken.add(mine)
        yield left, mine, best, bool(best - second < margin)


def _matched(a: DataFrame, b: DataFrame, names: list[str], x: str, y: str, run: Callable[..., Iterator[tuple]], more: str) -> DataFrame:
    group, left, right, score = names
    kinds = dict(a.dtypes) | dict(b.dtypes)
    schema = f"{group} {kinds[group]}, {left} {kinds[left]}, {right} {kinds[right]}, {score} double{more}"

    def side(df: DataFrame, ident: str, value: str) -> DataFrame:
        out = df.select(F.col(group).alias("g"), F.col(ident).alias("id"), F.col(value).cast("double").alias("v"))
        return out.where("g IS NOT NULL AND id IS NOT NULL AND v > double('-inf') AND v < double('inf')")

    def match(one: pa.Table, two: pa.Table) -> pa.Table:
        rows = list(run(one["id"].to_pylist(), one["v"].to_numpy(), two["id"].to_pylist(), two["v"].to_numpy())) if len(one) and len(two) else []
        kind = [one["id"].type, two["id"].type, pa.float64(), pa.bool_()][: 3 + bool(more)]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kind), kind)]
        return pa.table([pa.repeat(one["g"][0], len(rows)) if rows else pa.array([], one["g"].type), *columns], schema.replace(",", " ").split()[::2])

    return side(a, left, x).groupBy("g").cogroup(side(b, right, y).groupBy("g")).applyInArrow(match, schema)


def greedy(a: DataFrame, b: DataFrame, group: str, left: str, right: str, x: str, y: str, score: str, most: float = np.inf) -> DataFrame:
    """As matching.greedy of all pairs of a group with the score -|x - y| of -most at least: group, left, right, score."""
    return _matched(a, b, [group, left, right, score], x, y, lambda *rows: ((i, j, -d) for i, j, d in _greedy(*rows, most)), "")


def sequential(a: DataFrame, b: DataFrame, group: str, left: str, right: str, x: str, y: str, score: str, points: Callable[[float], float], least: float, margin: float = 0.0) -> DataFrame:
    """As matching.sequential of all pairs of a group with the score points(|x - y|), which never rises with the distance."""
    return _matched(a, b, [group, left, right, score], x, y, lambda *rows: _sequential(*rows, points, least, margin), ", ambiguous boolean")


def _outward(seqs: list, start: int, end: int, at, most: int) -> list[int]:
    """The rows of one page nearest to a place: those without one first, then by distance, place and order."""
    first = start
    while first < end and first < start + most and seqs[first] is None:
        first += 1
    out = list(range(start, first))
    if at is None:
        return list(range(start, min(end, start + most)))
    if len(out) == most:
        return out
    up = bisect.bisect_left(seqs, at, first, end)
    down = up - 1
    while len(out) < most and (down >= first or up < end):
        if up >= end or down >= first and at - seqs[down] <= seqs[up] - at:
            low = bisect.bisect_left(seqs, seqs[down], first, down + 1)
            out += range(low, min(down + 1, low + most - len(out)))
            down = low - 1
        else:
            high = bisect.bisect_right(seqs, seqs[up], up, end)
            out += range(up, min(high, up + most - len(out)))
            up = high
    return out


def _pages(one: pa.Table, two: pa.Table, top: int) -> pa.Table:
    """pair_id, i, j: of one(i, page, seq, reach) the `top` rows of two(j, page, seq) by pages apart, places apart, place and j."""
    two = two.take(pc.sort_indices(two, sort_keys=[(c, "ascending") for c in ("page", "seq", "j")], null_placement="at_start")) if len(two) else two
    pages, edges = np.unique(two["page"].to_numpy(), return_index=True)
    pages, edges, seqs = pages.tolist(), [*edges.tolist(), len(two)], two["seq"].to_pylist()
    rank = np.empty(len(two), int)
    rank[pc.sort_indices(two["j"]).to_numpy()] = np.arange(len(two))
    rows, found = [], []
    for n, (page, at, reach) in enumerate(zip(*(one[c].to_pylist() for c in ("page", "seq", "reach")))):
        up = bisect.bisect_left(pages, page)
        down, got = up - 1, 0
        while got < top:
            far = min(page - pages[down] if down >= 0 else np.inf, pages[up] - page if up < len(pages) else np.inf)
            if not far <= reach:
                break
            near = []
            if down >= 0 and page - pages[down] == far:
                near += _outward(seqs, edges[down], edges[down + 1], at, top - got)
                down -= 1
            if up < len(pages) and pages[up] - page == far:
                near += _outward(seqs, edges[up], edges[up + 1], at, top - got)
                up += 1
            if len(near) > top - got:
                off = lambda k: (False, 0) if at is None or seqs[k] is None else (True, abs(seqs[k] - at))
                near = sorted(near, key=lambda k: (off(k), seqs[k] is not None, seqs[k] or 0, rank[k]))[: top - got]
            rows += [n] * len(near)
            found += near
            got += len(near)
    return pa.table([one["pair_id"].take(pa.array(rows, pa.int64())), one["i"].take(pa.array(rows, pa.int64())), two["j"].take(pa.array(found, pa.int64()))], ["pair_id", "i", "j"])


def pages(a: DataFrame, b: DataFrame, width: int, top: int, crowded: int = 200) -> DataFrame:
    """pair_id, i, j: rows of a(pair_id, i, page, seq, reach) with rows of b(pair_id, j, page, seq) at most `reach` (and width) pages away.

    All of them where a band of pages holds `crowded` rows of b at most; elsewhere the `top` nearest by pages apart,
    places (seq) apart, place and j, found without making the others.
    """
    a, b = (df.where(f"{c} IS NOT NULL").toDF(*df.columns) for df, c in ((a, "reach"), (b, "page")))  # columns of their own, where both come from one table
    left = a.where("page IS NOT NULL").withColumn("band", F.floor(F.col("page") / width))
    right = b.withColumn("band", F.explode(F.array(*[F.floor(F.col("page") / width) + d for d in (-1, 0, 1)])))
    full = cut(right.groupBy("pair_id", "band").count().where(F.col("count") > crowded).select("pair_id", "band"), "crowded")
    few = right.join(full, ["pair_id", "band"], "left_anti").select("pair_id", "band", "j", F.col("page").alias("there"))
    met = left.join(few, ["pair_id", "band"]).where(F.abs(F.col("page") - F.col("there")) <= F.least("reach", F.lit(width))).select("pair_id", "i", "j")
    own = left.withColumn("reach", F.least("reach", F.lit(width))).join(full, ["pair_id", "band"], "left_semi")
    kinds = dict(a.dtypes) | dict(b.dtypes)
    many = own.groupBy("pair_id", "band").cogroup(right.join(full, ["pair_id", "band"], "left_semi").groupBy("pair_id", "band")).applyInArrow(lambda one, two: _pages(one, two, top), f"pair_id {kinds['pair_id']}, i {kinds['i']}, j {kinds['j']}")
    return met.unionByName(many)
