"""Substring deduplication by prefix-partitioned, truncated suffix trees.

A suffix is the word sequence from one word of a document on.  Only repeats of `size` words matter, so the tree is
truncated there: suffixes that agree in `size` words share a leaf, and a leaf with suffixes of several documents is a node
below which a repeat goes on.  The suffixes are split into memory-sized groups by prefixes of variable length: by their
first word where few suffixes share its class, by the first two or four words where more do, by all words at last;
the classes are bounded in number, and in a large corpus each is cut further by the words that follow.  A group is one
subtree.  What it holds of a suffix is a fingerprint of its words: leaves are sorted and merged by it, and the smallest
document of a leaf owns the passage.  Levels above the truncation are not built (nothing asks for them), nor are leaves
in the order of their words.  Leaves of consecutive suffixes join to maximal repeats, and later documents lose the words that
they cover.

Before the shuffle each chunk of text keeps one suffix of each leaf, its smallest document's: all others of the chunk are
repeats already.  So a passage that a third of the corpus shares sends one suffix a chunk to its subtree.
Fingerprints have 64 bits within a group: two different passages of a corpus of n suffixes in g groups meet with
a probability of about n*n / (g * 2**65), 0.2 for 1e13 suffixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import kernels as K
from .common import read

SIZE = 13
#: Words of the prefixes tried, classes of prefixes of each length, suffixes aimed at in a group.
PREFIXES, CLASSES, GROUP = (1, 2, 4), 4096, 500_000
CHUNK_BYTES = 6 << 20
#: Bytes of text and documents of a part that is cut at a time.
PART_BYTES, PART_DOCS = 4 << 20, 700


def prefix_classes(w: K.Words, at: np.ndarray, words: int) -> np.ndarray:
    """Class of the prefix of `words` words of the suffixes that begin at `at`."""
    h, start, _ = K.windows(w, words)
    return (K.salted(h[np.searchsorted(start, at)], words) >> np.uint64(52)).astype(np.int64)


def census(documents: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """(suffixes by prefix length and class, bytes, documents): len(PREFIXES) x CLASSES + 2 numbers, the only ones that the driver gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.lean()
        n, sizes = np.zeros((len(PREFIXES), CLASSES), np.int64), np.zeros(2, np.int64)
        for b in batches:
            for i, j in K.slices(b["text"]):
                w = K.words(b["text"].slice(i, j - i))
                sizes += len(w.buf), j - i
                at = K.windows(w, size)[1]
                for k, length in enumerate(PREFIXES):
                    if len(at):
                        n[k] += np.bincount(prefix_classes(w, at, length), minlength=CLASSES)
        level, group = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(level, [-1, -1])), pa.array(np.append(group, [0, 1])), pa.array(np.append(n[level, group], sizes))], ["level", "class", "n"])

    out, sizes = np.zeros((len(PREFIXES), CLASSES), np.int64), np.zeros(2, np.int64)
    for r in documents.select("text").mapInArrow(run, "level long, class long, n long").groupBy("level", "class").agg(F.sum("n").alias("n")).collect():
        (out[r["level"]] if r["level"] >= 0 else sizes)[r["class"]] = r["n"]
    return out, int(sizes[0]), int(sizes[1])


def groups(n: np.ndarray, group: int = GROUP) -> tuple[np.ndarray, int, int]:
    """Number of the group of each prefix class (-1: too many suffixes, a longer prefix decides), how many there are, and cuts of each.

    Row len(PREFIXES) deals the classes of whole paths.  Beyond CLASSES groups of the size aimed at, each is cut by its paths.
    A class of a longer prefix loads its group with the share of its suffixes that shorter prefixes leave open.
    """
    cuts = max(1, -(-int(n[0].sum()) // (group * CLASSES)))
    count = int(min(CLASSES, max(32, -(-n[0].sum() // group))))
    most = max(1, n[0].sum() // count)
    out, load, share = np.full((len(PREFIXES) + 1, CLASSES), -1), np.zeros(count), 1.0
    for k in range(len(PREFIXES)):
        for c in np.argsort(-n[k], kind="stable"):
            if n[k, c] <= most:
                out[k, c] = i = int(load.argmin())
                load[i] += n[k, c] * share
        share *= n[k, out[k] < 0].sum() / max(1, n[k].sum())
    out[-1] = np.arange(CLASSES) % count
    return out, count, cuts


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of sorted uint64 as differences, byte by byte apart (most high bytes are then equal)."""
    d = np.diff(x, prepend=np.uint64(0)).astype("<u8")
    return d.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplanes(raw: bytes, n: int) -> np.ndarray:
    width = len(raw) // n if n else 0
    d = np.zeros((n, 8), np.uint8)
    d[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return np.cumsum(d.view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


LEAVES = "to long, kind int, part int, n int, paths binary, docs binary, own binary"


def _row(to: int, kind: int, part: int, path: np.ndarray, doc: np.ndarray) -> tuple:
    """Leaves (path ascending, doc) as one row: paths in planes, documents as a table and 2- or 4-byte numbers."""
    table, number = np.unique(doc, return_inverse=True)
    wide = int(np.diff(path, prepend=np.uint64(0)).max()).bit_length() if len(path) else 0
    own = number.astype("<u2" if len(table) <= 1 << 16 else "<u4")
    return to, kind, part, len(path), _planes(path, max(1, -(-wide // 8))), _ids(table), own.view(np.uint8).reshape(-1, own.itemsize).T.tobytes() if len(own) else b""


def _ids(table: np.ndarray) -> bytes:
    """Sorted ids: the first, then differences in planes."""
    d = (table - table[0]).astype(np.uint64) if len(table) else np.zeros(0, np.uint64)
    wide = int(np.diff(d, prepend=np.uint64(0)).max()).bit_length() if len(d) else 0
    return len(table).to_bytes(4, "little") + table[:1].astype("<i8").tobytes() + _planes(d, max(1, -(-wide // 8)))


def _leaves(row: dict) -> tuple[np.ndarray, np.ndarray]:
    n, raw = row["n"], row["docs"]
    count = int.from_bytes(raw[:4], "little")
    table = np.frombuffer(raw[4:12], "<i8")[0] + _unplanes(raw[12:], count).astype(np.int64) if count else np.zeros(0, np.int64)
    size = len(row["own"]) // n if n else 2
    own = np.ascontiguousarray(np.frombuffer(row["own"], np.uint8).reshape(size, n).T).view(f"<u{size}").ravel() if n else np.zeros(0, int)
    return _unplanes(row["paths"], n), table[own]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], ["to", "kind", "part", "n", "paths", "docs", "own"])


def _split(key: np.ndarray, *columns: np.ndarray):
    """(key, columns) of each run of equal keys; key is sorted."""
    edges = np.flatnonzero(np.diff(key, prepend=-1, append=-1)) if len(key) else np.zeros(1, int)
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(key[a]), *(c[a:b] for c in columns)


def leaves(documents: DataFrame, size: int, group_of: np.ndarray, count: int, cuts: int = 1) -> DataFrame:
    """Rows of leaves of documents (id, part, text).  kind 0: for subtree `to`.  kind 1: repeats already known, for documents of `part`."""
    shared = documents.sparkSession.sparkContext.broadcast(group_of)

    def chunk(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        path, doc, part, to = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((doc, path, to))
        path, doc, part, to = path[order], doc[order], part[order], to[order]
        same = np.zeros(len(path), bool)
        same[1:] = (path[1:] == path[:-1]) & (to[1:] == to[:-1])
        lead = doc[np.maximum.accumulate(np.where(same, 0, np.arange(len(path))))] if len(path) else doc
        rows = [_row(k, 0, -1, p, d) for k, p, d in _split(to[~same], path[~same], doc[~same])]
        again = same & (doc != lead)
        path, doc, part = path[again], doc[again], part[again]
        order = np.lexsort((path, part))
        return _table(rows + [_row(count * cuts + k % 4096, 1, k, p, d) for k, p, d in _split(part[order], path[order], doc[order])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.lean()
        found, held = [], 0
        for b in batches:
            ids, parts = b["id"].to_numpy(), b["part"].to_numpy()
            for i, j in K.slices(b["text"]):
                w = K.words(b["text"].slice(i, j - i))
                path, at, text = K.windows(w, size)
                if len(at):
                    to = np.full(len(at), -1)
                    for k, length in enumerate((*PREFIXES, size)):
                        todo = np.flatnonzero(to < 0)
                        if len(todo):
                            to[todo] = shared.value[k][prefix_classes(w, at[todo], length) if k < len(PREFIXES) else (path[todo] >> np.uint64(52)).astype(np.int64)]
                    if cuts > 1:
                        to = to * cuts + ((path >> np.uint64(16)) % np.uint64(cuts)).astype(np.int64)
                    found.append((path, ids[i + text], parts[i + text], to))
                    held += len(w.buf)
                if held >= CHUNK_BYTES:
                    yield chunk(found)
                    found, held = [], 0
        if found:
            yield chunk(found)

    return documents.where("id IS NOT NULL").select("id", "part", "text").mapInArrow(run, LEAVES)


def subtree(t: pa.Table, parts: int) -> pa.Table:
    """Repeats below the nodes of one subtree: every leaf whose node has a leaf of a smaller document."""
    kinds = t["kind"].to_numpy()
    if kinds.any():
        return t.select(["part", "n", "paths", "docs", "own"])
    path, doc = (np.concatenate(c) for c in zip(*(_leaves(r) for batch in t.to_batches() for r in batch.to_pylist())))
    order = np.lexsort((doc, path))
    path, doc = path[order], doc[order]
    del order
    same = np.zeros(len(path), bool)
    same[1:] = path[1:] == path[:-1]
    again = same & (doc != doc[np.maximum.accumulate(np.where(same, 0, np.arange(len(path))))])
    path, doc = path[again], doc[again]
    part = part_of(doc, parts)
    order = np.lexsort((path, part))
    return pa.Table.from_batches([_table([_row(0, 0, k, p, d) for k, p, d in _split(part[order], path[order], doc[order])])]).select(["part", "n", "paths", "docs", "own"])


def part_of(doc: np.ndarray, parts: int) -> np.ndarray:
    """As part_column has it for documents with an id (those without go by their text: no repeat is sent to them)."""
    return K.spark_hash(doc) % parts


def part_column(parts: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce("id", F.xxhash64("text"))), F.lit(parts)).cast("int").alias("part")


OUT = "doc_id long, n_words long, n_removed long, text string, spans array<struct<first:int,end:int>>"


def _cut(docs: pa.Table, repeats: pa.Table, size: int) -> pa.Table:
    """Applies the repeats of a part to its documents."""
    each = [_leaves(r) for r in repeats.to_pylist()] or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    path, doc = (np.concatenate(c) for c in zip(*each))
    known = np.sort(K.mix(path ^ K.mix(doc.view(np.uint64))))
    out = []
    for batch in docs.select(["id", "text"]).combine_chunks().to_batches():
        ids = batch["id"]
        number = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j in K.slices(batch["text"]):
            w = K.words(batch["text"].slice(i, j - i))
            path, at, text = K.windows(w, size)
            key = K.mix(path ^ K.mix(number[i + text].view(np.uint64)))
            place = np.searchsorted(known, key)
            hit = (known[np.minimum(place, len(known) - 1)] == key) if len(known) else np.zeros(len(key), bool)
            hit &= ~np.asarray(ids.is_null())[i + text]
            depth = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(depth, at[hit], 1)
            np.add.at(depth, np.minimum(at[hit] + size, len(w.start)), -1)
            gone = np.cumsum(depth)[:-1] > 0
            owner = w.text_of
            removed = np.bincount(owner, gone, minlength=j - i).astype(np.int64)
            # Runs of removed words of one text.
            step = np.flatnonzero(gone & np.append(True, ~gone[:-1] | (owner[1:] != owner[:-1]))) if len(gone) else np.zeros(0, int)
            stop = np.flatnonzero(gone & np.append(~gone[1:] | (owner[1:] != owner[:-1]), True)) + 1 if len(gone) else step
            base = w.first[owner[step]] if len(step) else step
            spans = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(owner[step], minlength=j - i))).astype(np.int32)), pa.StructArray.from_arrays([pa.array((step - base).astype(np.int32)), pa.array((stop - base).astype(np.int32))], ["first", "end"]))
            kept = np.flatnonzero(~gone)
            length, mine = w.end[kept] - w.start[kept], owner[kept]
            last = np.append(mine[1:] != mine[:-1], True) if len(mine) else np.zeros(0, bool)
            wide = length + ~last  # one space after each but the last
            body = np.full(int(wide.sum()), 32, np.uint8)
            to = np.cumsum(wide) - wide
            within = K.ranges(length)
            body[np.repeat(to, length) + within] = w.buf[np.repeat(w.start[kept], length) + within]
            ends = np.append(0, np.cumsum(np.bincount(mine, wide, minlength=j - i))).astype(np.int32)
            texts = pa.Array.from_buffers(pa.string(), j - i, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(body.tobytes())])
            out.append(pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(w.counts), pa.array(removed), texts, spans], ["doc_id", "n_words", "n_removed", "text", "spans"]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))])
    return pa.Table.from_batches([pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, schema)], schema=schema) for b in out], schema)


def remove_repeats(documents: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words joined by a space) and spans (removed runs of words) for every row.

    A word goes if a run of `size` words that covers it also begins in a document with a smaller id.  Null texts
    have no words.  Rows that repeat an id take nothing from each other; rows with a null id take and lose
    nothing.  A very long text is cut as a whole, by one task.  Other columns are not read.
    """
    base = documents.select(F.col("doc_id").cast("long").alias("id"), "text")
    n, text_bytes, rows = census(base, size)
    parts = max(rows // PART_DOCS, text_bytes // PART_BYTES) + 1
    docs = base.select("id", part_column(parts), "text")
    group_of, count, cuts = groups(n, group)
    found = leaves(docs, size, group_of, count, cuts).groupBy("to").applyInArrow(lambda t: subtree(t, parts), "part int, n int, paths binary, docs binary, own binary")
    return docs.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(lambda a, b: _cut(a, b, size), OUT)


def op7_substring(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
