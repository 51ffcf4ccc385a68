"""Best-fit packing of tokenised documents into sequences of fixed capacity.

`tokenise` cuts every document into pieces of at most `capacity` tokens.  `pack` places the pieces by
bulk-synchronous best fit:

* Pieces are dealt by length and ranked within their length (distributed; a hot length is split by a hash of
  the id, and the sizes of the splits give each its first rank), which is their order in a range sort.
* Rows of one length are interchangeable, so a superstep matches all pieces of one length, the largest first:
  it sweeps the open gaps in ascending order from the successor of that length, gives the k-th piece to
  the k-th gap (conflicts are resolved by rank), updates the gaps that took pieces and repeats.  Gaps are
  kept as intervals of sequences with the same room, so that this needs the counts by length alone: at most
  `capacity` numbers, whatever the corpus.
* The result of the sweeps, intervals of ranks to intervals of sequences, is broadcast (its size depends on the
  capacity only) and every piece looks up its own place.

The result is that of best-fit decreasing over all pieces.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import kernels as K
from .common import read, stored

CAPACITY, END_ID = 1024, 2
#: Fixed value: how byte-level BPE of this kind splits a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids as `tokenizers` gives them for a byte-level BPE file.

    Where ids are merge ranks, as in this file, tiktoken's faster BPE gives the same ids from the same
    vocabulary; texts that hold the string of an added token, and other files, go through `tokenizers`.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = [x["content"] for x in spec.get("added_tokens", ())]
        self.fast = self._ranked(spec)

    @cached_property
    def tokenizer(self):
        """Loaded only when a text needs it: two tokenizers in every Python worker would double their memory."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _ranked(self, spec: dict):
        import tiktoken

        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        vocabulary = {k: v for k, v in model["vocab"].items() if k not in self.added}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", ())]
        plain = model["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if not plain or any(c not in char for k in vocabulary for c in k) or any(vocabulary[m] != 256 + i for i, m in enumerate(merged)):
            return None
        ranks = {bytes(char[c] for c in k): v for k, v in vocabulary.items()}
        return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is None or any(x in text for x in self.added):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    return _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))


def pieces_of(n: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of n tokens: full ones but for the first."""
    count = -(-n // capacity)
    doc, k = np.repeat(np.arange(len(n)), count), K.ranges(count)
    head = n - (count - 1) * capacity
    start = np.where(k == 0, 0, head[doc] + (k - 1) * capacity)
    return doc, start, np.where(k == 0, head[doc], capacity)


def tokenise(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of every document, its whole text's ids and then end_id.  A null text counts as empty.

    Rows with equal ids stay rows of their own.  with_ids adds the token ids themselves (array of int).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.lean()
        own = encoder(tokenizer)
        for b in batches:
            for i, j in K.slices(b["text"], 4 << 20):
                each = [own.encode(x or "") for x in b["text"].slice(i, j - i).to_pylist()]
                n = np.array([len(x) for x in each])
                full = np.fromiter(chain.from_iterable((*x, end_id) for x in each), "<u4", int(n.sum()) + len(n))
                first = np.cumsum(n + 1) - n - 1
                doc, start, length = pieces_of(n + 1, capacity)
                at, raw = (first[doc] + start) * 4, memoryview(full.tobytes())
                crc = np.fromiter((zlib.crc32(raw[x : x + y]) for x, y in zip(at.tolist(), (length * 4).tolist())), np.int64, len(at))
                part = (start != 0) * (1 + (start - length[np.searchsorted(doc, doc)]) // capacity)
                out = [b["doc_id"].slice(i, j - i).take(pa.array(doc)), pa.array(part.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), pa.array(full.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def sweep(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best fit over counts by length.  Rows: length, first rank, end rank, first sequence, pieces in each, offset."""
    gaps: dict[int, list[list[int]]] = {}
    plan, made = [], 0
    for s in sorted(counts, reverse=True):
        rank, n = 0, counts[s]

        def give(room: int, lo: int, hi: int) -> None:
            """Pieces of length s to the sequences lo..hi-1, which have `room` left; as many into each as it takes."""
            nonlocal rank
            fit = room // s
            whole = min(hi - lo, (n - rank) // fit)
            rest = (n - rank - whole * fit) if whole < hi - lo else 0
            if whole:
                plan.append((s, rank, rank + whole * fit, lo, fit, capacity - room))
                rank += whole * fit
                gaps.setdefault(room - fit * s, []).append([lo, lo + whole])
            if rest:
                plan.append((s, rank, rank + rest, lo + whole, rest, capacity - room))
                rank += rest
                gaps.setdefault(room - rest * s, []).append([lo + whole, lo + whole + 1])
                whole += 1
            if lo + whole < hi:
                gaps.setdefault(room, []).append([lo + whole, hi])

        for room in sorted(g for g in gaps if g >= s):
            waiting = gaps.pop(room)
            while waiting and rank < n:
                give(room, *waiting.pop())
            if waiting:
                gaps.setdefault(room, []).extend(waiting)
            if rank == n:
                break
        if rank < n:
            new = -(-(n - rank) // (capacity // s))
            give(capacity, made, made + new)
            made += new
    return np.array(plan, np.int64).reshape(-1, 6), made


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...; 1 <= length <= capacity).

    `pieces` is read three times: give a stored table.  Equal rows get places of their own.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan, _ = sweep(counts, capacity)
    shared = pieces.sparkSession.sparkContext.broadcast(plan)
    splits = max(64, sum(counts.values()) // 1_000_000)
    dealt = pieces.withColumn("__split", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(splits)).cast("int"))
    before = Window.partitionBy("length").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("length", "__split").agg(F.count("*").alias("__n")).select("length", "__split", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy("length", "__split").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("__rank", F.row_number().over(within) - 1).join(first, ["length", "__split"])
    columns = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        p = p[np.lexsort((p[:, 1], p[:, 0]))]
        key = p[:, 0] << 48 | p[:, 1]
        for b in batches:
            rank = b["__rank"].to_numpy()
            length = b["length"].to_numpy()
            e = p[np.searchsorted(key, length << 48 | rank, side="right") - 1] if len(p) else p
            k = rank - e[:, 1]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in columns), pa.array(e[:, 3] + k // e[:, 4]), pa.array(e[:, 5] + k % e[:, 4] * length)], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*columns, (F.col("__rank") + F.col("__first")).alias("__rank")).mapInArrow(run, schema)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(stored(tokenise(read(spark, sf_dir, "documents"), vocabulary()), "pieces"))
