"""Vectorised byte-level text kernels shared by the corpus operators.

Everything works on Arrow string arrays through numpy: no Python object is made per word.  Words are
maximal runs of bytes outside a separator set; a word's identity is a 64-bit polynomial hash of its
bytes.  Texts are handled in slices of a bounded number of bytes (a single longer text is a slice of its own).
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_MULT = 0x9E3779B97F4A7C15
_MULT2 = 0xC2B2AE3D27D4EB4F
_M64 = (1 << 64) - 1

#: `[\x20\x09-\x0D]`
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def trim() -> None:
    """Gives freed memory back to the system (where the C library can)."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def lean() -> None:
    """At the start of a task in a Python worker: Arrow keeps no pool of its own, and what the last task freed goes back."""
    pa.set_memory_pool(pa.system_memory_pool())
    trim()


@lru_cache(maxsize=None)
def separators(kind: str) -> np.ndarray:
    """Boolean table by byte. "space": ASCII white space. "punct": every ASCII byte but letters and digits."""
    table = np.zeros(256, bool)
    if kind == "space":
        table[list(SPACES)] = True
    else:
        table[:128] = True
        for a, b in ((48, 58), (65, 91), (97, 123)):
            table[a:b] = False
    return table


@lru_cache(maxsize=None)
def byte_values(lower: bool) -> np.ndarray:
    """A fixed random 64-bit value for each byte; with `lower`, A-Z share those of a-z."""
    v = np.random.Generator(np.random.PCG64(20240611)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        v[65:91] = v[97:123]
    return v


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i < n (the table is kept and grown)."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = np.full(size, base & _M64, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            have = _POWERS[base] = np.multiply.accumulate(out)
    return have[:n]


@lru_cache(maxsize=None)
def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (public domain)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x + np.uint64((salt * _MULT + _MULT2) & _M64))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes to [0, 1)."""
    return (x >> np.uint64(11)).astype(np.float64) * (2.0**-53)


@dataclass
class Words:
    """Words of a slice of texts: byte buffer, first and end byte, hash, and first word of each text."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # n_texts + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, n + 1 + column.offset)[column.offset :].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, end row) of runs of texts of at most `limit` bytes, single longer texts apart."""
    _, offsets = text_bytes(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(column: pa.Array, kind: str = "space", lower: bool = False) -> Words:
    buf, offsets = text_bytes(column)
    n = len(buf)
    inside = ~separators(kind)[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    if n:
        before[0] = True
        before[1:] = ~inside[:-1]
        before |= edge[:n]
    start = np.flatnonzero(inside & before)
    after = np.empty(n, bool)
    if n:
        after[-1] = True
        after[:-1] = ~inside[1:]
        after |= edge[1:]
    end = np.flatnonzero(inside & after) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_values(lower)[buf] * powers(_MULT, n), out=sums[1:])
    h = mix((sums[end] - sums[start]) * powers(inverse(_MULT), n + 1)[start] + (end - start).astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)
    return Words(buf, start, end, h, np.searchsorted(start, offsets))


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, text) of every run of `size` words within one text."""
    n = len(w.hash)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(w.hash * powers(_MULT2, n), out=sums[1:])
    text = w.text_of
    at = np.flatnonzero(text[size - 1 :] == text[: n - size + 1])
    return mix((sums[at + size] - sums[at]) * powers(inverse(_MULT2), n + 1)[at]), at, text[at]


def whole(w: Words) -> np.ndarray:
    """Hash of each text's whole word sequence."""
    n = len(w.hash)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(w.hash * powers(_MULT2, n), out=sums[1:])
    a, b = w.first[:-1], w.first[1:]
    return mix((sums[b] - sums[a]) * powers(inverse(_MULT2), n + 1)[a] + np.uint64(n > 0) * (b - a).astype(np.uint64))


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every c, joined."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def binary_array(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary column whose i-th value holds the next counts[i] items of `flat`."""
    ends = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * flat.itemsize, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(flat).tobytes())])


def rows(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Inverse of binary_array: (flat, counts)."""
    data, offsets = text_bytes(column)
    size = np.dtype(dtype).itemsize
    return np.frombuffer(np.ascontiguousarray(data).tobytes(), dtype), np.diff(offsets) // size


def spark_hash(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """What xxhash64 of a long column gives in Spark: XXH64 of eight bytes (public algorithm)."""
    p1, p2, p3, p4, p5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, r: v << np.uint64(r) | v >> np.uint64(64 - r)
    with np.errstate(over="ignore"):
        h = np.uint64(seed) + p5 + np.uint64(8) ^ turn(x.astype(np.int64).view(np.uint64) * p2, 31) * p1
        h = turn(h, 27) * p1 + p4
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        return (h ^ h >> np.uint64(32)).view(np.int64)
