"""Hashed features of texts for the linear models: words and byte n-grams that lie within words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import kernels as K

_BASE = 0xD6E8FEB86659FD93


def features(column: pa.Array, bits: int, sizes: tuple[int, ...], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, K.Words]:
    """(feature number, byte where it starts) of each whole word and each n-gram inside a word, and the words.

    prefixes: lengths of beginnings of longer words that are features of their own.

    Letters A-Z count as a-z; digits and letters of any language make up words, all else separates.
    """
    w = K.words(column, "punct", lower=True)
    shift = np.uint64(64 - bits)
    found, where = [(K.salted(w.hash, 1) >> shift).astype(np.int32)], [w.start]
    n = len(w.buf)
    if n and (sizes or prefixes):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(K.byte_values(True)[w.buf] * K.powers(_BASE, n), out=sums[1:])
        back = K.powers(K.inverse(_BASE), n + 1)
        length = w.end - w.start
        for size in sizes:
            count = np.maximum(length - size + 1, 0)
            at = np.repeat(w.start, count) + K.ranges(count)
            found.append((K.salted((sums[at + size] - sums[at]) * back[at], size + 1) >> shift).astype(np.int32))
            where.append(at)
        for size in prefixes:
            at = w.start[length > size]
            found.append((K.salted((sums[at + size] - sums[at]) * back[at], size + 101) >> shift).astype(np.int32))
            where.append(at)
    return np.concatenate(found), np.concatenate(where), w


def text_of(where: np.ndarray, column: pa.Array) -> np.ndarray:
    _, offsets = K.text_bytes(column)
    return np.searchsorted(offsets, where, side="right") - 1
