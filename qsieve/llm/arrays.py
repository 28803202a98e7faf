"""Numpy helpers over Arrow columns: words, hashes, slices.

Texts are handled as UTF-8 bytes.  A batch is worked on in slices of bounded
size, so a task's memory depends on the slice (or on one long text), never on
the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE_BYTE, BASE_WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, U)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if n <= 1 << 24:
            _POWERS[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A mixed polynomial hash of values[start:end] for every range."""
    n = len(values)
    total = np.zeros(n + 1, U)
    np.cumsum(values * powers(base, n), out=total[1:])
    return mix((total[end] - total[start]) * powers(inverse(base), n + 1)[start] + (end - start).astype(U))


def utf8(col: pa.Array) -> pa.Array:
    """The column as large_binary, null as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col.cast(pa.binary() if pa.types.is_string(col.type) else pa.large_binary()).cast(pa.large_binary()), b"")


def slices(col: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows holding up to `limit` bytes (or one longer row): first and
    last row, the bytes, and the rows' offsets in them."""
    if not len(col):
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes outside `gap` (a
    256-entry mask) within a row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~gap[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:-1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(last) + 1, np.searchsorted(off, s, "right") - 1


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each word, computed in runs of words."""
    out = np.empty(len(s), U)
    for i in range(0, len(s), step):
        j = min(len(s), i + step)
        a = s[i]
        out[i:j] = range_hashes(data[a:e[j - 1]].astype(U) + U(1), s[i:j] - a, e[i:j] - a, BASE_BYTE)
    return out


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive entries of h."""
    if len(h) < n:
        return np.zeros(0, U)
    i = np.arange(len(h) - n + 1)
    return range_hashes(h, i, i + n, BASE_WORD)


def binaries(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """A binary column over one byte buffer."""
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def binary_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a binary column without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    off = np.frombuffer(col.buffers()[1], kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes: each member's group and its place in it."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
