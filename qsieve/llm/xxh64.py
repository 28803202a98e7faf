"""XXH64 of many short byte ranges at once (public algorithm, numpy)."""

from __future__ import annotations

import numpy as np
import xxhash

from .arrays import U

# Fixed values of the XXH64 algorithm.
P1, P2, P3 = U(0x9E3779B185EBCA87), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
P4, P5 = U(0x85EBCA77C2B2AE63), U(0x27D4EB2F165667C5)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U(n)) | (x >> U(64 - n))


def xxh64_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """XXH64(data[start:end], seed) per range.  Ranges of 32 bytes and more go
    through the library, the others through array arithmetic."""
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(data) + 1, 8), (1, 1))
    out = U(seed) + P5 + size.astype(U)
    at = start.copy()
    for step in range(3):
        i = np.flatnonzero(size >= 8 * (step + 1))
        if not len(i):
            break
        lane = eight[at[i]].view("<u8").ravel() * P2
        out[i] = _turn(out[i] ^ (_turn(lane, 31) * P1), 27) * P1 + P4
        at[i] += 8
    rest = size & 7
    i = np.flatnonzero(rest >= 4)
    lane = np.ascontiguousarray(eight[at[i]][:, :4]).view("<u4").ravel().astype(U)
    out[i] = _turn(out[i] ^ (lane * P1), 23) * P2 + P3
    at[i] += 4
    rest &= 3
    for step in range(3):
        i = np.flatnonzero(rest > step)
        out[i] = _turn(out[i] ^ (padded[at[i]].astype(U) * P5), 11) * P1
        at[i] += 1
    out = (out ^ (out >> U(33))) * P2
    out = (out ^ (out >> U(29))) * P3
    out ^= out >> U(32)
    line = data.tobytes() if (size >= 32).any() else b""
    for k in np.flatnonzero(size >= 32):
        out[k] = xxhash.xxh64_intdigest(line[start[k]:end[k]], seed)
    return out
