"""Vectorised text work on Arrow buffers: words, word hashes, ragged arrays."""

from __future__ import annotations

import numpy as np
import xxhash

#: White space of the contracts: space and the control characters 9 to 13.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Spans up to this many bytes are hashed and compared in steps of eight; longer ones one by one.
SHORT = 64
_START, _STEP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3 on 64 bits (public domain), in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without white space, and each document's first word (n + 1)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~IS_SPACE[raw]
    first = np.zeros(n, bool)
    first[1:] = solid[1:] & ~solid[:-1]
    first[0] = solid[0]
    cut = offsets[:-1][offsets[:-1] < n]
    first[cut] = solid[cut]
    last = np.zeros(n, bool)
    last[:-1] = solid[:-1] & ~solid[1:]
    last[-1] = solid[-1]
    cut = offsets[1:][offsets[1:] > 0] - 1
    last[cut] = solid[cut]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one integer; zeros follow the text."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, equal for equal bytes: eight bytes at a time through a mixer."""
    size = ends - starts
    h = size.astype(np.uint64) * _START
    if not len(size):
        return h
    eights = _eights(raw)
    h ^= eights[starts] & _MASK[np.minimum(size, 8)]
    mix64(h)
    at = np.flatnonzero((size > 8) & (size <= SHORT))
    for k in range(8, SHORT, 8):
        at = at[size[at] > k]
        if not len(at):
            break
        h[at] = mix64(h[at] * _STEP ^ eights[starts[at] + k] & _MASK[np.minimum(size[at] - k, 8)])
    long = np.flatnonzero(size > SHORT)
    if len(long):
        data = memoryview(np.ascontiguousarray(raw))
        h[long] = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return h


def same_spans(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size[i]`` bytes from ``a[i]`` on are those from ``b[i]`` on."""
    eights = _eights(raw)
    same = (eights[a] ^ eights[b]) & _MASK[np.minimum(size, 8)] == 0
    at = np.flatnonzero(same & (size > 8) & (size <= SHORT) & (a != b))
    for k in range(8, SHORT, 8):
        at = at[size[at] > k]
        if not len(at):
            break
        same[at] &= (eights[a[at] + k] ^ eights[b[at] + k]) & _MASK[np.minimum(size[at] - k, 8)] == 0
    long = np.flatnonzero((size > SHORT) & (a != b))
    if len(long):
        data = memoryview(np.ascontiguousarray(raw))
        same[long] = [data[i : i + n] == data[j : j + n] for i, j, n in zip(a[long].tolist(), b[long].tolist(), size[long].tolist(), strict=True)]
    return same


def ragged_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1`` for every i, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


def sums_by_range(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values[bounds[i]:bounds[i + 1]]`` for every i."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
