"""Vectorised word boundaries and 64-bit hashes over the bytes of many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd

U64 = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1

WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds); returns a new array."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Slices longer than this are hashed and compared by library calls, one at a time.
_LONG = 64


def chunks_of(data: np.ndarray) -> np.ndarray:
    """Entry i is ``data[i:i+8]`` as a little-endian number; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``; ``lower`` takes A-Z for a-z, another ``salt`` gives an independent hash.

    Chunks of eight bytes are mixed one after another, so every chunk passes
    through the mixer with all before it; long slices take a keyed BLAKE2.
    """
    data = LOWER[data] if lower else data
    chunks, sizes = chunks_of(data), ends - starts
    h = mix((chunks[starts] & _MASKS[np.minimum(sizes, 8)]) + U64((salt * _BASE) & _MASK))
    h = mix(h ^ (sizes.astype(U64) + U64(1)) * U64(_BASE))
    more = np.flatnonzero((sizes > 8) & (sizes <= _LONG))
    k = 8
    while len(more):
        h[more] = mix(h[more] ^ (chunks[starts[more] + k] & _MASKS[np.minimum(sizes[more] - k, 8)]))
        k += 8
        more = more[sizes[more] > k]
    for i in np.flatnonzero(sizes > _LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little")
    return h


def same_slices(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, sizes: np.ndarray) -> bool:
    """Whether each pair of slices of the given sizes has the same bytes."""
    left = chunks_of(a)
    right = left if a is b else chunks_of(b)
    at = np.arange(len(sizes))
    k = 0
    while len(at):
        mask = _MASKS[np.minimum(sizes[at] - k, 8)]
        if ((left[a_starts[at] + k] ^ right[b_starts[at] + k]) & mask).any():
            return False
        k += 8
        at = at[sizes[at] > k]
        if k == _LONG:
            break
    return all(np.array_equal(a[x : x + n], b[y : y + n]) for x, y, n in zip(a_starts[at].tolist(), b_starts[at].tolist(), sizes[at].tolist(), strict=True))


def distinct_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each slice, equal for equal bytes, and the first slice with each number."""
    codes, keys = pd.factorize(slice_hashes(data, starts, ends))
    sizes = ends - starts

    def firsts(n: int) -> np.ndarray:
        first = np.empty(n, np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        return first

    same = firsts(len(keys))[codes]
    if (sizes[same] != sizes).any() or not same_slices(data, starts, data, starts[same], sizes):  # two slices with one hash
        raw = data.tobytes()
        codes, keys = pd.factorize(np.array([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], object))
    return codes, firsts(len(keys))


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = WHITESPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of rows, and each row's range of words; ``space`` marks other bytes that end a word."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~space[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    heads = offsets[:-1]
    heads = heads[heads < offsets[1:]]
    first[heads] = ink[heads]
    last = ink
    last = last.copy()
    last[:-1] &= ~ink[1:]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] = ink[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` consecutive entries; there are ``len(words) - k + 1`` (or none)."""
    n = len(words)
    if n < k:
        return np.empty(0, U64)
    if k <= 8:
        h = words[: n - k + 1].copy()
        for i in range(1, k):
            h *= U64(_BASE)
            h += words[i : n - k + 1 + i]
        return mix(h)
    up = _powers(_BASE, n)
    down = _powers(pow(_BASE, -1, 1 << 64), n - k + 1)
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum(words * up, out=sums[1:])
    h = sums[k:] - sums[: n - k + 1]
    h *= down
    return mix(h)
