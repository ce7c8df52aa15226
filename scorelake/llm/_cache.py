"""A bounded cache from byte slices to runs of ids, looked up for many slices at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from . import _scan

Encode = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``pool`` one after another, and each one's offsets in them."""
    reach = np.concatenate(([0], np.cumsum(lengths)))
    return pool[np.repeat(starts - reach[:-1], lengths) + np.arange(reach[-1])], reach


class SliceCache:
    """Ids of distinct slices, ``capacity`` of them between calls.

    Slices are found by a 64-bit hash, and their bytes are compared. Where they
    differ, ``ids`` gives None and the caller encodes the texts without the
    cache. One call may hold as many slices as its own bytes have.
    """

    def __init__(self, capacity: int, dtype: type, lower: bool = False):
        self.capacity, self.dtype, self.lower = capacity, dtype, lower
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.raw = np.empty(0, np.uint8)
        self.raw_starts = np.empty(0, np.int64)
        self.raw_sizes = np.empty(0, np.int64)
        self.index = pd.Index(self.keys)
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)
        self.pool = np.empty(0, self.dtype)
        self.uses = np.empty(0, np.int32)

    def _make_room(self) -> None:
        """Keep at most half of the capacity: the slices that most calls have had, the newest of equals."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > self.capacity // 2:
            order = np.argsort(self.uses[kept], kind="stable")
            kept = np.sort(kept[order[-(self.capacity // 2) :]])
        self.pool, reach = gathered(self.pool, self.starts[kept], self.lengths[kept])
        self.starts, self.lengths = reach[:-1], self.lengths[kept]
        self.raw, reach = gathered(self.raw, self.raw_starts[kept], self.raw_sizes[kept])
        self.raw_starts, self.raw_sizes = reach[:-1], self.raw_sizes[kept]
        self.keys, self.uses = self.keys[kept], self.uses[kept] // 2 + 1
        self.index = pd.Index(self.keys)

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode: Encode) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of all slices one after another, and each slice's offsets in them; ``encode`` takes those that are new."""
        own = _scan.LOWER[data] if self.lower else data
        sizes = ends - starts
        codes, keys = pd.factorize(_scan.slice_hashes(own, starts, ends))
        first = np.empty(len(keys), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        same = first[codes]
        if (sizes[same] != sizes).any() or not _scan.same_slices(own, starts, own, starts[same], sizes):
            return None
        at = self.index.get_indexer(keys)
        known = at >= 0
        here, there = first[known], at[known]
        if (self.raw_sizes[there] != sizes[here]).any() or not _scan.same_slices(own, starts[here], self.raw, self.raw_starts[there], sizes[here]):
            return None
        if not known.all():
            if len(self.keys) + len(keys) > self.capacity:
                self._make_room()
                at = self.index.get_indexer(keys)
            lacking = np.flatnonzero(at < 0)
            spans = first[lacking]
            raw = data.tobytes()
            got, counts = encode([raw[a:b] for a, b in zip(starts[spans].tolist(), ends[spans].tolist(), strict=True)])
            fresh, reach = gathered(own, starts[spans], sizes[spans])
            at[lacking] = len(self.keys) + np.arange(len(lacking))
            self.starts = np.concatenate((self.starts, len(self.pool) + np.cumsum(counts) - counts))
            self.lengths = np.concatenate((self.lengths, counts))
            self.raw_starts = np.concatenate((self.raw_starts, len(self.raw) + reach[:-1]))
            self.raw_sizes = np.concatenate((self.raw_sizes, sizes[spans]))
            self.raw = np.concatenate((self.raw, fresh))
            self.pool = np.concatenate((self.pool, got.astype(self.dtype)))
            self.keys = np.concatenate((self.keys, keys[lacking]))
            self.uses = np.concatenate((self.uses, np.zeros(len(lacking), np.int32)))
            self.index = pd.Index(self.keys)
        self.uses[at] += 1
        picked = at[codes]
        return gathered(self.pool, self.starts[picked], self.lengths[picked])
