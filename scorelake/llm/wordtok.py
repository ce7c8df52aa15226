"""Word-piece ids of many texts through the ``tokenizers`` library, each distinct word encoded once.

The public word-level BPE vocabulary drops white space and never merges over it,
so a text's ids are the ids of its white-space-separated words in order. Words
are looked up in one bounded cache that compares their bytes; the library
encodes each word that the cache lacks.
"""

from __future__ import annotations

import os
from typing import Any

import numpy as np

from . import _scan
from ._cache import SliceCache

#: Stands between words that are encoded in one call; words that hold it are encoded alone.
_BETWEEN = b"\x01"


class WordEncoder:
    """Ids of whole texts; between calls the state is bounded by ``capacity`` words."""

    def __init__(self, path: str, capacity: int = 1 << 19):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        between = self._plain(_BETWEEN.decode())
        self.between = between[0] if len(between) == 1 else None
        self.cache = SliceCache(capacity, np.int32, lower=True)

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = [w.lower() for w in found]
        parts: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        step = 64
        groups = [words[i : i + step] for i in range(0, len(words), step)]
        joined = [(b" " + _BETWEEN + b" ").join(g) for g in groups]
        easy = [self.between is not None and x.count(_BETWEEN) == len(g) - 1 for x, g in zip(joined, groups, strict=True)]
        encoded = iter(self.tokenizer.encode_batch_fast([x.decode() for x, ok in zip(joined, easy, strict=True) if ok], add_special_tokens=False))
        for group, ok in zip(groups, easy, strict=True):
            if ok:
                ids = np.array(next(encoded).ids, np.int32)
                cut = ids == self.between
                if int(cut.sum()) == len(group) - 1:
                    at = np.flatnonzero(cut)
                    lengths.append(np.diff(np.concatenate(([-1], at, [len(ids)]))) - 1)
                    parts.append(ids[~cut])
                    continue
            own = [self._plain(w.decode()) for w in group]
            lengths.append(np.array([len(x) for x in own], np.int64))
            parts.append(np.array([i for x in own for i in x], np.int32))
        return np.concatenate(parts), np.concatenate(lengths).astype(np.int64)

    def _whole(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = [self._plain(raw[offsets[i] : offsets[i + 1]].decode()) for i in range(len(offsets) - 1)]
        return np.array([i for r in rows for i in r], np.int32), np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and each row's offsets in them."""
        raw = data.tobytes()
        if any(s[:2] in raw for s in self.special):
            return self._whole(raw, offsets)
        starts, ends, rows = _scan.word_bounds(data, offsets)
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        found = self.cache.ids(data, starts, ends, self._learn)
        if found is None:
            return self._whole(raw, offsets)
        ids, reach = found
        return ids, reach[rows]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` with ``end`` after every row."""
    n = len(offsets) - 1
    out = np.empty(len(ids) + n, np.uint32)
    ends = offsets[1:] + np.arange(n)
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[ends] = end
    out[keep] = ids
    return out, offsets + np.arange(n + 1)


def doc_ids(column: Any) -> list[int | None]:
    return column.to_pylist()
