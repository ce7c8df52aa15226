"""Sentence-piece ids of many texts through the ``sentencepiece`` library, each distinct unit encoded once.

A unit is a run of spaces and the run of other characters after it. Where no
vocabulary entry holds a space after another character (checked when the file
is read), no merge crosses two units, so a text's ids are its units' ids in order.
"""

from __future__ import annotations

import numpy as np

from ._cache import SliceCache, gathered

_SPACE = "▁"


class PieceEncoder:
    """Ids of texts that begin with the space which the library puts before a text."""

    def __init__(self, path: str, capacity: int = 1 << 19):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.library.get_piece_size()
        words = [self.library.id_to_piece(i) for i in range(self.size)]
        if any(_SPACE in w.lstrip(_SPACE) for w in words):
            raise ValueError("a vocabulary entry holds a space after another character")
        tokens = []
        for i, w in enumerate(words):
            special = self.library.is_control(i) or self.library.is_unknown(i)
            tokens.append(b"" if special else bytes([int(w[3:5], 16)]) if self.library.is_byte(i) else w.replace(_SPACE, " ").encode())
        self.tokens = tokens
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_lengths = np.array([len(t) for t in tokens], np.int64)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.space = self.library.piece_to_id(_SPACE)
        self.cache = SliceCache(capacity, np.int32)

    def _learn(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # a lone space is the only unit without text of its own, for which the library gives nothing
        ids = [x or [self.space] for x in self.library.encode([u[1:].decode() for u in found], num_threads=1)]
        return np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and each row's offsets in them; every row begins with a space."""
        blank = data == 0x20
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        first[offsets[:-1]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(data))
        found = self.cache.ids(data, starts, ends, self._learn)
        if found is None:  # two units with one hash: encode each by itself
            raw = data.tobytes()
            ids, sizes = self._learn([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
            found = ids, np.concatenate(([0], np.cumsum(sizes)))
        ids, reach = found
        return ids, reach[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and each id's offsets in them."""
        return gathered(self.token_bytes, self.token_starts[ids], self.token_lengths[ids])


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder a worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
