"""Byte-level BPE by a ``tokenizers`` file, each distinct piece encoded once.

``bpe.pieces`` cuts texts at the boundaries that the file's ByteLevel
pre-tokenizer has too; the library encodes each piece that the cache lacks.
Libraries know different Unicode versions, so codepoints younger than Unicode 3.2
take their class from the library itself, when they are first seen.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from . import bpe


def byte_alphabet() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, other bytes from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class JsonByteBpe(bpe.ByteBpe):
    """Ids as the library gives them without special tokens added.

    With ``plain`` the strings of special tokens are text like any other; else a
    text that holds one is encoded whole by the library.
    """

    def __init__(self, path: str, plain: bool, capacity: int = 1 << 19):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = [] if plain else [x.encode() for x in added]
        alphabet = byte_alphabet()
        words = {i: bytes(alphabet[c] for c in t) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        words |= {i: x.encode() for x, i in added.items()}
        self._set_tokens(words, capacity)
        young = [c for c in range(0x110000) if unicodedata.ucd_3_2_0.category(chr(c)) == "Cn"]
        self._table = bpe.classes_of_codepoints().copy()
        self._unknown = np.zeros(0x110000, bool)
        self._unknown[young] = True

    def _classes(self, points: np.ndarray) -> np.ndarray:
        for c in np.unique(points[self._unknown[points]]).tolist():
            spans = [span for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{chr(c)}1")]
            self._table[c] = bpe.LETTER if (0, 2) in spans else bpe.NUMBER if (1, 3) in spans else bpe.OTHER
            self._unknown[c] = False
        return self._table

    def _learn(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([x.decode() for x in found], add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        if not any(x in raw for x in self.special):
            return super().encode(data, offsets)
        rows = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if any(x in raw[a:b] for x in self.special):
                rows.append(np.array(self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids, np.uint32))
            else:
                rows.append(super().encode(data[a:b], np.array([0, b - a]))[0])
        return np.concatenate(rows), np.concatenate(([0], np.cumsum([len(x) for x in rows])))


_coders: dict[tuple[str, bool], JsonByteBpe] = {}


def coder(path: str, plain: bool) -> JsonByteBpe:
    """One coder a worker process, kept between tasks."""
    if (path, plain) not in _coders:
        _coders[path, plain] = JsonByteBpe(path, plain)
    return _coders[path, plain]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
