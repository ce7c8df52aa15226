"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Piece boundaries come from a small automaton over codepoint classes. Each
codepoint is a function from state to state; functions compose associatively,
so blocks of text are composed side by side, the blocks' functions are scanned
by doubling, and a last sweep with known states marks the boundaries. No
regular expression runs over a text. Each distinct piece is merged once and kept
in a bounded cache that compares bytes.

The automaton stands for the public pattern of ``public_tokenizers.PATTERN``:
contractions, letters, numbers and other signs with one optional space before
them, and white space, whose last codepoint before other text stands apart.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cache import SliceCache, gathered
from ._io import batch_of, row_slices, text_buffers

# Symbols: letter, number, other, apostrophe before a contraction of one or of two letters,
# white space before white space or the end, a last space, another last white space.
LETTER, NUMBER, OTHER, _ONE, _TWO, _INNER, _SPACE, _LAST = range(8)
# States: inside letters, numbers, others or white space; a space that the next run takes;
# one or two letters of a contraction to come; nothing open.
_IN_L, _IN_N, _IN_O, _IN_W, _TAKEN, _NEED1, _NEED2, _FREE = range(8)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and boundary-before for each symbol (rows; 8 more where a text begins) and state."""
    after = np.empty((16, 8), np.uint8)
    cut = np.ones((16, 8), bool)
    after[LETTER], after[NUMBER], after[OTHER] = _IN_L, _IN_N, _IN_O
    after[_ONE], after[_TWO] = _NEED1, _NEED2
    after[_INNER], after[_SPACE], after[_LAST] = _IN_W, _TAKEN, _FREE
    after[LETTER, _NEED1], after[LETTER, _NEED2] = _FREE, _NEED1
    cut[LETTER, [_IN_L, _TAKEN, _NEED1, _NEED2]] = False
    cut[NUMBER, [_IN_N, _TAKEN]] = False
    for apostrophe in (_ONE, _TWO):
        after[apostrophe, [_IN_O, _TAKEN]] = _IN_O
    for sign in (OTHER, _ONE, _TWO):
        cut[sign, [_IN_O, _TAKEN]] = False
    cut[_INNER, _IN_W] = False
    after[8:] = after[:8, _FREE][:, None]
    return after, cut


_AFTER, _CUT = _tables()
_AFTER_FLAT, _CUT_FLAT = _AFTER.ravel(), _CUT.ravel()
_WIDTH = 64
_classes: list[np.ndarray] = []


def classes_of_codepoints() -> np.ndarray:
    """The class of each codepoint: letter, number, other or white space."""
    if not _classes:
        import regex

        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        for pattern, symbol in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", _INNER)):
            for m in regex.finditer(pattern, every):
                lo, hi = m.span()
                table[np.frombuffer(every[lo:hi].encode("utf-32-le"), "<u4")] = symbol
        _classes.append(table)
    return _classes[0]


def _symbols(points: np.ndarray, heads: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Symbols of codepoints; ``heads`` marks the first of each text."""
    n = len(points)
    out = classes[points]
    white = out == _INNER
    ends = np.empty(n, bool)
    ends[:-1] = heads[1:]
    ends[-1] = True
    last = white.copy()
    last[:-1] &= ~white[1:]
    last &= ~ends
    out[last] = np.where(points[last] == 0x20, _SPACE, _LAST)
    at = np.flatnonzero((points == 0x27) & ~ends)
    first = points[at + 1]
    one = np.isin(first, [ord(c) for c in "stmd"])
    out[at[one]] = _ONE
    at, first = at[~one], first[~one]
    inside = (at + 2 < n) & ~ends[np.minimum(at + 1, n - 1)]
    at, first = at[inside], first[inside]
    second = points[at + 2]
    two = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
    out[at[two]] = _TWO
    out[heads] += 8
    return out


def boundaries(points: np.ndarray, heads: np.ndarray, classes: np.ndarray | None = None) -> np.ndarray:
    """True where a piece begins; ``classes`` stands in for ``classes_of_codepoints``."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    rows = -(-n // _WIDTH)
    symbols = np.full(rows * _WIDTH, OTHER, np.uint8)
    symbols[:n] = _symbols(points, heads, classes_of_codepoints() if classes is None else classes)
    columns = np.ascontiguousarray(symbols.reshape(rows, _WIDTH).T).astype(np.uint16) << 3
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in columns:
        whole = _AFTER_FLAT[column[:, None] + whole]
    step = 1
    while step < rows:  # inclusive scan: entry i becomes the composition of 0..i
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step].astype(np.intp), 1)
        step *= 2
    state = np.empty(rows, np.uint8)
    state[0] = _FREE
    state[1:] = whole[:-1, _FREE]
    marks = np.empty((_WIDTH, rows), bool)
    for k, column in enumerate(columns):
        at = column + state
        marks[k] = _CUT_FLAT[at]
        state = _AFTER_FLAT[at]
    return marks.T.ravel()[:n]


def pieces(data: np.ndarray, offsets: np.ndarray, classes: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all pieces of rows of UTF-8 bytes, and each row's range of pieces."""
    if not len(data):
        return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    lead = (data & 0xC0) != 0x80
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.flatnonzero(lead)
    heads = np.zeros(len(points), bool)
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    heads[np.searchsorted(at, firsts)] = True
    starts = at[boundaries(points, heads, classes(points) if classes else None)]
    return starts, np.searchsorted(starts, offsets)


class ByteBpe:
    """Ids by the ranks of a rank file; the cache holds ``capacity`` distinct pieces at most."""

    def __init__(self, path: str, capacity: int = 1 << 19):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self._merge = tiktoken.Encoding("ranks", pat_str=r"[\s\S]", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._set_tokens({rank: token for token, rank in ranks.items()}, capacity)

    def _set_tokens(self, words: dict[int, bytes], capacity: int) -> None:
        tokens = [words.get(i, b"") for i in range(max(words) + 1)]
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_lengths = np.array([len(t) for t in tokens], np.int64)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.cache = SliceCache(capacity, np.uint32)

    #: Classes for the given codepoints, where they aren't ``classes_of_codepoints``.
    _classes: Callable[[np.ndarray], np.ndarray] | None = None

    def _learn(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        merged = [self._merge(piece) for piece in found]
        return np.array([i for m in merged for i in m], np.uint32), np.array([len(m) for m in merged], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and each row's offsets in them."""
        starts, rows = pieces(data, offsets, self._classes)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        found = self.cache.ids(data, starts, ends, self._learn)
        if found is None:  # two pieces with one hash: merge each by itself
            raw = data.tobytes()
            ids, sizes = self._learn([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
            found = ids, np.concatenate(([0], np.cumsum(sizes)))
        ids, reach = found
        return ids, reach[rows]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and each id's offsets in them."""
        return gathered(self.token_bytes, self.token_starts[ids], self.token_lengths[ids])


_coders: dict[str, ByteBpe] = {}


def coder(path: str) -> ByteBpe:
    """One coder a worker process, kept between tasks."""
    if path not in _coders:
        _coders[path] = ByteBpe(path)
    return _coders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` to (doc_id, ids array<int>, offsets array<int>).

    ``offsets`` has each token's byte start in the text and the text's length
    last, so any run of tokens maps back to its bytes. Null and empty texts have
    no ids. Repeated and null doc_ids are kept as they are.
    """
    path = ranks or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for lo, hi in row_slices(offsets, 2 << 20):
                own = offsets[lo : hi + 1]
                c = coder(path)
                ids, reach = c.encode(data[own[0] : own[-1]], own - own[0])
                ends = np.concatenate(([0], np.cumsum(c.token_lengths[ids])))
                spans = [(ends[a : b + 1] - ends[a]).astype(np.int32) for a, b in zip(reach[:-1].tolist(), reach[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(reach.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield batch_of(schema, batch.column(0).slice(lo, hi - lo), lists, pa.array(spans, pa.list_(pa.int32())))

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, ids) to (doc_id, content binary); null ids decode to no bytes."""
    path = ranks or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [coder(path).decode(np.array(ids.as_py() or [], np.int64))[0].tobytes() for ids in batch.column(1)]
            yield batch_of(schema, batch.column(0), rows)

    return encoded.select(F.col("doc_id").cast("bigint"), "ids").mapInArrow(run, "doc_id bigint, content binary")


def round_trip(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """Encode and decode every text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = ranks or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for lo, hi in row_slices(offsets, 2 << 20):
                own = offsets[lo : hi + 1]
                c = coder(path)
                ids, reach = c.encode(data[own[0] : own[-1]], own - own[0])
                content, ends = c.decode(ids)
                raw, text = memoryview(ids.astype("<u4").tobytes()), memoryview(content.tobytes())
                spans = list(zip(reach[:-1].tolist(), reach[1:].tolist(), strict=True))
                yield batch_of(
                    schema,
                    batch.column(0).slice(lo, hi - lo),
                    np.diff(reach),
                    [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in spans],
                    [hashlib.sha256(text[ends[a] : ends[b]]).hexdigest() for a, b in spans],
                )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
