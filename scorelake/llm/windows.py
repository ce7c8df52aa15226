"""Best-fit decreasing of token pieces into windows, by a segment tree over remaining capacity.

A document longer than a window is cut into full windows first; the rest, by
falling length, each goes to the open window with the least room that holds
it. What is still open is then filled by cutting: the emptiest windows give
their tokens to the fullest ones, and the one that is left is cut at powers of two,
which need no padding.

Documents are packed in blocks of a bounded number of tokens, each inside one
task: nothing is shuffled, a block leaves no padding behind, and a lost task
packs its own rows again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpejson, wordtok
from ._io import batch_of, row_slices, text_buffers

_SLICE = 2 << 20
#: Tokens that are packed together; a longer document is a block of its own.
BLOCK_TOKENS = 1 << 22
#: Sequences of one partition that have numbers of their own.
_PART = 1 << 32
_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_OUT_SQL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

#: (document in the block, start, length)
Piece = tuple[int, int, int]


class RoomTree:
    """Open windows by the room that they have left; each node counts those below it."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.base)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        node = self.base + room
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The room and number of the tightest window with at least ``need`` room, which leaves the tree."""
        node = self.base + need
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node *= 2
                if not self.count[node]:
                    node += 1
        room = node - self.base
        self._add(room, -1)
        return room, self.windows[room].pop()


def best_fit(sizes: list[int], capacity: int) -> tuple[list[list[Piece]], list[int]]:
    """Windows of pieces of documents with the given sizes (0 for none), and the tokens in each."""
    windows: list[list[Piece]] = []
    rest: list[Piece] = []
    for doc, size in enumerate(sizes):
        whole = size - size % capacity
        windows += [[(doc, at, capacity)] for at in range(0, whole, capacity)]
        if size > whole:
            rest.append((doc, whole, size - whole))
    used = [capacity] * len(windows)
    tree = RoomTree(capacity)
    for piece in sorted(rest, key=lambda p: -p[2]):
        found = tree.take(piece[2])
        if found is None:
            room, window = capacity, len(windows)
            windows.append([])
            used.append(0)
        else:
            room, window = found
        windows[window].append(piece)
        used[window] += piece[2]
        if room > piece[2]:
            tree.put(room - piece[2], window)
    return windows, used


def fill_by_cutting(windows: list[list[Piece]], used: list[int], capacity: int) -> list[list[Piece]]:
    """The windows without padding: open ones are filled from the emptiest, and the last is cut at powers of two."""
    order = sorted((w for w in range(len(windows)) if used[w] < capacity), key=lambda w: -used[w])
    i, j = 0, len(order) - 1
    while i < j:
        to, donor = order[i], order[j]
        doc, start, length = windows[donor].pop()
        given = min(length, capacity - used[to])
        windows[to].append((doc, start + length - given, given))
        if given < length:
            windows[donor].append((doc, start, length - given))
        used[to] += given
        used[donor] -= given
        i += used[to] == capacity
        j -= not used[donor]
    out = [x for w, x in enumerate(windows) if x and used[w] == capacity]
    for last in (x for w, x in enumerate(windows) if x and used[w] < capacity):  # one at most
        left = list(reversed(last))
        total = sum(p[2] for p in last)
        for bit in reversed(range(total.bit_length())):
            room, own = total & 1 << bit, []
            while room:
                doc, start, length = left.pop()
                given = min(length, room)
                own.append((doc, start, given))
                if given < length:
                    left.append((doc, start + given, length - given))
                room -= given
            if own:
                out.append(own)
    return out


def pack_windows(docs: DataFrame, tokenizer: str | None = None, max_length: int = 1024, end_id: int = 0, cut_to_fill: bool = True, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pack every row of ``docs(doc_id, text, ...)``; other columns are ignored.

    One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. Null and empty texts are the end id alone; rows with a null or
    repeated doc_id are packed each by itself; an empty table gives no rows.
    Without ``cut_to_fill`` no piece but those of overlong documents is cut, and
    windows may stay open. Equal lengths go in order of their rows, so ``docs``
    should be a table or a ``store``: rows whose order changes when a lost task
    runs again would be packed in another way.
    """
    path = tokenizer or bpejson.default_path()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() * _PART
        doc_ids: list[int | None] = []
        parts: list[np.ndarray] = []
        sizes: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            windows, used = best_fit(sizes, max_length)
            if cut_to_fill:
                windows = fill_by_cutting(windows, used, max_length)
            raw = memoryview(np.concatenate(parts).astype("<u4").tobytes())
            at = np.concatenate(([0], np.cumsum(sizes))).tolist()
            flat = [p for w in windows for p in w]
            doc, start, length = (np.array([p[k] for p in flat], np.int64) for k in range(3))
            which = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
            ends = np.cumsum(length)
            first = np.searchsorted(which, which)
            crc = [zlib.crc32(raw[4 * (at[d] + s) : 4 * (at[d] + s + n)]) for d, s, n in flat]
            rows = batch_of(_OUT, pa.array(doc_ids, pa.int64()).take(pa.array(doc)), start, length, crc, np.array(sizes, np.int64)[doc], sequence + which, ends - length - (ends - length)[first])
            sequence += len(windows)
            doc_ids.clear(), parts.clear(), sizes.clear()
            return rows

        held = 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            own_ids = batch.column(0).to_pylist()
            for lo, hi in row_slices(offsets, _SLICE):
                own = offsets[lo : hi + 1]
                ids, reach = wordtok.with_end(*bpejson.coder(path, False).encode(data[own[0] : own[-1]], own - own[0]), end_id)
                doc_ids += own_ids[lo:hi]
                parts.append(ids)
                sizes += np.diff(reach).tolist()
                held += len(ids)
                if held >= block_tokens:
                    yield flush()
                    held = 0
        if sizes:
            yield flush()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(pack, _OUT_SQL)
