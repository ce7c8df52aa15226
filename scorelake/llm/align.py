"""Alignment of two tokenizers over the same bytes, by skipping runs on the diagonal.

Both token sequences of a text are arrays of byte ends. While they agree at the
present shift between their indexes, tokens are one to one, and exponential
probing jumps over the whole stretch; where they part, the irregular group is
walked to the next common end, which sets the next shift. Texts of a batch
stand one after another, as the end of each is common to both sequences.

A link joins the last tokens of a group. One of the two is then a suffix of the
other, so the id pairs that can occur follow from the vocabularies alone (some
hundred thousand); their counts over the corpus are what travels to all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpejson, pieces
from ._io import batch_of, row_slices, store, text_buffers

_SLICE = 1 << 20
#: Pairs that a task holds before it adds up equal ones.
_HELD = 1 << 20
_DOCS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])
_COUNTS = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])


def _sql(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def group_ends(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The places in ``a`` and in ``b`` of each common value, in order; both ascend and end alike."""
    runs_a: list[int] = []
    runs_b: list[int] = []
    sizes: list[int] = []
    i = j = 0
    n = len(a)
    while i < n:
        from_i, from_j, step = i, j, 1
        while i < n and a[i : i + step] == b[j : j + step]:
            i, j, step = i + step, j + step, 2 * step
        while step > 1:  # the first difference lies in the probe that failed
            step >>= 1
            if i < n and a[i : i + step] == b[j : j + step]:
                i, j = i + step, j + step
        i, j = min(i, n), min(j, len(b))
        if i > from_i:
            runs_a.append(from_i), runs_b.append(from_j), sizes.append(i - from_i)
        if i < n:
            x, y = a[i], b[j]
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            runs_a.append(i), runs_b.append(j), sizes.append(1)
            i, j = i + 1, j + 1
    length = np.array(sizes, np.int64)
    steps = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    return np.repeat(np.array(runs_a, np.int64), length) + steps, np.repeat(np.array(runs_b, np.int64), length) + steps


def _decimal(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal numbers below ``size`` with one sign after them (comma, bar, semicolon), as eight bytes each, and their lengths."""
    shown = [f"{k}{sign}".encode() for sign in ",|;" for k in range(size)]
    lengths = np.array([len(x) for x in shown], np.int64)
    if lengths.max() > 8:
        raise ValueError("ids of more than seven digits")
    return np.frombuffer(b"".join(x.ljust(8, b"\0") for x in shown), np.uint8).reshape(-1, 8), lengths


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def spelt_groups(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;...;`` over all groups (places of their last tokens given), and the bytes before the end of each group."""
    if size not in _tables:
        _tables[size] = _decimal(size)
    digits, lengths = _tables[size]
    at_a = np.arange(len(a)) + np.concatenate(([0], ends_b + 1))[np.searchsorted(ends_a, np.arange(len(a)))]
    at_b = np.arange(len(b)) + (ends_a + 1)[np.searchsorted(ends_b, np.arange(len(b)))]
    symbols = np.empty(len(a) + len(b), np.int64)
    symbols[at_a], symbols[at_b] = a, b
    symbols[at_a[ends_a]] += size
    symbols[at_b[ends_b]] += 2 * size
    own = lengths[symbols]
    out = digits[symbols][np.arange(8) < own[:, None]]
    return out.tobytes(), np.cumsum(own)[at_b[ends_b]]


def _described(raw_ids: pa.Array, data: np.ndarray, offsets: np.ndarray, a_coder: bpejson.JsonByteBpe, b_coder: pieces.PieceEncoder) -> pa.RecordBatch:
    """Groups and links of rows; ``data`` has the texts that are not empty, each after a space."""
    n = len(offsets) - 1
    width = b_coder.size
    size = max(len(a_coder.token_lengths), width)
    ids_a, reach_a = a_coder.encode(data, offsets)
    ids_b, reach_b = b_coder.encode(data, offsets)
    (back_a, ends_a), (back_b, ends_b) = a_coder.decode(ids_a), b_coder.decode(ids_b)
    good = np.diff(offsets) > 0
    for back, ends, reach in ((back_a, ends_a, reach_a), (back_b, ends_b, reach_b)):
        if len(back) != len(data) or not np.array_equal(back, data):
            for i in range(n):
                good[i] &= np.array_equal(back[ends[reach[i]] : ends[reach[i + 1]]], data[offsets[i] : offsets[i + 1]])
    if not good.all():
        keep_a, keep_b = np.repeat(good, np.diff(reach_a)), np.repeat(good, np.diff(reach_b))
        ids_a, ids_b = ids_a[keep_a], ids_b[keep_b]
        reach_a, reach_b = (np.concatenate(([0], np.cumsum(np.where(good, np.diff(r), 0)))) for r in (reach_a, reach_b))
        ends_a, ends_b = (np.concatenate(([0], np.cumsum(c.token_lengths[x]))) for c, x in ((a_coder, ids_a), (b_coder, ids_b)))
    last_a, last_b = group_ends(ends_a[1:].tolist(), ends_b[1:].tolist())
    pairs = ids_a[last_a].astype(np.int64) * width + ids_b[last_b]
    text, stops = spelt_groups(ids_a.astype(np.int64), ids_b.astype(np.int64), last_a, last_b, size)
    of_row = np.searchsorted(last_a, reach_a).tolist()
    view = memoryview(text)
    stops = np.concatenate(([0], stops)).tolist()
    keys, times, digests = [], [], []
    for lo, hi in zip(of_row[:-1], of_row[1:], strict=True):
        own, count = np.unique(pairs[lo:hi], return_counts=True)
        keys.append(own.astype("<i8").tobytes()), times.append(count.astype("<i8").tobytes())
        digests.append(hashlib.sha256(view[stops[lo] : stops[hi] - 1]).hexdigest() if hi > lo else "")
    return batch_of(_DOCS, raw_ids, np.diff(reach_a), np.diff(reach_b), np.diff(of_row), digests, keys, times)


def align(docs: DataFrame, bytes_tokenizer: str | None = None, piece_tokenizer: str | None = None) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_a, n_b, n_groups, groups_sha256, and its links.

    ``pairs`` and ``times`` are the distinct id pairs (a times the size of the
    second vocabulary, plus b) and how many links of the row have them, as
    little-endian 64-bit integers. Texts that are null, empty or not reproduced by
    both tokenizers have no tokens, no links and an empty digest.
    """
    a_path, b_path = bytes_tokenizer or bpejson.default_path(), piece_tokenizer or pieces.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_coder, b_coder = bpejson.coder(a_path, True), pieces.encoder(b_path)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for lo, hi in row_slices(offsets, _SLICE):
                own = offsets[lo : hi + 1] - offsets[lo]
                some = np.diff(own) > 0
                if not len(data[offsets[lo] : offsets[hi]]):
                    empty = pa.array([b""] * (hi - lo), pa.binary())
                    zero = np.zeros(hi - lo, np.int64)
                    yield batch_of(_DOCS, batch.column(0).slice(lo, hi - lo), zero, zero, zero, [""] * (hi - lo), empty, empty)
                    continue
                spaced = np.full(int(own[-1]) + int(some.sum()), 0x20, np.uint8)
                shift = np.concatenate(([0], np.cumsum(some)))
                place = np.arange(int(own[-1])) + np.repeat(shift[1:], np.diff(own))
                spaced[place] = data[offsets[lo] : offsets[hi]]
                yield _described(batch.column(0).slice(lo, hi - lo), spaced, own + shift, a_coder, b_coder)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, _sql(_DOCS))


def _numbers(column: pa.Array) -> np.ndarray:
    data, _ = text_buffers(column)
    return np.frombuffer(data.tobytes(), "<i8")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many links of all rows of ``align`` have each id pair."""

    def added(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        own, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(own), np.int64)
        np.add.at(total, at, np.concatenate(times))
        return own, total

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, held = [], [], 0
        for batch in batches:
            keys.append(_numbers(batch.column(0))), times.append(_numbers(batch.column(1)))
            held += len(keys[-1])
            if held >= _HELD:
                own, total = added(keys, times)
                keys, times, held = [own], [total], 0
        if keys:
            yield batch_of(_COUNTS, *added(keys, times))

    return aligned.select("pairs", "times").mapInArrow(part, _sql(_COUNTS)).groupBy("pair").agg(F.sum("n").alias("n"))


def alignment_counts(docs: DataFrame, bytes_tokenizer: str | None = None, piece_tokenizer: str | None = None) -> DataFrame:
    """Per row of ``docs(doc_id, text, ...)``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best`` links have the highest count of all pairs with their second id,
    and ``count_sum`` adds up the counts of the row's links. Rows with null or
    repeated doc_ids stay rows of their own; an empty table gives no rows. The counts
    of all pairs come to the driver: their number is bounded by the suffixes that
    the two vocabularies share, whatever the corpus.
    """
    width = pieces.encoder(piece_tokenizer or pieces.default_path()).size
    aligned = store(align(docs, bytes_tokenizer, piece_tokenizer), "aligned", compression="zstd")
    found = pair_counts(aligned).toArrow()
    pair = found.column("pair").to_numpy()
    order = np.argsort(pair)
    pair, count = pair[order], found.column("n").to_numpy()[order]
    best = np.zeros(width, np.int64)
    np.maximum.at(best, pair % width, count)
    shared = docs.sparkSession.sparkContext.broadcast((pair, count, best))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = shared.value
        for batch in batches:
            keys, times = _numbers(batch.column(5)), _numbers(batch.column(6))
            sizes = np.diff(text_buffers(batch.column(5))[1]) // 8
            row = np.repeat(np.arange(len(sizes)), sizes)
            n = count[np.searchsorted(pair, keys)] if len(keys) else keys
            links, top, total = (np.zeros(len(sizes), np.int64) for _ in range(3))
            np.add.at(links, row, times)
            np.add.at(top, row, np.where(n == best[keys % width], times, 0))
            np.add.at(total, row, n * times)
            yield batch_of(_OUT, *batch.columns[:4], links, top, total, batch.column(4))

    return aligned.mapInArrow(look, _sql(_OUT))
