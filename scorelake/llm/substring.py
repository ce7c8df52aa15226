"""Substring deduplication: winnowed anchors as seeds, extended left and right to maximal repeats.

Seed: a repeat of ``length`` words holds, at every place where it occurs, the same
winnowed anchor, which is the smallest hash among its ``length - anchor + 1`` runs
of ``anchor`` words, the rightmost of equals. Texts are joined on anchors, and
only those with an anchor that occurs twice are looked at again.

Extend: an anchor grows to the left and to the right in every way that reaches the
full length, and these windows are joined in turn. Growing pair by pair would
be all pairs of a group of copies; joined by value, each place sends its
windows once, whatever the number of its partners. Windows that follow one
another chain to the maximal repeats over the length: the ``spans``.

Both joins look for values that occur more than once. Each task first settles
the values that it holds twice itself and sends one row for each distinct value
on, so a passage in a third of all rows sends as many rows as there are
tasks. A window is known by two hashes of 64 bits. Texts are known by one, so copies
of a text count as one text with a multiplicity, and those of a frequent text
are dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _scan
from ._io import batch_of, partitions, row_slices, store, text_buffers

_HITS = pa.schema([("part", pa.int32()), ("payload", pa.binary())])
_HITS_SQL = "part int, payload binary"
_PLACES = pa.schema([("text_key", pa.int64()), ("places", pa.binary())])
#: Bytes of an anchor's hash that seeds are joined on; a false seed costs a look, and no result.
_SEED_BYTES, _SEED_MASK = 5, np.uint64((1 << 40) - 1)
_SLICE = 2 << 20
_PLACES_A_ROW = 8
_HELD = 1 << 19
#: Copies of one text that meet in one task, and the most texts that are dealt to several.
_SLOT_ROWS, _SLOTTED = 1024, 50_000
#: Salt of the words' second hash, so that the two hashes of a window have nothing in common.
_OTHER = 1


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of each ``width`` consecutive values, the rightmost of equals."""
    at = np.arange(len(values))
    low, size = values, 1

    def join(low: np.ndarray, at: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
        right = low[shift:] <= low[:-shift]
        return np.where(right, low[shift:], low[:-shift]), np.where(right, at[shift:], at[:-shift])

    while 2 * size <= width:
        low, at = join(low, at, size)
        size *= 2
    if size < width:
        low, at = join(low, at, width - size)
    return at


class _Words:
    """Word hashes, anchors and windows of some rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
        self.starts, self.ends, self.reach = _scan.word_bounds(data, offsets)
        self.data = data
        self.hashes = _scan.slice_hashes(data, self.starts, self.ends)
        self.grams = _scan.window_hashes(self.hashes, anchor)
        counts = np.diff(self.reach)
        self.first = np.repeat(self.reach[:-1], counts)
        self.row = np.repeat(np.arange(len(counts)), counts)
        whole = np.arange(len(self.row)) + length <= np.repeat(self.reach[1:], counts)
        self.windows = np.flatnonzero(whole)
        picked = sliding_argmin(self.grams, length - anchor + 1) if len(self.windows) else np.empty(0, np.int64)
        self.selected = picked[self.windows]

    def other_hashes(self) -> np.ndarray:
        """Hashes of the words that are independent of ``hashes``."""
        return _scan.slice_hashes(self.data, self.starts, self.ends, salt=_OTHER)


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of integers, byte by byte, so that small numbers compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return out.view("<u8").ravel()


def _pack(value: np.ndarray, check: np.ndarray | None, key: np.ndarray, pos: np.ndarray, kind: np.ndarray, width: int) -> bytes:
    """Places sorted by key and position as bytes; values and checks only where they are still to be joined."""
    new = np.append(True, key[1:] != key[:-1])
    heads = np.flatnonzero(new)
    steps = np.diff(pos, prepend=0)
    steps[heads] = pos[heads]
    counts = np.diff(np.append(heads, len(key)))
    sizes = np.array([len(key), len(heads), int((kind != 1).sum())], "<u8").tobytes()
    more = b"" if check is None else _planes(check[kind != 1], 8)
    return b"".join((sizes, key[heads].astype("<u8").tobytes(), _planes(counts, 4), _planes(steps, 4), kind.astype(np.uint8).tobytes(), _planes(value[kind != 1], width), more))


def _unpack(payload: bytes, width: int, checked: bool) -> tuple[np.ndarray, ...]:
    data = memoryview(payload)
    n, k, m = (int(x) for x in np.frombuffer(data, "<u8", 3))
    at = 24
    keys = np.frombuffer(data, "<u8", k, at)
    at += 8 * k
    counts = _from_planes(data[at:], k, 4).astype(np.int64)
    at += 4 * k
    steps = _from_planes(data[at:], n, 4).astype(np.int64)
    at += 4 * n
    kind = np.frombuffer(data, np.uint8, n, at)
    value, check = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    value[kind != 1] = _from_planes(data[at + n :], m, width)
    if checked:
        check[kind != 1] = _from_planes(data[at + n + m * width :], m, 8)
    sums = np.cumsum(steps)
    heads = np.cumsum(counts) - counts
    pos = sums - np.repeat(sums[heads] - steps[heads], counts)
    return value, check, np.repeat(keys, counts), pos.astype(np.int32), kind


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it in any column."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _settle(value: np.ndarray, check: np.ndarray | None, key: np.ndarray, pos: np.ndarray, parts: int, width: int) -> pa.RecordBatch:
    """Packed places for the join: one for each distinct value, and those known to be repeated by themselves."""
    own = (value,) if check is None else (value, check)
    order = np.lexsort((pos, key, *own[::-1]))
    own, key, pos = tuple(c[order] for c in own), key[order], pos[order]
    new = _changes(*own, key, pos)
    own, key, pos = tuple(c[new] for c in own), key[new], pos[new]
    value = own[0]
    head = _changes(*own)
    counts = np.diff(np.append(np.flatnonzero(head), len(value)))
    many = np.repeat(counts > 1, counts)
    speaks = head & many
    slot = np.concatenate((value[~many], value[speaks], _scan.mix(value[many] ^ _scan.mix(key[many] + pos[many].astype(np.uint64)))))
    kind = np.concatenate((np.zeros(int((~many).sum()), np.int8), np.full(int(speaks.sum()), 2, np.int8), np.ones(int(many.sum()), np.int8)))
    pick = np.concatenate((np.flatnonzero(~many), np.flatnonzero(speaks), np.flatnonzero(many)))
    part = (_scan.mix(slot) % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((pos[pick], key[pick], part))
    part, pick, kind = part[order], pick[order], kind[order]
    heads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    spans = list(zip(heads.tolist(), np.append(heads[1:], len(part)).tolist(), strict=True))
    value, key, pos = value[pick], key[pick], pos[pick]
    check = None if check is None else own[1][pick]
    return batch_of(_HITS, part[heads], [_pack(value[a:b], None if check is None else check[a:b], key[a:b], pos[a:b], kind[a:b], width) for a, b in spans])


def _repeated(hits: DataFrame, parts: int, width: int, checked: bool) -> DataFrame:
    """Places (text_key, places: int32 positions) whose value occurs at two places or more."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unpack(x.as_py(), width, checked) for batch in batches for x in batch.column(1)]
        if not held:
            return
        value, check, key, pos, known = (np.concatenate(c) for c in zip(*held, strict=True))
        del held
        done = known == 1
        out_key, out_pos = [key[done]], [pos[done]]
        value, check, key, pos, known = (c[~done] for c in (value, check, key, pos, known))
        order = np.lexsort((known, pos, key, check, value))
        value, check, key, pos, known = (c[order] for c in (value, check, key, pos, known))
        new = _changes(value, check, key, pos)  # copies of a text in several tasks
        head = _changes(value, check)
        group = np.cumsum(head) - 1
        many = (np.bincount(group, new) > 1) | (np.bincount(group, known == 2) > 0) if len(group) else np.zeros(0, bool)
        keep = many[group] & new & (known == 0)
        # a place that one task settled may stand here as another task's single row; both say the same
        out_key.append(key[keep])
        out_pos.append(pos[keep])
        key, pos = np.concatenate(out_key), np.concatenate(out_pos)
        order = np.argsort(key, kind="stable")
        key, pos = key[order].view(np.int64), pos[order]
        heads = np.append(True, key[1:] != key[:-1])[: len(key)]
        since = np.arange(len(key)) - np.maximum.accumulate(np.where(heads, np.arange(len(key)), 0))
        cuts = np.flatnonzero(since % _PLACES_A_ROW == 0)  # so that rows follow the places, and not the number of tasks
        ends = np.append(cuts[1:], len(key))
        raw = memoryview(pos.astype("<i4").tobytes())
        for i in range(0, len(cuts), 4096):
            a, b = cuts[i : i + 4096], ends[i : i + 4096]
            yield batch_of(_PLACES, key[a], [bytes(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)])

    return hits.repartitionById(parts, F.col("part")).mapInArrow(meet, "text_key bigint, places binary")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches whose column ``text`` is last: the slice, its bytes and offsets."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(batch.num_columns - 1))
        for lo, hi in row_slices(offsets, _SLICE):
            own = offsets[lo : hi + 1]
            yield batch.slice(lo, hi - lo), data[own[0] : own[-1]], own - own[0]


def _drop_seen(batch: pa.RecordBatch, seen: set[int]) -> pa.Array:
    """A mask of the rows whose text this task has not had yet (the set is cut off at a bound)."""
    out = []
    for key in batch.column(0).to_pylist():
        out.append(key not in seen)
        seen.add(key)
    if len(seen) > _HELD:
        seen.clear()
    return pa.array(out)


class _Held:
    """Values, with checks or None, that wait to be settled together."""

    def __init__(self, parts: int, width: int) -> None:
        self.waiting: list[tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]] = []
        self.n = 0
        self.to = parts, width

    def add(self, value: np.ndarray, check: np.ndarray | None, key: np.ndarray, pos: np.ndarray) -> pa.RecordBatch | None:
        self.waiting.append((value, check, key, pos))
        self.n += len(value)
        return self.flush() if self.n >= _HELD else None

    def flush(self) -> pa.RecordBatch | None:
        if not self.n:
            return None
        out = _settle(*(None if x[0] is None else np.concatenate(x) for x in zip(*self.waiting, strict=True)), *self.to)
        self.waiting, self.n = [], 0
        return out


def repeated_windows(texts: DataFrame, length: int = 35, anchor: int = 16, slots: DataFrame | None = None) -> DataFrame:
    """For ``texts(text_key, ..., text)``: (text_key, places), starts of windows of ``length`` words that also start elsewhere.

    Windows of the same text at another place count; copies of a text (equal
    keys) count once here. Other columns travel along, so that a later join of
    ``texts`` by text_key is the same exchange and moves the texts only once. With
    ``slots(text_key, slots)``, small enough to broadcast, ``texts`` has a column
    text_slot that deals the rows of these texts.
    """
    if not 0 < anchor < length:
        raise ValueError("anchor must be shorter than length")
    parts = partitions(texts.sparkSession)

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held = _Held(parts, _SEED_BYTES)
        for batch in batches:
            for own, data, offsets in _rows(iter([batch.filter(_drop_seen(batch, seen))])):
                w = _Words(data, offsets, length, anchor)
                if not len(w.selected):
                    continue
                pos = w.selected[np.append(True, w.selected[1:] != w.selected[:-1])]
                keys = own.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                out = held.add(w.grams[pos] & _SEED_MASK, None, keys[w.row[pos]], pos - w.first[pos])
                if out is not None:
                    yield out
        out = held.flush()
        if out is not None:
            yield out

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held = _Held(parts, 8)
        for batch in batches:
            for own, data, offsets in _rows(iter([batch.filter(_drop_seen(batch, seen))])):
                w = _Words(data, offsets, length, anchor)
                if not len(w.selected):
                    continue
                seeds = np.zeros(len(w.hashes), bool)
                for lo, lists in zip(w.reach.tolist(), own.column(1), strict=False):
                    for places in lists.as_py() or ():
                        seeds[lo + np.frombuffer(places, "<i4")] = True
                at = w.windows[seeds[w.selected]]
                if not len(at):
                    continue
                keys = own.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                values, checks = (_scan.window_hashes(x, length)[at] for x in (w.hashes, w.other_hashes()))
                out = held.add(values, checks, keys[w.row[at]], at - w.first[at])
                if out is not None:
                    yield out
        out = held.flush()
        if out is not None:
            yield out

    anchors = _repeated(texts.select("text_key", "text").mapInArrow(seed, _HITS_SQL), parts, _SEED_BYTES, False)
    seeds = anchors.groupBy("text_key").agg(F.collect_list("places").alias("places"))
    on = ["text_key"]
    if slots is not None:
        seeds, on = _in_slots(seeds, slots), ["text_key", "text_slot"]
    rest = [c for c in texts.columns if c not in ("text_key", "text")]
    joined = texts.join(seeds, on).select("text_key", "places", *(F.col(f"`{c}`") for c in rest), "text")
    return _repeated(joined.mapInArrow(extend, _HITS_SQL), parts, 8, True)


def _in_slots(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """``rows(text_key, ...)`` once for each slot of its text."""
    found = rows.join(F.broadcast(slots), "text_key", "left")
    return found.withColumn("text_slot", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("slots"), F.lit(1)) - 1))).drop("slots")


def remove_repeats(docs: DataFrame, length: int = 35, anchor: int = 16) -> DataFrame:
    """``docs(doc_id, text, ...)`` with n_words, n_removed, kept_text and the removed word spans.

    A word goes if a window of ``length`` words that covers it also starts
    elsewhere in the table, in the same text or in a copy of it. Windows are
    judged on the input. Kept words are joined by one space. Null texts have no
    words; texts shorter than a window lose nothing; null and repeated doc_ids
    are kept as rows of their own, and all other columns pass through.
    Columns named text_key, text_slot, n_words, n_removed, kept_text or spans are
    replaced. Rows of a text that stands very often are dealt to slots by the
    partition that they come from.
    """
    own = docs.drop("text_key", "text_slot", "n_words", "n_removed", "kept_text", "spans")
    keyed = own.withColumn("text_key", F.xxhash64(F.col("text").cast("string")))
    counts = store(keyed.groupBy("text_key").agg(F.count("*").alias("n"), F.max(F.col("text").isNotNull()).alias("some")).where("n > 1"), "copies")
    most = max(_SLOT_ROWS, int(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // _SLOTTED)
    slots = counts.where(F.col("n") > most).select("text_key", F.expr(f"cast(n div {most} + 1 as int)").alias("slots"))  # _SLOTTED rows at most
    dealt = keyed.join(F.broadcast(slots), "text_key", "left").withColumn("text_slot", F.coalesce(F.pmod(F.spark_partition_id(), F.col("slots")), F.lit(0))).drop("slots")
    copies = counts.where("some").select("text_key", F.lit(None).cast("binary").alias("places"), F.lit(True).alias("copied"))
    windows = repeated_windows(dealt, length, anchor, slots).withColumn("copied", F.lit(False))
    places, copied = ("_".join((*own.columns, x)) for x in ("places", "copied"))  # no column of docs has these names
    found = windows.unionByName(copies).groupBy("text_key").agg(F.collect_list("places").alias(places), F.max("copied").alias(copied))
    joined = dealt.join(_in_slots(found, slots), ["text_key", "text_slot"], "left")
    rest = list(own.columns)
    named = lambda *cs: [F.col(f"`{c}`") for c in cs]
    shape = joined.select(*named(places, copied, *(c for c in rest if c != "text")), "text")
    fields = [f"`{c}` {t}" for c, t in joined.select(*named(*rest)).dtypes]
    schema = ", ".join([*fields, "n_words bigint", "n_removed bigint", "kept_text string", "spans array<struct<first:int,end:int>>"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in _rows(batches):
            starts, ends, reach = _scan.word_bounds(data, offsets)
            raw = data.tobytes()
            counts, removed, kept, spans = np.diff(reach), [], [], []
            for i, (lists, copied) in enumerate(zip(batch.column(0), batch.column(1).to_pylist(), strict=True)):
                lo, hi = int(reach[i]), int(reach[i + 1])
                n = hi - lo
                edges = np.zeros(n + 1, np.int32)
                if copied and n >= length:
                    edges[0], edges[n] = 1, -1
                for places in lists.as_py() or ():
                    at = np.frombuffer(places, "<i4")
                    np.add.at(edges, at, 1)
                    np.add.at(edges, at + length, -1)
                gone = np.cumsum(edges[:n]) > 0
                removed.append(int(gone.sum()))
                if removed[-1]:
                    steps = np.diff(np.concatenate(([0], gone, [0])).astype(np.int8))
                    spans.append([{"first": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(steps > 0), np.flatnonzero(steps < 0), strict=True)])
                    at = lo + np.flatnonzero(~gone)
                    kept.append(b" ".join([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]).decode())
                else:
                    spans.append([])
                    kept.append(b" ".join(raw[offsets[i] : offsets[i + 1]].split()).decode())
            passed = [batch.column(c) for c in rest]
            arrays = [*passed, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rest, "n_words", "n_removed", "kept_text", "spans"])

    return shape.mapInArrow(cut, schema)


def substring_digests(docs: DataFrame, length: int = 35, anchor: int = 16) -> DataFrame:
    """doc_id, n_words, n_removed and the sha256 of the kept text, one row a row; null and empty texts keep nothing."""
    out = remove_repeats(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), length, anchor)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
