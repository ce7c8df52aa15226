"""Phrase collocations from sorted count streams.

1. Each task cuts its texts into windows: a word and up to three after it in
   the same piece. Equal windows of a block of texts are counted once, and the
   sorted windows go to range partitions in *prefix order* (lang, then word by
   word). There the occurrences of every phrase of one to four words lie side by
   side, so one walk over a partition gives the counts of all orders as
   sums of runs. A run at a partition's edge goes on as a part; equal parts are added.
2. The phrases that are frequent enough form two streams, in prefix order and in
   *suffix order* (last word first). Each is read once in lockstep with itself: a
   phrase's first words stand before it in the one, its last words in the
   other, and the phrases with one word more right after it, so counts of
   both sides of every cut, and the largest count of an extension, need no lookup.

A part of a phrase is at least as frequent as the phrase, so nothing that a
candidate needs is ever left out.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _scan
from ._cache import gathered
from ._io import batch_of, row_slices, store, text_buffers

#: Words in the longest phrase.
ORDER = 4
#: Bytes of text that are cut into windows at once, and bytes of text whose windows meet in one task; raise the second with the executors' memory.
BLOCK_BYTES, PARTITION_BYTES = 6 << 20, 12 << 20
#: Phrases of a part of a count stream.
STREAM_ROWS = 50_000
#: Rows whose windows choose the partitions' edges, and about as many windows of them that come to the driver. Edges decide the balance, not the result.
_EDGE_ROWS, _EDGE_WINDOWS = 4000, 100_000
#: Shares of a lang whose best phrases are found first.
_SHARES = 64

_ENDS_PIECE = np.zeros(256, bool)
_ENDS_PIECE[list(b".,;:!?\n\v\f\r")] = True
_ENDS_WORD = _ENDS_PIECE.copy()
_ENDS_WORD[list(b" \t")] = True

_PARTS = pa.schema([("part", pa.int32()), ("langs", pa.list_(pa.string())), ("windows", pa.binary())])
_PHRASES = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
_STREAM = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("parts", pa.list_(pa.int64())), ("longer", pa.int64())])


def _sorted_words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of distinct slices in byte order, and their bytes and offsets in that order."""
    raw, reach = gathered(data, starts, sizes)
    words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(reach.astype(np.int64)), pa.py_buffer(raw)])
    order = pc.array_sort_indices(words).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return (rank, *gathered(raw, reach[:-1][order], sizes[order]))


class Windows:
    """Distinct windows in prefix order, with counts and the words' bytes.

    A window is two numbers: ``high`` from lang and the first two words, ``low`` from
    the other two, where a word is its rank plus one, and 0 is none.
    """

    def __init__(self, high: np.ndarray, low: np.ndarray, counts: np.ndarray, langs: list[str], raw: np.ndarray, reach: np.ndarray):
        self.v, self.langs, self.raw, self.reach = len(reach), langs, raw, reach
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        first = np.flatnonzero(fresh)
        self.high, self.low = high[first], low[first]
        self.counts = np.add.reduceat(counts[order], first) if len(first) else np.empty(0, np.int64)

    def level(self, k: int, rows: Any) -> np.ndarray:
        """Column ``k`` of some rows: 0 the lang, then the words."""
        v = self.v
        return (self.high[rows] // (v * v), self.high[rows] // v % v, self.high[rows] % v)[k] if k < 3 else (self.low[rows] // v, self.low[rows] % v)[k - 3]

    def edges(self, bounds: list[tuple[bytes, ...]]) -> list[int]:
        """The first window that is not before each bound."""
        raw, v = self.raw.tobytes(), self.v
        words = [raw[a:b] for a, b in zip(self.reach[:-1].tolist(), self.reach[1:].tolist(), strict=True)]
        langs = [x.encode() for x in self.langs]
        highs, lows = [], []
        for bound in bounds:
            numbers, exact = [], True
            for k, value in enumerate(bound):
                names = words if k else langs
                place = bisect_left(names, value) if exact else 0
                numbers.append(place + (k > 0) if exact and (value or not k) else 0)
                exact = exact and (bool(k and not value) or place < len(names) and names[place] == value)
            highs.append((numbers[0] * v + numbers[1]) * v + numbers[2])
            lows.append(numbers[3] * v + numbers[4])
        low, high = (np.searchsorted(self.high, np.array(highs, np.int64), side).tolist() for side in ("left", "right"))
        return [a + int(np.searchsorted(self.low[a:b], x)) for a, b, x in zip(low, high, lows, strict=True)]

    def packed(self, lo: int, hi: int) -> bytes:
        """A run of windows with its own words."""
        columns = np.stack([self.level(k, slice(lo, hi)) for k in range(ORDER + 1)])
        used = np.unique(columns[1:])
        used = used[used > 0]
        sizes = np.diff(self.reach)[used - 1]
        raw, _ = gathered(self.raw, self.reach[:-1][used - 1], sizes)
        columns[1:] = np.searchsorted(used, columns[1:]) + (columns[1:] > 0)
        buffers = [columns.astype("<i4").tobytes(), self.counts[lo:hi].astype("<i8").tobytes(), sizes.astype("<i4").tobytes(), raw.tobytes()]
        whole = np.array([len(b) for b in buffers], "<i8").tobytes() + b"".join(buffers)
        return len(whole).to_bytes(8, "little") + pa.compress(whole, "zstd", asbytes=True)

    def tuples(self, step: int) -> list[tuple[bytes, ...]]:
        """Every ``step``-th window as bytes of lang and words."""
        raw = self.raw.tobytes()
        word = lambda k: raw[self.reach[k - 1] : self.reach[k]] if k else b""
        rows = zip(*(self.level(k, slice(None, None, step)).tolist() for k in range(ORDER + 1)), strict=True)
        return [(self.langs[x[0]].encode(), *(word(k) for k in x[1:])) for x in rows]

    def phrases(self, least: int) -> pa.RecordBatch:
        """Counts of all phrases that begin a window: at least ``least``, or at an edge of the run. The empty phrase counts all words."""
        langs: list[np.ndarray] = []
        texts: list[pa.Array] = []
        totals: list[np.ndarray] = []
        every = slice(None)
        changed = np.zeros(len(self.counts), bool)
        changed[:1] = True
        for level in range(ORDER + 1):
            column = self.level(level, every)
            changed[1:] |= column[1:] != column[:-1]
            first = np.flatnonzero(changed)
            total = np.add.reduceat(self.counts, first)
            keep = (total >= least) | (level == 0)
            keep[:1] = keep[-1:] = True
            keep &= (column[first] > 0) | (level == 0)
            first = first[keep]
            words = np.stack([self.level(k, first) - 1 for k in range(1, level + 1)]) if level else np.empty((0, len(first)), np.int64)
            sizes = self.reach[words + 1] - self.reach[words]
            width = sizes.sum(0) + max(level - 1, 0)
            ends = np.cumsum(width)
            text = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
            at = ends - width
            for k in range(level):
                raw, reach = gathered(self.raw, self.reach[words[k]], sizes[k])
                text[np.repeat(at - reach[:-1], sizes[k]) + np.arange(len(raw))] = raw
                at = at + sizes[k] + 1
            langs.append(self.level(0, first))
            texts.append(pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64)), pa.py_buffer(text)]).cast(pa.string()))
            totals.append(total[keep])
        return batch_of(_PHRASES, pa.array(self.langs, pa.string()).take(pa.array(np.concatenate(langs))), pa.concat_arrays(texts), np.concatenate(totals))


def windows_of(langs: pa.Array, data: np.ndarray, offsets: np.ndarray) -> Windows:
    """The windows of some rows (A-Z are lower-cased)."""
    data = _scan.LOWER[data]
    starts, ends, reach = _scan.word_bounds(data, offsets, _ENDS_WORD)
    codes, first = _scan.distinct_slices(data, starts, ends)
    rank, raw, bounds = _sorted_words(data, starts[first], (ends - starts)[first])
    n, v = len(starts), len(bounds)
    word = np.concatenate((rank[codes] + 1, np.zeros(ORDER - 1, np.int64))).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(reach))
    piece = np.concatenate((np.cumsum(_ENDS_PIECE[data])[starts] + row, np.full(ORDER - 1, -1)))
    names = pc.fill_null(langs.cast(pa.string()), "und").dictionary_encode()
    known = names.dictionary.to_pylist()
    order = sorted(range(len(known)), key=lambda k: known[k].encode())
    place = np.empty(len(known), np.int64)
    place[order] = np.arange(len(known))
    after = lambda k: np.where(piece[k : n + k] == piece[:n], word[k : n + k], 0)
    high = (place[names.indices.to_numpy(zero_copy_only=False)][row] * v + word[:n]) * v + after(1)
    return Windows(high, after(2) * v + after(3), np.ones(n, np.int64), [known[k] for k in order], raw, bounds)


def _unpacked(blob: bytes) -> list[memoryview]:
    whole = memoryview(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True))
    ends = 32 + np.cumsum(np.frombuffer(whole[:32], "<i8"))
    return [whole[a:b] for a, b in zip([32, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def merged(runs: list[tuple[list[str], bytes]]) -> Windows:
    """The windows of several packed runs as one; each run is unpacked twice, for its words and for its windows."""
    known = sorted({x for langs, _ in runs for x in langs}, key=str.encode)
    sizes, raws = [], []
    for _, blob in runs:
        parts = _unpacked(blob)
        sizes.append(np.frombuffer(parts[2], "<i4").astype(np.int64)), raws.append(np.frombuffer(bytes(parts[3]), np.uint8))
    data, size = np.concatenate(raws), np.concatenate(sizes)
    starts = np.cumsum(size) - size
    codes, first = _scan.distinct_slices(data, starts, starts + size)
    rank, raw, bounds = _sorted_words(data, starts[first], size[first])
    number, v, at = rank[codes] + 1, len(bounds), 0
    highs, lows, counts = [], [], []
    for (langs, blob), own in zip(runs, sizes, strict=True):
        parts = _unpacked(blob)
        columns = np.frombuffer(parts[0], "<i4").reshape(ORDER + 1, -1)
        names = np.concatenate(([0], number[at : at + len(own)]))
        lang = np.array([known.index(x) for x in langs], np.int64)
        highs.append((lang[columns[0]] * v + names[columns[1]]) * v + names[columns[2]])
        lows.append(names[columns[3]] * v + names[columns[4]])
        counts.append(np.frombuffer(bytes(parts[1]), "<i8"))
        at += len(own)
    return Windows(np.concatenate(highs), np.concatenate(lows), np.concatenate(counts), known, raw, bounds)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Windows]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for lo, hi in row_slices(offsets, BLOCK_BYTES):
            own = offsets[lo : hi + 1]
            if own[-1] > own[0]:
                yield windows_of(batch.column(0).slice(lo, hi - lo), data[own[0] : own[-1]], own - own[0])


def phrase_counts(docs: DataFrame, least: int = 30, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(lang, phrase, n) of all phrases of one to four words with n of at least ``least``, and of the empty phrase, which counts all words."""
    texts = docs.select(F.col("lang").cast("string"), F.col("text").cast("string"))
    rows, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = 1 + size // partition_bytes
    share = min(1.0, _EDGE_ROWS / max(rows, 1))
    step = 1 + int(share * size / 6 / _EDGE_WINDOWS)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _blocks(batches):
            found = w.tuples(step)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in range(ORDER + 1)], [f"w{k}" for k in range(ORDER + 1)])

    bounds: list[tuple[bytes, ...]] = []
    if parts > 1:
        drawn = texts.sample(share, 7).mapInArrow(some, ", ".join(f"w{k} binary" for k in range(ORDER + 1))).toArrow()
        ordered = sorted(set(zip(*(c.to_pylist() for c in drawn.columns), strict=True)))
        bounds = sorted({ordered[k * len(ordered) // parts] for k in range(1, parts)}) if ordered else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _blocks(batches):
            edges = [0, *w.edges(bounds), len(w.counts)]
            spans = [(part, lo, hi) for part, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if hi > lo]
            if spans:
                yield batch_of(_PARTS, [x[0] for x in spans], [w.langs] * len(spans), [w.packed(lo, hi) for _, lo, hi in spans])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = [(langs, blob) for b in batches for langs, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        if runs:
            yield merged(runs).phrases(least)

    dealt = texts.mapInArrow(cut, "part int, langs array<string>, windows binary").repartitionById(len(bounds) + 1, "part")
    counted = dealt.mapInArrow(add, "lang string, phrase string, n bigint")
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("phrase") == ""))


def _stream(counts: DataFrame, parts: int, backwards: bool) -> DataFrame:
    """One lockstep pass: (lang, phrase, n, parts, longer).

    ``parts`` has the counts of the first 1, 2, ... words (the last ones with
    ``backwards``), ``longer`` the largest count of a phrase with one more word at the
    other end. A phrase whose extensions reach into another part of the stream has
    further rows there, with ``longer`` alone.
    """
    words = F.split("phrase", " ")
    named = counts.where("phrase != ''").select("lang", (F.reverse(words) if backwards else words).alias("words"), "n")
    stream = store(named.repartitionByRange(parts, "lang", "words").withColumn("part", F.spark_partition_id()), "stream")
    heads = stream.groupBy("part").agg(F.min(F.struct("lang", "words")).alias("head")).collect()  # one row a part
    wanted = {(r["head"].lang, tuple(r["head"]["words"][:k])) for r in heads for k in range(1, len(r["head"]["words"]))}
    before: dict[tuple[str, tuple[str, ...]], int] = {}
    if wanted:
        spark = counts.sparkSession
        keys = spark.createDataFrame([(lang, list(w)) for lang, w in wanted], "lang string, words array<string>")
        before = {(r.lang, tuple(r["words"])): r.n for r in stream.join(F.broadcast(keys), ["lang", "words"]).select("lang", "words", "n").collect()}  # ORDER rows a part at most

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list[Any]] = []  # lang, words, n, longer, parts (None: a row of another part of the stream)
        out: list[list[Any]] = []
        begun = False

        def leave() -> None:
            lang, own, n, longer, sides = stack.pop()
            if sides is not None or longer:
                out.append([lang, " ".join(reversed(own) if backwards else own), None if sides is None else n, sides, longer])

        def flush() -> pa.RecordBatch:
            rows = batch_of(_STREAM, *([x[k] for x in out] for k in range(5)))
            out.clear()
            return rows

        for batch in batches:
            for lang, listed, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = tuple(listed)
                if not begun:
                    stack += [[lang, own[:k], before[lang, own[:k]], 0, None] for k in range(1, len(own))]
                    begun = True
                while stack and (stack[-1][0] != lang or own[: len(stack[-1][1])] != stack[-1][1]):
                    leave()
                if stack:
                    stack[-1][3] = max(stack[-1][3], n)
                stack.append([lang, own, n, 0, [x[2] for x in stack]])
            if out:
                yield flush()
        while stack:
            leave()
        if out:
            yield flush()

    ordered = stream.repartitionById(parts, "part").sortWithinPartitions("lang", "words").select("lang", "words", "n")
    return ordered.mapInArrow(walk, "lang string, phrase string, n bigint, parts array<bigint>, longer bigint")


def phrase_collocations(docs: DataFrame, least: int = 30, most: int = 2000, contained: int = 80, partition_bytes: int = PARTITION_BYTES, stream_rows: int = STREAM_ROWS) -> DataFrame:
    """The first ``most`` phrases of each lang of ``docs(lang, text, ...)``: lang, rank, phrase, a, l, r, n, score.

    A phrase of two to four words with ``least`` occurrences is a candidate. Its
    score is floor(2000000 a / (l + r)) for the cut with the lowest one; it goes
    where a longer candidate holds it and has ``contained`` percent of its
    count. Null langs are ``und``, null texts have no words, repeated rows count
    each; an empty table gives no rows.
    """
    counts = store(phrase_counts(docs, least, partition_bytes), "counts")
    parts = 1 + counts.count() // stream_rows
    shape = lambda df, side, other: df.select("lang", "phrase", "n", F.col("parts").alias(side), F.lit(None).cast("array<bigint>").alias(other), "longer")
    both = shape(_stream(counts, parts, False), "lefts", "rights").unionByName(shape(_stream(counts, parts, True), "rights", "lefts"))
    phrases = both.groupBy("lang", "phrase").agg(*(F.max(c).alias(c) for c in ("n", "lefts", "rights", "longer"))).where("size(lefts) > 0")
    big = lambda c: f"cast({c} as decimal(20, 0))"
    cut = f"named_struct('score', (cast(2000000 as decimal(7, 0)) * {big('n')}) div ({big('lefts[k - 1]')} + {big('rights[size(lefts) - k]')}), 'k', k, 'l', lefts[k - 1], 'r', rights[size(lefts) - k])"
    scored = phrases.where(f"not (100 * {big('longer')} >= {int(contained)} * {big('n')})").withColumn("cut", F.expr(f"array_min(transform(sequence(1, size(lefts)), k -> {cut}))"))
    own = scored.select("lang", "phrase", F.col("n").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"), F.pmod(F.xxhash64("phrase"), F.lit(_SHARES)).alias("share"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = own.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= most)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= most)
    words = counts.where("phrase = ''").select("lang", F.col("n").alias("n"))
    return last.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
