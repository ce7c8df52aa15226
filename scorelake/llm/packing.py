"""Best-fit packing of tokenised documents into sequences, planned on the histogram of lengths.

The plan never sees a document: best-fit decreasing runs over (length, count)
on the driver. Its rows follow the number of lengths and of states that
sequences can be in, not the corpus (20,242 rows for ten million pieces with
lognormal lengths). Each plan row gives a run of ranks within one length a run of
sequences at one offset; pieces take their slots by a join on length and rank.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordtok
from ._io import batch_of, row_slices, store, text_buffers

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
#: Plan rows that are broadcast at most (48 bytes each); a longer plan is joined by a shuffle.
BROADCAST_ROWS = 250_000
#: Pieces of one length that are ranked in one share, and the most shares that the driver counts.
SHARE_ROWS, MOST_SHARES = 1 << 13, 1 << 16
_SLICE = 2 << 20


def pieces(docs: DataFrame, tokenizer: str | None = None, max_length: int = 2048, end_id: int = 0) -> DataFrame:
    """Token pieces of ``docs(doc_id, text)``: ids, then ``end_id``, cut every ``max_length`` ids.

    A null or empty text is one piece of the end id alone. Rows with a null
    or repeated doc_id are packed like any other.
    """
    path = tokenizer or wordtok.default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for lo, hi in row_slices(offsets, _SLICE):
                own = offsets[lo : hi + 1]
                ids, reach = wordtok.with_end(*wordtok.encoder(path).encode(data[own[0] : own[-1]], own - own[0]), end_id)
                raw = memoryview(ids.astype("<u4").tobytes())
                sizes = np.diff(reach)
                counts = -(-sizes // max_length)
                row = np.repeat(np.arange(hi - lo), counts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * max_length
                length = np.minimum(max_length, sizes[row] - start)
                a = reach[row] + start
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), (a + length).tolist(), strict=True)]
                yield batch_of(_PIECES_ARROW, batch.column(0).slice(lo, hi - lo).take(pa.array(row)), piece.astype(np.int32), start, length, crc)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(cut, _PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Rows ``(length, first_rank, end_rank, first_sequence, offset)``: the pieces
    of that length and those ranks go to consecutive sequences from
    ``first_sequence`` at ``offset``. Sequences in the same state are handled
    together, so the work follows the number of lengths.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    open_at: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    fresh = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in open_at:
                open_at[room] = []
                bisect.insort(rooms, room)
            open_at[room].append((first, n))

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        if length > capacity or length < 1:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room]
                    rooms.pop(at)
            else:
                room, first = capacity, fresh
                n = -(-left // (capacity // length))
                fresh += n
            each = room // length
            full = min(n, left // each)
            if full:
                for t in range(each):
                    rows.append((length, rank, rank + full, first, capacity - room + t * length))
                    rank += full
                left -= full * each
                put(room - each * length, first, full)
            used = full
            if left and used < n:
                for t in range(left):
                    rows.append((length, rank, rank + 1, first + used, capacity - room + t * length))
                    rank += 1
                put(room - left * length, first + used, 1)
                left, used = 0, used + 1
            put(room, first + used, n - used)
    return rows


def pack(cut: DataFrame, max_length: int = 2048) -> DataFrame:
    """``cut`` (of ``pieces``, read three times: pass a stored table) with sequence_id and offset.

    A length with many pieces is ranked in shares, each sized from the counts:
    ``SHARE_ROWS`` pieces, or more where that would give over ``MOST_SHARES``
    shares. The plan is looked up by length and block of ranks, so neither a task
    nor a lookup holds all pieces of a common length. Pieces with equal
    (doc_id, piece) go in order of their ids' checksums; those that are equal in all
    of it are interchangeable.
    """
    spark = cut.sparkSession
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # max_length rows at most
    share_rows = max(SHARE_ROWS, sum(counts.values()) // MOST_SHARES)
    shares = spark.createDataFrame(pd.DataFrame({"length": list(counts), "_shares": [n // share_rows + 1 for n in counts.values()]}).astype("int64"), "length bigint, _shares bigint")
    salted = cut.join(F.broadcast(shares), "length").withColumn("_share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_shares"))).drop("_shares")
    bases, at = [], dict.fromkeys(counts, 0)
    for r in salted.groupBy("length", "_share").agg(F.count("*").alias("n")).orderBy("length", "_share").collect():  # MOST_SHARES + max_length rows at most
        bases.append((r.length, r[1], at[r.length]))
        at[r.length] += r.n
    bases_df = spark.createDataFrame(pd.DataFrame(bases, columns=["length", "_share", "_base"]).astype("int64"), "length bigint, _share bigint, _base bigint")
    slots = pd.DataFrame(plan(counts, max_length), columns=["length", "_lo", "_hi", "_seq", "_at"]).astype("int64")
    slots_df = spark.createDataFrame(slots, "length bigint, _lo bigint, _hi bigint, _seq bigint, _at bigint")
    blocks = slots_df.withColumn("_block", F.explode(F.sequence(F.expr(f"_lo div {share_rows}"), F.expr(f"(_hi - 1) div {share_rows}"))))
    if len(slots) + sum(counts.values()) // share_rows <= BROADCAST_ROWS:
        blocks = F.broadcast(blocks)
    within = Window.partitionBy("length", "_share").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        salted.withColumn("_n", F.row_number().over(within) - 1)
        .join(F.broadcast(bases_df), ["length", "_share"])
        .withColumn("_rank", F.col("_base") + F.col("_n"))
        .withColumn("_block", F.expr(f"_rank div {share_rows}"))
    )
    return (
        ranked.join(blocks, ["length", "_block"]).where((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_seq") + F.col("_rank") - F.col("_lo")).alias("sequence_id"), F.col("_at").alias("offset"))
    )


def best_fit_packing(docs: DataFrame, tokenizer: str | None = None, max_length: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack every row of ``docs(doc_id, text, ...)``; other columns are ignored.

    One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. An empty table gives an empty result.
    """
    return pack(store(pieces(docs, tokenizer, max_length, end_id), "pieces"), max_length)
