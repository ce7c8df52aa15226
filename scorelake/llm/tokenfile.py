"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

A token file is a folder of byte files. Each holds blocks one after another,
every one followed by a line feed; all blocks by (part, number) are the documents in
ascending doc_id order. A block is

    magic, part, number, documents, ids, symbols, data bytes   8 + 6 * 4 bytes
    symbols        the block's ids by falling frequency, 4 bytes each
    present        one byte a document: 0 where the doc_id is null
    doc_ids        8 bytes each
    lengths        ids of each document, 4 bytes each
    control        two bits an id: the bytes of its rank less one
    data           the ranks, little-endian, one to four bytes
    crc32          of all of the above, 4 bytes

so readers find all byte positions by one table lookup of the control bytes.
Ranks are counted over each block: a table over the corpus would need every text
to be encoded twice. Files are written by Spark's text writer and read by its
binary reader, so writes commit like any Spark write and any file system works.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import wordtok
from ._io import batch_of, new_place, partitions, row_slices, text_buffers

MAGIC = b"FRVB2\0\0\0"
_HEAD = struct.Struct("<8sIIIIII")
#: Lengths of the four ranks that a control byte stands for.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)
_BLOCK_IDS = 1 << 20
_SLICE = 2 << 20
_BLOCKS = pa.schema([("payload", pa.binary())])
_SIZES = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64())])
_DOCS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("in_block", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    ranks = ranks.astype(np.uint32)
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    ends = np.cumsum(extra + np.int64(1))
    starts = ends - extra - 1
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[starts] = ranks & 0xFF
    for k in range(1, 4):
        longer = np.flatnonzero(extra >= k)
        out[starts[longer] + k] = (ranks[longer] >> np.uint32(8 * k)) & 0xFF
    return control.astype(np.uint8).tobytes(), out.tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """Inverse of ``encode_ranks``."""
    lengths = _LENGTHS[control].ravel()[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    ranks = data[starts].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(lengths > k)
        if not len(longer):
            break
        ranks[longer] |= data[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def encode_block(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, part: int = 0, number: int = 0) -> bytes:
    """One block; equal frequencies are ranked by id."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    used = np.flatnonzero(counts)
    symbols = used[np.argsort(-counts[used], kind="stable")].astype("<u4")
    rank_of = np.zeros(len(counts), np.uint32)
    rank_of[symbols] = np.arange(len(symbols), dtype=np.uint32)
    control, data = encode_ranks(rank_of[ids])
    present = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    body = b"".join((_HEAD.pack(MAGIC, part, number, len(doc_ids), len(ids), len(symbols), len(data)), symbols.tobytes(), present.tobytes(), numbers.tobytes(), lengths.astype("<u4").tobytes(), control, data))
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(block: bytes | memoryview) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a block; a damaged block raises ValueError."""
    block = memoryview(block)
    if len(block) < _HEAD.size + 4 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("a token block is damaged")
    magic, _, _, n_docs, n_ids, n_symbols, n_data = _HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = _HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(block, kind, n, at)
        at += out.nbytes
        return out

    symbols, present, numbers, lengths = take("<u4", n_symbols), take("u1", n_docs), take("<i8", n_docs), take("<u4", n_docs)
    control, data = take("u1", -(-n_ids // 4)), take("u1", n_data)
    ids = symbols[decode_ranks(control, data, n_ids)] if n_ids else np.empty(0, np.uint32)
    return [int(d) if p else None for d, p in zip(numbers, present, strict=True)], lengths, ids


def blocks_of(content: bytes | memoryview) -> Iterator[tuple[int, int, int, memoryview]]:
    """(part, number, ids, block) of a file's blocks; bytes that are none raise ValueError."""
    content, at = memoryview(content), 0
    while at < len(content):
        if len(content) - at < _HEAD.size:
            raise ValueError("a token file ends too early")
        magic, part, number, n_docs, n_ids, n_symbols, n_data = _HEAD.unpack_from(content, at)
        end = at + _HEAD.size + 4 * n_symbols + 13 * n_docs - (-n_ids // 4) + n_data + 4
        if magic != MAGIC or content[end : end + 1] != b"\n":
            raise ValueError("not a token file")
        yield part, number, n_ids, content[at:end]
        at = end + 1


def write_file(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, blocks_a_file: int = 8) -> None:
    """Encode ``docs(doc_id, text)`` and write them as a token file into the new folder ``path``.

    A null text is empty; null doc_ids come first; rows with equal doc_ids
    follow their texts; other columns are left out. An empty table gives files without
    a block. A block ends once it has ``_BLOCK_IDS`` ids, after a whole document.
    """
    vocabulary = tokenizer or wordtok.default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        numbers: list[int | None] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            return batch_of(_BLOCKS, [encode_block(numbers, np.concatenate(sizes), np.concatenate(ids), part, number)])

        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            own_ids = batch.column(0).to_pylist()
            for lo, hi in row_slices(offsets, _SLICE):
                own = offsets[lo : hi + 1]
                got, reach = wordtok.with_end(*wordtok.encoder(vocabulary).encode(data[own[0] : own[-1]], own - own[0]), end_id)
                numbers += own_ids[lo:hi]
                sizes.append(np.diff(reach))
                ids.append(got)
                n += len(got)
                if n >= _BLOCK_IDS:
                    yield flush()
                    number += 1
                    numbers, sizes, ids, n = [], [], [], 0
        if numbers:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    blocks = ordered.mapInArrow(encode, "payload binary")
    blocks.select(F.col("payload").cast("string")).write.options(compression="none", lineSep="\n", maxRecordsPerFile=blocks_a_file).text(path)


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the token file in the folder ``path``: doc_id, start, n_tokens, ids_crc32.

    A file without blocks has no documents; damaged bytes raise ValueError.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for part, number, _, block in blocks_of(content.as_buffer()):
                    numbers, lengths, ids = decode_block(block)
                    ends = np.cumsum(lengths, dtype=np.int64)
                    starts = ends - lengths
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    yield batch_of(_DOCS, np.full(len(numbers), part, np.int32), np.full(len(numbers), number, np.int32), numbers, starts, lengths.astype(np.int64), crc)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(part, number, n) for content in batch.column(0) for part, number, n, _ in blocks_of(content.as_buffer())]
            yield batch_of(_SIZES, *([x[k] for x in found] for k in range(3)))

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInArrow(decode, "part int, block int, doc_id bigint, in_block bigint, n_tokens bigint, ids_crc32 bigint")
    sizes = files.mapInArrow(measure, "part int, block int, n_ids bigint")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part, not a document
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_all")).withColumn("_part_at", F.coalesce(F.sum("_all").over(before), F.lit(0))).drop("_all")
    inner = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("_block_at", F.coalesce(F.sum("n_ids").over(inner), F.lit(0))).join(parts, "part").select("part", "block", (F.col("_part_at") + F.col("_block_at")).alias("_at"))
    return rows.join(bases, ["part", "block"]).select("doc_id", (F.col("_at") + F.col("in_block")).alias("start"), "n_tokens", "ids_crc32")


def token_file(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Write ``docs`` as a token file in the shared folder and describe each document from what is read back."""
    path = new_place(docs.sparkSession, "tokens")
    write_file(docs, path, tokenizer, end_id)
    return read_file(docs.sparkSession, path)
