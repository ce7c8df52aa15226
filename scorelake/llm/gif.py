"""GIF media columns: an LZW coder, frames with timing and disposal, and colour histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import batch_of, store, text_buffers

# Fixed values of the format.
_SIGNATURES = (b"GIF87a", b"GIF89a")
_EXTENSION, _IMAGE, _TRAILER, _GRAPHIC = 0x21, 0x2C, 0x3B, 0xF9
_INTERLACE = ((0, 8), (4, 8), (2, 4), (1, 2))
_GREYS = bytes(v for i in range(256) for v in (i, i, i))


def _widths(min_bits: int, n: int) -> np.ndarray:
    """Bits of the codes number 0 to n-1 after a clear code."""
    entries = (1 << min_bits) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(12, np.maximum(min_bits + 1, np.floor(np.log2(entries)).astype(np.int64) + 1))


_EIGHT = _widths(8, 8192)
_SEGMENT = 4096 - 258 + 1  # codes from one clear code to the next, itself included


def lzw_encode(data: bytes) -> bytes:
    """LZW codes of 8-bit samples; the table is cleared whenever it is full."""
    # codes count in 256s, so that a code and the sample after it add up to a key
    clear = 256 << 8
    codes = [clear]
    widths = [np.array([9])]
    emit = codes.append
    if data:
        table: dict[int, int] = {}
        first, last = 258 << 8, 4096 << 8
        following = first
        prefix = data[0] << 8
        for sample in data[1:]:
            key = prefix + sample
            if key in table:
                prefix = table[key]
                continue
            emit(prefix)
            table[key] = following
            following += 256
            prefix = sample * 256
            if following == last:
                emit(clear)
                table.clear()
                following = first
        emit(prefix)
    emit(257 << 8)
    left = len(codes) - 1
    while left > 0:
        widths.append(_EIGHT[: min(left, _SEGMENT)])
        left -= _SEGMENT
    ends = np.cumsum(np.concatenate(widths))
    starts = np.append(0, ends[:-1])
    spread = np.array(codes, np.int64) >> 8 << (starts & 7)
    size = (int(ends[-1]) + 7) // 8
    # no two codes share a bit, so the sums of their bytes are the bytes
    total = sum(np.bincount((starts >> 3) + k, spread >> 8 * k & 255, size + 2) for k in range(3))
    return total[:size].astype(np.uint8).tobytes()


def _expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """Samples of the codes between two clear codes.

    Entry number k of the table is what code k wrote and the sample after it, so a code
    copies from a place in the samples themselves. Lengths and places are found for
    all codes at once, by following references twice as far in each round.
    """
    step = np.arange(len(codes))
    entry = codes.astype(np.int64) - clear - 2
    if (entry >= step).any():
        raise ValueError("a code stands before its entry")
    back = np.where(entry < 0, step, entry)
    lengths = (entry >= 0).astype(np.int64)
    at = back
    while (lengths[at] > 0).any():
        lengths = lengths + lengths[at]
        at = at[at]
    lengths += 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    source = np.arange(ends[-1]) - np.repeat(starts - starts[back], lengths)
    while not np.array_equal(source, further := source[source]):
        source = further
    samples = np.zeros(len(source), np.uint8)
    literal = entry < 0
    samples[starts[literal]] = codes[literal]
    return samples[source]


def lzw_decode(stream: bytes, min_bits: int) -> bytes:
    """Samples of an LZW code stream (clear codes at any place, a full table kept until cleared)."""
    if min_bits > 8:
        raise ValueError("samples of more than eight bits")
    clear, end = 1 << min_bits, (1 << min_bits) + 1
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    words = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    total, at = 8 * len(stream), 0
    out: list[bytes] = []
    reach = 4096
    while at < total:
        span = min(reach, (total - at) // (min_bits + 1) + 1)
        width = _EIGHT[:span] if min_bits == 8 and span <= len(_EIGHT) else _widths(min_bits, span)
        ends = at + np.cumsum(width)
        width = width[ends <= total]
        ends = ends[: len(width)]
        if not len(width):
            break
        starts = ends - width
        codes = (words[starts >> 3] >> (starts & 7).astype(np.uint32)) & ((np.uint32(1) << width.astype(np.uint32)) - np.uint32(1))
        stops = np.flatnonzero((codes == clear) | (codes == end))
        if not len(stops) and len(codes) == span == reach and at + int(width.sum()) < total:
            reach *= 4  # no clear code in sight: look further
            continue
        stop = int(stops[0]) if len(stops) else len(codes)
        if stop:
            out.append(_expand(codes[:stop], clear).tobytes())
        if stop == len(codes) or codes[stop] == end:
            break
        at = int(ends[stop])
        reach = 4096
    return b"".join(out)


def encode_gif(payload: bytes, width: int = 64, rows: int = 1024, delay_cs: int = 4) -> bytes:
    """Samples as grey frames of ``width`` by ``rows`` at most; the last frame may be lower."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must fill whole rows")
    high = len(payload) // width
    parts = [_SIGNATURES[1], struct.pack("<HHBBB", width, min(high, rows), 0xF7, 0, 0), _GREYS]
    for top in range(0, high, rows):
        own = payload[top * width : (top + rows) * width]
        parts.append(struct.pack("<BBBBHBB", _EXTENSION, _GRAPHIC, 4, 1 << 2, delay_cs, 0, 0))
        parts.append(struct.pack("<BHHHHBB", _IMAGE, 0, 0, width, len(own) // width, 0, 8))
        stream = lzw_encode(own)
        for k in range(0, len(stream), 255):
            block = stream[k : k + 255]
            parts += [bytes((len(block),)), block]
        parts.append(b"\0")
    parts.append(bytes((_TRAILER,)))
    return b"".join(parts)


@dataclass
class Frame:
    """One frame: its place and timing, its RGB samples, and the canvas once it is drawn."""

    delay_ms: int
    disposal: int
    transparent: int | None
    left: int
    top: int
    rgb: np.ndarray
    canvas: np.ndarray


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def decode_gif(data: bytes) -> list[Frame]:
    """All frames in order; ValueError on bytes that are no whole GIF.

    Disposal 2 clears a frame's area to transparent before the next one, 3 puts
    back what was there; transparent samples leave the canvas as it is.
    """
    if data[:6] not in _SIGNATURES:
        raise ValueError("not a GIF")
    try:
        return _decode(data)
    except (IndexError, struct.error) as e:
        raise ValueError("a GIF ends too early") from e


def _decode(data: bytes) -> list[Frame]:
    wide, high, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13

    def palette(packed: int) -> np.ndarray | None:
        nonlocal at
        if not packed & 0x80:
            return None
        n = 3 << ((packed & 7) + 1)
        table = np.zeros((256, 3), np.uint8)
        table[: n // 3] = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
        at += n
        return table

    shared = palette(flags)
    canvas = np.zeros((high, wide, 4), np.uint8)
    frames: list[Frame] = []
    delay, disposal, transparent = 0, 0, None
    while data[at] != _TRAILER:
        kind = data[at]
        if kind == _EXTENSION:
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == _GRAPHIC:
                packed, hundredths, index = struct.unpack_from("<BHB", body)
                delay, disposal, transparent = 10 * hundredths, packed >> 2 & 7, index if packed & 1 else None
            continue
        if kind != _IMAGE:
            raise ValueError("an unknown block")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = palette(packed)
        colours = shared if colours is None else colours
        if colours is None:
            raise ValueError("a frame without a palette")
        min_bits = data[at]
        stream, at = _blocks(data, at + 1)
        samples = lzw_decode(stream, min_bits)[: w * h]
        if len(samples) < w * h:
            raise ValueError("a frame ends too early")
        index = np.frombuffer(samples, np.uint8).reshape(h, w)
        if packed & 0x40:
            order = np.concatenate([np.arange(a, h, b) for a, b in _INTERLACE])
            straight = np.empty_like(index)
            straight[order] = index
            index = straight
        if left + w > wide or top + h > high:
            raise ValueError("a frame beyond the screen")
        area = (slice(top, top + h), slice(left, left + w))
        before = canvas[area].copy() if disposal == 3 else None
        rgb = colours[index]
        if transparent is None:
            canvas[area][:, :, :3] = rgb
            canvas[area][:, :, 3] = 255
        else:
            drawn = index != transparent
            canvas[area][drawn, :3] = rgb[drawn]
            canvas[area][drawn, 3] = 255
        frames.append(Frame(delay, disposal, transparent, left, top, rgb, canvas.copy()))
        if disposal == 2:
            canvas[area] = 0
        elif before is not None:
            canvas[area] = before
        delay, disposal, transparent = 0, 0, None
    return frames


def histogram(rgb: np.ndarray) -> np.ndarray:
    """Counts in 64 colour bins: two bits of each channel."""
    top = rgb.reshape(-1, 3) >> 6
    return np.bincount(top[:, 0].astype(np.int64) << 4 | top[:, 1] << 2 | top[:, 2], minlength=64)


def payload_of(text: bytes, unit: int = 64) -> bytes:
    """``text`` filled with bytes 0 to a positive multiple of ``unit``."""
    return text + b"\0" * (-len(text) % unit or (0 if text else unit))


def encode_media(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to a stored table (doc_id, n_bytes, media): one GIF a row.

    Null texts count as empty (one row of zeros); every other column is left out.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            raw = memoryview(data)
            media, lo = [], 0
            held = 0
            for i in range(batch.num_rows):
                media.append(encode_gif(payload_of(bytes(raw[offsets[i] : offsets[i + 1]]))))
                held += len(media[-1])
                if held > 8 << 20 or i + 1 == batch.num_rows:
                    yield batch_of(schema, batch.column(0).slice(lo, i + 1 - lo), np.diff(offsets[lo : i + 2]), media)
                    media, lo, held = [], i + 1, 0

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")
    return store(rows, "gif", compression="zstd")


def frames(media: DataFrame) -> DataFrame:
    """One row a frame of ``media(doc_id, media)``: its timing, place and histogram. Null media has no frames."""
    schema = pa.schema([("doc_id", pa.int64()), ("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("disposal", pa.int32()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.binary()), ("histogram", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = decode_gif(value.as_py()) if value.is_valid else []
                if not own:
                    continue
                delays = np.array([f.delay_ms for f in own])
                yield batch_of(
                    schema, [doc] * len(own), np.arange(len(own), dtype=np.int32), np.cumsum(delays) - delays, delays,
                    *([getattr(f, k) for f in own] for k in ("disposal", "left", "top")),
                    [f.rgb.shape[1] for f in own], [f.rgb.shape[0] for f in own], [f.rgb.tobytes() for f in own], [histogram(f.rgb).tolist() for f in own],
                )

    return media.select(F.col("doc_id").cast("bigint"), "media").mapInArrow(run, "doc_id bigint, frame int, start_ms bigint, delay_ms bigint, disposal int, left int, top int, width int, height int, samples binary, histogram array<bigint>")


def describe(media: DataFrame) -> DataFrame:
    """What the stored GIFs hold: the payload's digests, the media's, and a feature string.

    The feature is ``frames:milliseconds:`` and the non-zero bins of the summed
    colour histogram, so equal texts have equal features.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def one(value: bytes) -> tuple:
        own = decode_gif(value)
        payload = b"".join(f.rgb[:, :, 0].tobytes() for f in own)
        bins = sum((histogram(f.rgb) for f in own), np.zeros(64, np.int64))
        feature = f"{len(own)}:{sum(f.delay_ms for f in own)}:" + ",".join(f"{i}={bins[i]}" for i in np.flatnonzero(bins))
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(value), hashlib.sha256(value).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(x.as_py()) for x in batch.column(2)]
            if found:
                yield batch_of(schema, batch.column(0), batch.column(1), *map(list, zip(*found, strict=True)))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every text as a GIF, read the stored bytes back, and describe them."""
    return describe(encode_media(docs))
