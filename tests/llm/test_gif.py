"""The GIF coder: round trips, hand-made files with palettes, disposal and transparency."""

from __future__ import annotations

import hashlib
import random
import struct
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelake.llm import gif


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000))
def test_lzw_round_trip(data):
    assert gif.lzw_decode(gif.lzw_encode(data), 8) == data


@pytest.mark.parametrize("n", [3838, 9000, 200_000])
def test_lzw_long_round_trip(n):
    rng = random.Random(n)
    for data in (rng.randbytes(n), bytes(rng.choices(b"ab c", k=n)), b"a" * n):
        assert gif.lzw_decode(gif.lzw_encode(data), 8) == data


def _pack(codes, widths):
    bits = "".join(f"{c:0{w}b}"[::-1] for c, w in zip(codes, widths, strict=True))
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))


def _deferred(data):
    """A stream whose table stays full: no clear code after the first."""
    table = {bytes((i,)): i for i in range(256)}
    codes, widths, following, held = [256], [9], 258, b""
    n = 0

    def width():
        return min(12, max(9, (258 + max(n - 1, 0)).bit_length()))

    for b in data:
        if held + bytes((b,)) in table:
            held += bytes((b,))
            continue
        codes.append(table[held])
        widths.append(width())
        n += 1
        if following < 4096:
            table[held + bytes((b,))] = following
            following += 1
        held = bytes((b,))
    codes.append(table[held])
    widths.append(width())
    n += 1
    return _pack([*codes, 257], [*widths, width()])


def test_deferred_clear():
    data = bytes(random.Random(5).choices(range(40), k=60_000))
    assert gif.lzw_decode(_deferred(data), 8) == data


def _plain(codes):
    """The samples of 8-bit codes by a table, a code at a time."""
    table = [bytes((i,)) for i in range(256)] + [b"", b""]
    held = table[codes[0]]
    out = [held]
    for code in codes[1:]:
        entry = table[code] if code < len(table) else held + held[:1]
        if len(table) < 4096:
            table.append(held + entry[:1])
        out.append(entry)
        held = entry
    return b"".join(out)


def test_codes_expand_at_once():
    some = random.Random(8)
    streams = []
    for _ in range(60):
        codes = [some.randrange(256)]
        while len(codes) < 3800:
            codes.append(min(4095, 258 + len(codes) - 1 - int(some.expovariate(0.02))) if len(codes) > 200 and some.random() < 0.6 else some.randrange(256))
        streams.append([c if c not in (256, 257) else 0 for c in codes])
    expand = lambda codes: gif._expand(np.array(codes, np.uint32), 256).tobytes()
    took = []
    for form in (_plain, expand):
        took.append([])
        for _ in range(3):
            began = time.process_time()
            found = [form(s) for s in streams]
            took[-1].append(time.process_time() - began)
        assert found == [_plain(s) for s in streams]
    assert min(took[1]) < min(took[0])
    for odd in ([258], [1, 259], [1, 2, 300]):
        with pytest.raises(ValueError):
            expand(odd)
    with pytest.raises(ValueError):
        gif.lzw_decode(b"abc", 9)


def _image(w, h, left, top, samples, gce=None, local=b"", interlaced=False):
    out = b""
    if gce:
        disposal, delay, transparent = gce
        out += struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (transparent is not None), delay, transparent or 0, 0)
    out += struct.pack("<BHHHHB", 0x2C, left, top, w, h, (0x81 if local else 0) | (0x40 if interlaced else 0)) + local
    codes, widths = [], []
    for s in samples:  # a clear code before each sample keeps all codes at three bits
        codes += [4, s]
        widths += [3, 3]
    stream = _pack([*codes, 5], [*widths, 3])
    for k in range(0, len(stream), 200):
        out += bytes((len(stream[k : k + 200]),)) + stream[k : k + 200] if k else bytes((2, len(stream[:200]))) + stream[:200]
    return out + b"\0"


RED, GREEN, BLUE, BLACK = (255, 0, 0), (0, 255, 0), (0, 0, 255), (0, 0, 0)


def _file(w, h, *images):
    palette = bytes(v for c in (RED, GREEN, BLUE, BLACK) for v in c)
    comment = b"\x21\xfe\x03abc\x00"
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + palette + comment + b"".join(images) + b";"


def test_transparency_disposal_timing_and_palettes():
    local = bytes(v for c in (BLUE, BLUE, BLUE, RED) for v in c)
    data = _file(
        2, 2,
        _image(2, 2, 0, 0, [0, 1, 2, 3], (1, 7, None)),
        _image(1, 1, 1, 1, [0], (2, 5, None)),
        _image(2, 1, 0, 0, [1, 3], (3, 2, 3)),
        _image(1, 1, 0, 0, [3], None, local),
    )
    a, b, c, d = gif.decode_gif(data)
    assert [f.delay_ms for f in (a, b, c, d)] == [70, 50, 20, 0]
    assert a.canvas[:, :, :3].tolist() == [[list(RED), list(GREEN)], [list(BLUE), list(BLACK)]]
    assert b.canvas[1, 1].tolist() == [255, 0, 0, 255]
    assert c.canvas[1, 1].tolist() == [0, 0, 0, 0]  # cleared by disposal 2
    assert c.canvas[0].tolist() == [[0, 255, 0, 255], [0, 255, 0, 255]]  # the transparent sample left green
    assert d.canvas[0].tolist() == [[255, 0, 0, 255], [0, 255, 0, 255]]  # put back by disposal 3, then drawn


def test_interlace():
    rows = [0, 1, 2, 3, 0, 1, 2, 3, 1]
    order = [*range(0, 9, 8), *range(4, 9, 8), *range(2, 9, 4), *range(1, 9, 2)]
    (frame,) = gif.decode_gif(_file(1, 9, _image(1, 9, 0, 0, [rows[i] for i in order], interlaced=True)))
    assert frame.rgb[:, 0].tolist() == [list((RED, GREEN, BLUE, BLACK)[r]) for r in rows]


@pytest.mark.parametrize("data", [b"", b"GIF89a", b"PNG" * 9, gif.encode_gif(b"x" * 64)[:-9]])
def test_broken_files(data):
    with pytest.raises(ValueError):
        gif.decode_gif(data)


def test_media_columns(spark):
    texts = ["abc", "", None, "é" * 40000, "abc", "y" * 64]
    df = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)] + [(None, "q", b"")], "doc_id bigint, text string, media binary")
    got = {r.doc_id: r for r in gif.media_columns(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64) or b"\0" * 64
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
    assert got[0][1:] == got[4][1:] and len(got) == len(texts) + 1
    assert gif.media_columns(df.limit(0)).count() == 0
    media = gif.encode_media(df)
    frames = gif.frames(media).where("doc_id = 3").orderBy("frame").collect()
    assert [f.height for f in frames] == [1024, 226] and [f.start_ms for f in frames] == [0, 40]
    assert all(sum(f.histogram) == f.width * f.height for f in frames)
    assert np.frombuffer(frames[0].samples, np.uint8).reshape(-1, 3)[0].tolist() == [0xC3] * 3
