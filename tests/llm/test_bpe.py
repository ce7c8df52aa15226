"""Byte-level BPE against the tiktoken library, and exact round trips."""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import public_tokenizers
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelake.llm import bpe


@functools.cache
def _library():
    with open(bpe.default_path(), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _buffers(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


pieces_text = st.lists(st.sampled_from([*"abst rdmvel'' \n\t.,12é中́\x85\x1c ", "'s", "'re", "'ll", "  ", "\r\n", "\U0001f600", "don't", " I'm"]), max_size=25).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces_text, max_size=6))
def test_pieces_are_those_of_the_pattern(texts):
    data, offsets = _buffers(texts)
    starts, rows = bpe.pieces(data, offsets)
    want = [offsets[i] + len(t[: m.start()].encode()) for i, t in enumerate(texts) for m in regex.finditer(public_tokenizers.PATTERN, t)]
    assert starts.tolist() == want and len(rows) == len(texts) + 1


def test_every_codepoint_as_the_library():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{x}a " for x in every[i : i + 2000]) for i in range(0, len(every), 2000)]
    data, offsets = _buffers(texts)
    ids, reach = bpe.coder(bpe.default_path()).encode(data, offsets)
    for i, t in enumerate(texts):
        assert ids[reach[i] : reach[i + 1]].tolist() == _library().encode_ordinary(t)


def test_cache_is_bounded_and_exact():
    small = bpe.ByteBpe(bpe.default_path(), capacity=3)
    for text in ("one two three four five", "four five six", "one"):
        data, offsets = _buffers([text])
        assert small.encode(data, offsets)[0].tolist() == _library().encode_ordinary(text)


def test_round_trip_queries(spark):
    texts = ["Hello, world's  end", "", None, "x" * 70000, "Straße\n\n 12", "Hello, world's  end"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "n", "")], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r for r in bpe.round_trip(df).collect()}
    for i, t in enumerate(texts):
        ids = _library().encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert None in got
    encoded = bpe.encode(df)
    for r in encoded.collect():
        text = (dict(enumerate(texts)) | {None: "n"})[r.doc_id] or ""
        assert r.offsets[-1] == len(text.encode())
    for r in bpe.decode(encoded).collect():
        assert bytes(r.content).decode() == ((dict(enumerate(texts)) | {None: "n"})[r.doc_id] or "")
    assert bpe.round_trip(df.limit(0)).count() == 0
