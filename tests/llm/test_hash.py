"""Slices that fool polynomial hashes modulo a power of two, through every operator that hashes bytes."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from scorelake.llm import _scan, bpe, jaccard, packing, substring, tokenfile, wordtok
from scorelake.llm._cache import SliceCache


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join(a if k.bit_count() % 2 == 0 else b for k in range(n))


ONE, TWO = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(0, ONE), (1, TWO), (2, f"x {ONE} y"), (3, f"x {TWO} y")], "doc_id bigint, text string").coalesce(1)


def _slices(words: list[bytes]):
    ends = np.cumsum([len(w) for w in words])
    return np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], ends[:-1])).astype(np.int64), ends.astype(np.int64)


@given(st.lists(st.binary(min_size=1, max_size=200), min_size=1, max_size=20))
def test_equal_slices_have_equal_hashes(words):
    data, starts, ends = _slices(words)
    for lower in (False, True):
        for salt in (0, 1):
            shown = [w.lower() if lower else w for w in words]
            got = _scan.slice_hashes(data, starts, ends, lower, salt)
            assert len(set(got.tolist())) == len(set(shown))
            assert [got[shown.index(w)] for w in shown] == got.tolist()


@given(st.lists(st.binary(min_size=0, max_size=150), min_size=1, max_size=9), st.integers(0, 8), st.integers(0, 149))
def test_same_slices(words, which, place):
    data, starts, ends = _slices(words)
    assert _scan.same_slices(data, starts, data.copy(), starts, ends - starts)
    w = words[which % len(words)]
    if w:
        other = data.copy()
        other[starts[which % len(words)] + place % len(w)] ^= 1
        assert not _scan.same_slices(data, starts, other, starts, ends - starts)


def test_the_cache_compares_bytes(monkeypatch):
    """With one hash for all slices the cache refuses and gives no wrong ids."""
    cache = SliceCache(8, np.int32)
    encode = lambda found: (np.array([len(x) for x in found], np.int32), np.ones(len(found), np.int64))
    monkeypatch.setattr(_scan, "slice_hashes", lambda data, starts, ends, lower=False, salt=0: np.zeros(len(starts), np.uint64))
    assert cache.ids(*_slices([b"aa", b"aa"]), encode)[0].tolist() == [2, 2]
    assert cache.ids(*_slices([b"ab"]), encode) is None
    assert cache.ids(*_slices([b"aa", b"ab"]), encode) is None


def test_token_operators(docs):
    library = wordtok.encoder(wordtok.default_path()).tokenizer
    texts = {r.doc_id: r.text for r in docs.collect()}
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    ids = {k: library.encode(t, add_special_tokens=False).ids for k, t in texts.items()}
    assert {r.doc_id: r.ids_crc32 for r in tokenfile.token_file(docs).collect()} == {k: crc([*x, 1]) for k, x in ids.items()}
    assert {r.doc_id: r.ids_crc32 for r in packing.best_fit_packing(docs).collect()} == {k: crc([*x, 0]) for k, x in ids.items()}
    assert {r.doc_id: r.decoded_sha256 for r in bpe.round_trip(docs).collect()} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in texts.items()}


def test_words_and_windows(spark):
    filler = [f"w{i}" for i in range(17)]
    rows = [(k, " ".join([*filler, w, *filler])) for k, w in enumerate((ONE, TWO))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.n_removed for r in substring.substring_digests(docs).collect()} == {0}
    few = spark.createDataFrame([(0, f"a b {ONE} c d"), (1, f"a b {TWO} c d"), (2, f"a b {ONE.upper()} c d")], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(few).collect()} == {0: 0, 1: 1, 2: 0}
