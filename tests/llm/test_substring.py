"""Substring deduplication against brute force over all windows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelake.llm import substring

SF = "/root/testdata/sf0.01"


def brute(texts, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - length + 1):
            if count[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 9))
def test_sliding_argmin(values, width):
    got = substring.sliding_argmin(np.array(values, np.uint64), width)
    want = [max(range(i, i + width), key=lambda p: (-values[p], p)) for i in range(len(values) - width + 1)]
    assert got.tolist() == want or len(values) < width


@pytest.mark.parametrize(("length", "anchor", "seed"), [(6, 3, 1), (5, 2, 2), (9, 4, 3)])
def test_small_alphabets(spark, monkeypatch, length, anchor, seed):
    if seed > 1:  # deal even a few copies of a text
        monkeypatch.setattr(substring, "_SLOT_ROWS", 2)
    rng = np.random.default_rng(seed)
    passage = " ".join(rng.choice(list("pqrs"), 14))
    texts = [" ".join(rng.choice(list("abcdefgh"), int(rng.integers(0, 60)))) + rng.choice(["", " " + passage, "\n" + passage + " z"]) for _ in range(60)]
    texts += ["a " * 30, "x y " * 12, None, "", "  ", texts[0], texts[0], texts[1] + " "]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, n_words int").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(df, length, anchor).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.orderBy("doc_id").select("doc_id", "text").collect()
    want = brute([r.text for r in rows], 35)
    got = {r.doc_id: r for r in substring.substring_digests(docs).collect()}
    for r, (n, gone, kept) in zip(rows, want, strict=True):
        assert (got[r.doc_id].n_words, got[r.doc_id].n_removed) == (n, gone)
        assert got[r.doc_id].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_windows_with_one_hash(spark, monkeypatch):
    """Where the first hash of all windows is one, the second tells them apart."""
    plain = substring._scan.window_hashes
    monkeypatch.setattr(substring._scan, "window_hashes", lambda words, k: plain(words, k) & np.uint64(0) if k == 6 and not first.append(0) and len(first) % 2 else plain(words, k))
    first = []
    texts = [f"a{i} b c d e f g h{i}" for i in range(4)] + ["b c d e f g", "q r s t u v w"]
    data = [t.encode() for t in texts]
    raw, offsets = np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data])))
    w = substring._Words(raw, offsets, 6, 3)
    values, checks = (substring._scan.window_hashes(x, 6)[w.windows] for x in (w.hashes, w.other_hashes()))
    assert not values.any() and len(set(checks.tolist())) == len({t for x in texts for t in zip(*[x.split()[k:] for k in range(6)], strict=False)})
    hits = substring._settle(values, checks, w.row[w.windows].astype(np.uint64), w.windows - w.first[w.windows], 1, 8)
    found = [substring._unpack(x.as_py(), 8, True) for x in hits.column(1)]
    known = {(int(k), int(p)) for _, _, keys, pos, kind in found for k, p, n in zip(keys, pos, kind, strict=True) if n == 1}
    assert known == {(i, 1) for i in range(4)} | {(4, 0)}


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, long, "a"), (7, long, "b"), (7, None, None), (8, "short", "c")], "doc_id bigint, text string, source string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.source or "", len(r.spans)) for r in substring.remove_repeats(df).collect())
    assert got == [(0, 40, 40, "a", 1), (7, 0, 0, "", 0), (7, 40, 40, "b", 1), (8, 1, 0, "c", 0)]
    assert substring.remove_repeats(df.limit(0)).count() == 0
