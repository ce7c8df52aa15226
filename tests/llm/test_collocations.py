"""Collocations against plain counting."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelake.llm import collocations, queries

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, most=2000):
    """The rows of the contract from (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LETTERS)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if 2 <= len(p) <= 4 and a >= least}
        inside = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        rows = []
        for p, a in found.items():
            score, k = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            if not 100 * inside[p] >= 80 * a:
                rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:most], 1)]
    return sorted(out)


def _got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def _texts():
    some = np.random.default_rng(5)
    words = ["the", "of", "New", "york", "a", "b\x01", "b", "b\x00c", "é", "\x1f", "non break", "x" * 70]
    rows = []
    for i in range(300):
        n = int(some.integers(0, 40))
        text = "".join(words[k] + sep for k, sep in zip(some.zipf(1.4, n) % len(words), some.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "!"], n), strict=True))
        rows.append((["en", "de", None, "und"][i % 4], text if i % 19 else None))
    return rows + [("en", "New York of the"), ("en", ""), ("fr", " .,\n"), ("zz", "one two")] * 40


@pytest.mark.parametrize(("size", "stream"), [(1 << 24, 50_000), (700, 9)])
def test_against_plain_counting(spark, size, stream):
    rows = _texts()
    docs = spark.createDataFrame([(a, t, 1, "p") for a, t in rows], "lang string, text string, n int, part string").repartition(5)
    assert _got(collocations.phrase_collocations(docs, partition_bytes=size, stream_rows=stream)) == brute(rows)
    assert _got(collocations.phrase_collocations(docs, least=3, most=7, partition_bytes=size, stream_rows=stream)) == brute(rows, 3, 7)


def test_whole_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("lang", "text").collect()]
    assert _got(queries.QUERIES["op11_phrase_collocations"](spark, path)) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([(None, None)], "lang string, text string")
    assert collocations.phrase_collocations(df).count() == 0
    assert collocations.phrase_collocations(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["en", "de"]), st.text(alphabet="ab\x01\x00é .\t", max_size=25)), min_size=1, max_size=8), st.integers(0, 40))
def test_runs_merge(rows, cut):
    """Windows that are cut at a bound and merged again are the windows of all rows."""

    def windows(some):
        raw = [t.encode() for _, t in some]
        return collocations.windows_of(pa.array([a for a, _ in some], pa.string()), np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))

    whole = windows(rows)
    every = whole.tuples(1)
    assert every == sorted(set(every)) and whole.edges(every) == list(range(len(every)))
    bound = ((cut % 3 * b"d" + b"e"), b"a", b"", b"", b"")
    assert whole.edges([bound]) == [sum(x < bound for x in every)]
    if every:
        halves = [windows([r]) for r in rows if r[1].strip(" .\t")]
        runs = [(w.langs, w.packed(a, b)) for w in halves for a, b in ((0, len(w.counts) // 2), (len(w.counts) // 2, len(w.counts))) if b > a]
        again = collocations.merged(runs)
        assert again.tuples(1) == every and again.counts.tolist() == whole.counts.tolist()


def test_counts_beyond_64_bits_in_products(spark):
    """Scores are exact where 2000000 a passes 64 bits."""
    a = 7 * 10**12 + 3
    rows = [("en", "", 3 * a), ("en", "p", 2 * a + 1), ("en", "q", a + 5), ("en", "p q", a)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, n bigint")
    plain = collocations.phrase_counts
    try:
        collocations.phrase_counts = lambda *_: counts
        got = _got(collocations.phrase_collocations(counts.select("lang", "phrase")))
    finally:
        collocations.phrase_counts = plain
    assert got == [("en", 1, "p q", a, 2 * a + 1, a + 5, 3 * a, 2000000 * a // (3 * a + 6))]
