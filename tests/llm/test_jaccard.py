"""The similarity join against brute force over all pairs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelake.llm import graph, jaccard

SF = "/root/testdata/sf0.01"


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows):
    """doc_id -> (size, component) by an inverted index over all shingles."""
    sets = {d: shingles(t) for d, t in rows}
    index = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            index[x].append(d)
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for d, s in sets.items():
        shared = Counter(e for x in s for e in index[x] if e < d)
        for e, both in shared.items():
            if 100 * both >= 75 * (len(s) + len(sets[e]) - both):
                a, b = sorted((root(d), root(e)))
                up[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def near_copies(seed, n):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = list(rng.choice(vocabulary, 12))
    bases = [list(rng.choice(vocabulary, int(m))) for m in rng.integers(3, 90, 12)]
    out = []
    for _ in range(n):
        words = list(bases[int(rng.integers(len(bases)))])
        for _ in range(int(rng.integers(0, 3))):
            words[int(rng.integers(len(words)))] = str(rng.choice(vocabulary))
        if rng.random() < 0.3:
            words += passage
        if rng.random() < 0.1:
            words = [w.upper() for w in words]
        out.append(" ".join(words))
    return out + ["", None, "  ", "one", "one", "two words", "Two  words", "a b c d", "a b c d e"]


@pytest.mark.parametrize(("seed", "split", "rounds"), [(1, None, 2), (2, 40, 2), (3, 20, 0)])
def test_against_all_pairs(spark, monkeypatch, seed, split, rounds):
    if split:  # deal even small lists to several tasks, and know all frequent shingles
        monkeypatch.setattr(jaccard, "_SPLIT", split)
        monkeypatch.setattr(jaccard, "_LIST_ROWS", 7)
    rows = [(7 + 3 * i, t) for i, t in enumerate(near_copies(seed, 500))]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, n string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, star_rounds=rounds).collect()}
    assert got == brute(rows)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == want
    kept = {r.doc_id for r in jaccard.one_of_each(docs).select("doc_id").collect()}
    assert kept == {root for _, root in want.values()}


def test_last_meeting(spark, monkeypatch):
    """All similar pairs of different components in a list that is dealt to several blocks, and no others."""
    monkeypatch.setattr(jaccard, "_near", lambda x, y, na, nb, rule: jaccard._sized(na, nb, rule))
    rng = np.random.default_rng(5)
    rows = [(int(k), 3, int(rng.integers(3)), 1000 * k + i, int(rng.integers(4)), int(n), i, [0]) for k in (4, 5) for i, n in enumerate(rng.integers(2, 60, 40))]
    df = spark.createDataFrame(rows, "key bigint, slots bigint, slot bigint, a bigint, root bigint, na int, u bigint, x array<bigint>")
    got = [(r.a, r.b) for r in jaccard._last_meeting(df, jaccard.Rule(), 30).collect()]
    want = {(p[3], q[3]) for p in rows for q in rows if p[0] == q[0] and p[4] < q[4] and 4 * min(p[5], q[5]) >= 3 * max(p[5], q[5]) and (p[0] % 2 or max(p[5], q[5]) > 30)}
    assert set(got) == want and len(got) == len(want)


def test_odd_rows(spark):
    text = " ".join(f"v{i}" for i in range(30))
    df = spark.createDataFrame([(None, text), (5, text), (5, "other"), (3, text), (None, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard.jaccard_components(df).collect())
    assert got == [(-1, 0, -1), (-1, 26, -1), (3, 26, 3), (5, 1, 5), (5, 26, 3)]
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=150), st.sets(st.integers(0, 2**64 - 1), max_size=150), st.integers(0, 150))
def test_parity_bits_bound_the_difference(a, extra, drop):
    b = (set(sorted(a)[drop:]) | extra) or {1}
    x, y = (jaccard.parity_bits(np.array(sorted(s), np.uint64)) for s in (a, b))
    while len(x) != len(y):
        x, y = (p[: len(p) // 2] ^ p[len(p) // 2 :] if len(p) > len(q) else p for p, q in ((x, y), (y, x)))
    assert int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= len(a ^ b)


def test_boundary_follows_cost():
    rule = jaccard.Rule()
    sizes = {n: 10 for n in range(1, 200)}
    low, high = jaccard.boundary(sizes, 0.0, rule), jaccard.boundary(sizes, 50.0, rule)
    assert low < high < 100
    assert jaccard.boundary({}, 1.0, rule) == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, links):
    up = {x: x for pair in links for x in pair}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    df = spark.createDataFrame(links, "u bigint, v bigint")
    got = {r.node: r.root for r in graph.components(df).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def test_repeated_rows_are_not_squared(spark):
    """Two near texts, each on many rows with one doc_id and on rows with other ids: one member blob a task."""
    words = [f"w{i}" for i in range(40)]
    one, two = " ".join(words), " ".join([*words[:-1], "z"])
    rows = [(1, one)] * 300 + [(2, two)] * 300 + [(k, one) for k in range(3, 200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    sets = {r.a: r.b for r in jaccard._describe(docs, jaccard.Rule()).where("kind = 0").select("a", "b").collect()}
    pairs = spark.createDataFrame([(sets[1], 1, sets[2], 2)], "a bigint, u bigint, b bigint, v bigint")
    links = jaccard._verified(pairs, docs, jaccard.Rule())
    assert {(r.u, r.v) for r in links.collect()} == {(1, 2)} and links.count() <= 9
    assert {r.component_id for r in jaccard.jaccard_components(docs).collect()} == {1}
