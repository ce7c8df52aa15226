"""Windows: every id once, no gaps, no padding; the tree against a plain search."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelake.llm import bpejson, queries, windows

TEXTS = ["A small text, with Words!", "", None, "x <|endoftext|> y", "word and other words " * 900, "É́ 中文 \U0001f600 12 ''s", "A small text, with Words!", *(f"text number {i} " * (i % 37) for i in range(120))]


def check(rows, ids_of, capacity):
    """Rows of one result against the ids of each document, by (doc_id, doc_tokens)."""
    sequences, covered = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = ids_of[r.doc_id]
        assert r.doc_tokens == len(ids) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
        covered[r.doc_id].append((r.start, r.length))
    for spans in (*sequences.values(), *covered.values()):
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
    assert all(sum(n for _, n in x) <= capacity for x in sequences.values())
    assert {k: sum(n for _, n in x) for k, x in covered.items()} == {k: len(x) for k, x in ids_of.items()}
    return [sum(n for _, n in x) for x in sequences.values()]


def _ids(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpejson.default_path())
    return {k: [*library.encode(t or "", add_special_tokens=False).ids, 0] for k, t in texts}


@pytest.mark.parametrize("block", [1, 1000, windows.BLOCK_TOKENS])
def test_ids_places_and_no_padding(spark, block):
    texts = list(enumerate(TEXTS))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id bigint, text string, length string, start int").repartition(3)
    rows = windows.pack_windows(docs, block_tokens=block).collect()
    sizes = check(rows, _ids(texts), 1024)
    assert all(n.bit_count() == 1 for n in sizes)


def test_whole_table(spark):
    path = "/root/testdata/sf0.001"
    rows = queries.QUERIES["op12_best_fit_windows"](spark, path).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    sizes = check(rows, _ids(texts), 1024)
    assert sum(1024 - n for n in sizes if n.bit_count() != 1) == 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "x y"), (4, "b"), (4, "b"), (None, None)], "doc_id bigint, text string").coalesce(1)
    rows = windows.pack_windows(df).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in rows if r.start == 0) == [(0, 1), (0, 3), (4, 2), (4, 2)]
    assert sum(r.length for r in rows) == 8
    assert windows.pack_windows(df.limit(0)).count() == 0


@given(st.lists(st.integers(0, 50), max_size=60), st.integers(1, 20))
@settings(deadline=None)
def test_best_fit_takes_the_tightest_window(sizes, capacity):
    got, used = windows.best_fit(sizes, capacity)
    assert used == [sum(p[2] for p in w) for w in got]
    rest = sorted(((d, s - s % capacity, s % capacity) for d, s in enumerate(sizes) if s % capacity), key=lambda p: -p[2])
    rooms: list[int] = []
    for _, _, n in rest:
        fits = [r for r in rooms if r >= n]
        rooms.remove(min(fits)) if fits else None
        rooms.append((min(fits) if fits else capacity) - n)
    assert sorted(capacity - u for u in used if u < capacity) == sorted(r for r in rooms if r)
    filled = windows.fill_by_cutting([list(w) for w in got], list(used), capacity)
    totals = [sum(p[2] for p in w) for w in filled]
    assert sum(totals) == sum(sizes) and all(t == capacity or t.bit_count() == 1 for t in totals)
    tokens = sorted((d, k) for w in filled for d, a, n in w for k in range(a, a + n))
    assert tokens == [(d, k) for d, s in enumerate(sizes) for k in range(s)]


def test_room_tree():
    tree = windows.RoomTree(9)
    assert tree.take(1) is None
    for room, window in ((9, 1), (3, 2), (5, 3), (3, 4)):
        tree.put(room, window)
    assert [tree.take(n) for n in (4, 3, 2, 9, 1)] == [(5, 3), (3, 4), (3, 2), (9, 1), None]
