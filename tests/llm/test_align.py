"""Alignment against plain calls of both libraries."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelake.llm import align, bpejson, pieces, queries

TEXTS = [
    "A small text, with Words! And otherwise, unbelievable internationalisation.",
    "", None, " ", "   ", "abc  ", "\n\n\t x", "a▁b", "▁", "<s> </s> <unk> <0x41> <|endoftext|> x", "É́ 中文 \U0001f600 ͅ \x00 z",
    "word and other words " * 400, "aaaaaaaaaaaaaaaaaaaa" * 30, "A small text, with Words! And otherwise, unbelievable internationalisation.", "日本語のテキスト" * 20,
]


def brute(texts):
    """The rows of the contract, text by text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(bpejson.default_path())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    letters = bpejson.byte_alphabet()
    rows, count = [], Counter()
    for text in texts:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            rows.append((0, 0, [], []))
            continue
        ends = lambda xs: [sum(map(len, xs[: k + 1])) for k in range(len(xs))] if len(xs) < 3000 else __import__("itertools").accumulate(map(len, xs))
        at_b = {e: k for k, e in enumerate(ends(bytes_b))}
        groups, links, i, j = [], [], 0, 0
        for k, e in enumerate(ends(bytes_a)):
            if e in at_b:
                groups.append(",".join(map(str, ids_a[i : k + 1])) + "|" + ",".join(map(str, ids_b[j : at_b[e] + 1])))
                links.append((ids_a[k], ids_b[at_b[e]]))
                i, j = k + 1, at_b[e] + 1
        rows.append((len(ids_a), len(ids_b), groups, links))
        count.update(links)
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(na, nb, len(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for na, nb, g, x in rows]


def _got(df):
    return [tuple(r)[1:] for r in sorted(df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())]


def test_against_the_libraries(spark):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, pairs int").repartition(3)
    assert _got(align.alignment_counts(docs)) == brute(TEXTS)


def test_whole_table(spark):
    path = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect())
    assert _got(queries.QUERIES["op13_tokenizer_alignment"](spark, path)) == brute([t for _, t in rows])


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "x y"), (4, "b"), (4, "b"), (None, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_a, r.groups_sha256 == "") for r in align.alignment_counts(df).collect())
    assert got == [(0, 0, True), (0, 2, False), (4, 1, False), (4, 1, False)]
    assert align.alignment_counts(df.limit(0)).count() == 0
    assert [tuple(r)[1:] for r in align.alignment_counts(df.where("text is null")).collect()] == [(0, 0, 0, 0, 0, 0, "")]


@given(st.sets(st.integers(1, 300), min_size=1), st.sets(st.integers(1, 300)), st.integers(0, 300))
@settings(deadline=None)
def test_group_ends(x, y, run):
    a, b = sorted({*x, *range(100, 100 + run % 120), 301}), sorted({*y, *range(100, 100 + run % 120), 301})
    got = [(int(i), int(j)) for i, j in zip(*align.group_ends(a, b), strict=True)]
    assert got == [(a.index(v), b.index(v)) for v in sorted({*a} & {*b})]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(min_size=1, max_size=30), st.text(alphabet="ab 1é▁\n<s>", min_size=1, max_size=40)), min_size=1, max_size=5))
def test_units_make_whole_texts(texts):
    """A text's ids are its units' ids, unless it has U+2581, which no id reproduces."""
    import numpy as np

    texts = [t.replace("▁", "") or "x" for t in texts]
    coder = pieces.encoder(pieces.default_path())
    raw = [(" " + t).encode() for t in texts]
    ids, reach = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))
    assert [ids[a:b].tolist() for a, b in zip(reach[:-1], reach[1:], strict=True)] == [coder.library.encode(t) for t in texts]


def test_a_vocabulary_with_inner_spaces_is_refused(monkeypatch):
    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor.id_to_piece
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "id_to_piece", lambda self, i: "a▁b" if i == 300 else plain(self, i))
    with pytest.raises(ValueError, match="space"):
        pieces.PieceEncoder(pieces.default_path())
