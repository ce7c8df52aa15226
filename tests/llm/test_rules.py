"""Quality rules against a plain version of the counts and of the ratio."""

from __future__ import annotations

import math
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from scorelake.llm import queries, rules

INK = r"[^\x20\x09-\x0D]+"
BUCKETS = 1 << 6


def base(text):
    text = text or ""
    words = re.findall(INK, text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(grams)
    again = {k for i, g in enumerate(grams) if count[g] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(INK, x)]
    row = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))
    return (*row, row[0] < 10 or 100 * row[4] > 20 * row[0])


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def grams(text):
    h = [signed(xxhash.xxh64(w.encode(), 42).intdigest()) for w in re.findall(INK, text or "")]
    pairs = [signed(xxhash.xxh64(struct.pack("<q", b), xxhash.xxh64(struct.pack("<q", a), 42).intdigest()).intdigest()) for a, b in zip(h, h[1:], strict=False)]
    return [x % BUCKETS for x in h + pairs]


TEXTS = [
    "the cat sat on the mat and looked at the dog again today",
    "a b c d e a b c d e f g h i j k l m n o p q r s t u",
    "one\ntwo\none\n\n  \n one\ntwo x # $ % <b> | &",
    "x " * 50,
    "é 中文 \U0001f600 a\x0bb\x0cc\rd\te f g h i j k",
    "", None, " \n ", "few words", "the cat sat on the mat and looked at the dog again today",
    " ".join(f"w{i % 17}" for i in range(300)),
    " ".join(f"v{i}" for i in range(20000)) + " " + " ".join(f"v{i}" for i in range(6)),
    "SYMBOL### words*** are$$$ here&&& ten%%% of|| them## in$ all# now## more###",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, -1, "kept?") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, n_words int, kept string").repartition(3)


def test_counts(spark, docs):
    got = {r.doc_id: r for r in rules.with_rules(docs, [0.0] * BUCKETS).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), t
        assert r.kept == (not r.base_failed) and r.score == 0
    assert rules.with_rules(docs.limit(0), [0.0]).count() == 0


def test_ratio(spark, docs):
    target = spark.createDataFrame([(0,), (0,), (None,), (10,)], "doc_id bigint")
    got = rules.log_ratios(docs, target, BUCKETS)
    raw, good = Counter(), Counter()
    for i, t in enumerate(TEXTS):
        raw.update(grams(t))
        if i in (0, 10):
            good.update(grams(t))
    want = [math.log((good[b] + 1) / (sum(good.values()) + BUCKETS) / ((raw[b] + 1) / (sum(raw.values()) + BUCKETS))) for b in range(BUCKETS)]
    assert all(abs(a - b) < 2e-6 for a, b in zip(got, want, strict=True))
    rows = rules.with_rules(docs, got, threshold=0.0).collect()
    for r in rows:
        g = grams(TEXTS[r.doc_id])
        assert abs(r.score - sum(got[b] for b in g) / max(len(g), 1)) < 1e-5
        assert r.kept == (not r.base_failed and r.score >= 0)
    assert rules.log_ratios(docs, target.limit(0), BUCKETS) == [0.0] * BUCKETS


def test_labelled_documents_are_told_apart(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = rules.quality_rules(d.select("doc_id", "text"), labels).where("not base_failed").join(labels, "doc_id")
    counts = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) <= 0.002 * counts[1, True]
    assert counts.get((0, True), 0) <= 0.2 * counts[0, False]


def test_plan_is_native(spark, docs):
    plan = rules.quality_rules(docs, spark.createDataFrame([(0, 1)], "doc_id bigint, quality int"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_windows_with_one_hash(spark, docs, monkeypatch):
    """Four hashes for all windows: equal windows stand apart in the order of hashes, and different ones side by side."""
    monkeypatch.setattr(rules, "_window_hash", lambda hashes: F.xxhash64(*hashes).bitwiseAND(3))
    got = {r.doc_id: r.n_repeat_words for r in rules.with_rules(docs, [0.0] * BUCKETS).collect()}
    assert got == {i: base(t)[4] for i, t in enumerate(TEXTS)}


def test_base_columns_of_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.op6_quality_rules(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id])


def test_repeated_and_null_labels(spark, docs):
    marks = [(0, 1), (0, 0), (0, 1), (None, 1), (10, None)]
    a = rules.quality_rules(docs, spark.createDataFrame(marks, "doc_id bigint, quality int"))
    b = rules.quality_rules(docs, spark.createDataFrame([(0, 1)], "doc_id bigint, quality int"))
    assert {r.doc_id: r.score for r in a.collect()} == {r.doc_id: r.score for r in b.collect()}
