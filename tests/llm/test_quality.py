"""The quality classifier: statistics by brute force, isotonic fit, held-out accuracy."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorelake.llm import quality, queries

SF = "/root/testdata/sf0.01"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 5), st.floats(0, 1)), min_size=1, max_size=12))
def test_isotonic_is_least_squares(pairs):
    w, m = np.array([p[0] for p in pairs], float), np.array([p[1] for p in pairs])
    fit = quality.isotonic(w, m)
    assert (np.diff(fit) >= -1e-12).all()
    for i in range(len(m)):  # the max-min formula
        best = max(min(np.average(m[a : b + 1], weights=w[a : b + 1]) for b in range(i, len(m))) for a in range(i + 1))
        assert math.isclose(fit[i], best, abs_tol=1e-9)


def test_statistics_by_hand():
    texts = ["One one TWO!! 7#\nx|", "", "a a a b"]
    raw = [t.encode() for t in texts]
    x = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    named = [dict(zip(quality.STATISTICS, row, strict=True)) for row in x]
    n = len(raw[0])
    assert named[0]["upper"] == pytest.approx(4 / n) and named[0]["bang"] == pytest.approx(2 / n) and named[0]["pipe"] == pytest.approx(1 / n)
    assert named[0]["log_words"] == pytest.approx(math.log(6)) and named[0]["log_longest"] == pytest.approx(math.log(6))
    assert not x[1].any()
    assert named[2]["distinct"] == pytest.approx(0.5) and named[2]["adjacent"] == pytest.approx(0.5)


def test_held_out_accuracy_and_whole_result(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.quality_scores(docs, labels).cache()
    assert got.count() == docs.count()
    for r in got.limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    r = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("a")).first()
    assert r.a > 0.97


def test_only_other_folds_are_learnt(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(300), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (dict(quality.quality_scores(docs, x).select("doc_id", "score").collect()) for x in (labels, flipped))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, 0), (1, "", 1), (None, "x", 0), (2, "word " * 50000, 1)], "doc_id bigint, text string, stats int")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id bigint, quality int")
    assert quality.quality_scores(docs, some).count() == 4
    assert quality.quality_scores(docs.limit(0), some).count() == 0


def plain_statistics(text):
    """The statistics of one text, letter by letter and word by word."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if not raw:
        return [0.0] * len(quality.STATISTICS)
    kinds = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\x0b\x0c\r", "newline": b"\n", "symbol": b"#*$%&<>", "pipe": b"|", "bang": b"!", "stop": b".,;:?"}
    share = {k: sum(c in v for c in raw) / len(raw) for k, v in kinds.items()}
    share["high"] = sum(c > 127 for c in raw) / len(raw)
    share["control"] = sum((c < 32 or c == 127) and c not in b" \t\x0b\x0c\r\n" for c in raw) / len(raw)
    share["punct"] = 1 - sum(share.values())
    lengths = [len(w) for w in words]
    n = max(len(words), 1)
    mean = sum(lengths) / n
    rest = [math.log1p(len(words)), mean, math.sqrt(max(sum(x * x for x in lengths) / n - mean * mean, 0)), math.log1p(max(lengths, default=0)), len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, math.log1p(len(words) / (1 + raw.count(b"\n")))]
    return [share[k] for k in quality.STATISTICS[:12]] + rest


def test_registered_query_against_a_plain_fit(spark):
    """Statistics, random features, ridge and calibration over the whole table at once, without partition sums."""
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    marks = {r.doc_id: float(r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    ids = sorted(texts)
    x = np.array([plain_statistics(texts[d]) for d in ids])
    learnt = [i for i, d in enumerate(ids) if d in marks]
    y = np.array([marks[ids[i]] for i in learnt])
    own = x[learnt]
    deviation = own.std(0)
    rng = np.random.default_rng(7)
    weights, phases = rng.normal(0, math.sqrt(2 * 0.04), (x.shape[1], 256)), rng.uniform(0, 2 * math.pi, 256)
    z = np.clip((x - own.mean(0)) / np.where(deviation > 1e-9, deviation, 1.0), -6, 6)
    features = np.hstack((np.ones((len(x), 1)), np.cos(z @ weights + phases) * math.sqrt(2 / 256)))
    a = features[learnt]
    penalty = np.diag([0.0] + [1e-3 * len(y)] * 256) + 1e-9 * len(y) * np.eye(257)
    beta = np.linalg.solve(a.T @ a + penalty, a.T @ y)
    raw = np.clip(features @ beta, -1, 2)
    place = np.minimum(((raw[learnt] + 1) / 3 * 1024).astype(int), 1023)
    bins = sorted(set(place.tolist()))
    w, m, at = (np.array([f(place == b) for b in bins], float) for f in (np.sum, lambda k: y[k].mean(), lambda k: raw[learnt][k].mean()))
    fitted = [max(min(np.average(m[i : j + 1], weights=w[i : j + 1]) for j in range(k, len(m))) for i in range(k + 1)) for k in range(len(m))]
    want = np.interp(raw, at, fitted)
    got = {r.doc_id: r for r in queries.op2_quality_classifier(spark, SF).collect()}
    score = np.array([got[d].score for d in ids])
    assert len(got) == len(ids)
    assert np.mean(np.abs(score - want) < 1e-3) > 0.995  # a raw score on a bin's edge may fall to its other side
    assert np.mean([got[d].predicted == int(s >= 0.5) for d, s in zip(ids, want, strict=True)]) > 0.998


def test_labels_that_differ_count_by_their_mean(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(300), spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    a, b = (dict(quality.quality_scores(docs, x).select("doc_id", "score").collect()) for x in (labels, labels.union(labels)))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)
