"""The pipeline's stages against plain versions, each on its own input, and on odd rows."""

from __future__ import annotations

from collections import Counter

import pytest
from test_jaccard import brute as components
from test_rules import base
from test_substring import brute as repeats

import corpus_pipeline as pipeline
from scorelake.llm import quality, rules

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _rows(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("steps")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"file://{folder}/{k}")
        docs = spark.read.parquet(f"file://{folder}/{k}")
        out.append(docs)
    return out


def test_columns(steps):
    for docs in steps[:-1]:
        assert tuple(docs.columns) == pipeline.COLUMNS


def test_classifier_and_rules_reject(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after, kept = (set(_rows(s)) for s in steps[:3])
    assert after < before and kept <= after
    clean = [d for d in before if labels.get(d) == 1]
    assert sum(d in after for d in clean) > 0.95 * len(clean)
    assert sum(d in after for d in before if labels.get(d) == 0) == 0


def test_classifier_follows_the_scores(spark, steps):
    scores = quality.quality_scores(steps[0].select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(_rows(steps[1])) == {r.doc_id for r in scores.where("predicted = 1").collect()}


def test_rules_follow_a_plain_version(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = rules.quality_rules(steps[1], labels).collect()
    want = {r.doc_id for r in judged if not base(r.text)[5] and r.score >= -0.1}
    assert set(_rows(steps[2])) == want


def test_near_duplicates(steps):
    before, after = _rows(steps[2]), _rows(steps[3])
    want = components([(d, r.text) for d, r in before.items()])
    assert set(after) == {root for _, root in want.values()}
    assert all(after[d] == before[d] for d in after)


def test_substrings(steps):
    before, after = _rows(steps[3]), _rows(steps[4])
    ids = sorted(before)
    for d, (_, gone, kept) in zip(ids, repeats([before[d].text for d in ids], 35), strict=True):
        assert after[d].text == (kept if gone else before[d].text) and after[d].n_chars == len(after[d].text)


def test_packing_and_run(spark, steps):
    rows = steps[5].collect()
    assert {r.doc_id for r in rows} == set(_rows(steps[4]))
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048
    again = pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in again) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)


LONG = " ".join(f"long{i}" for i in range(60000))
TEXT = " ".join(f"word{i}" for i in range(60))
OTHER = " ".join(f"other{i}" for i in range(60))
NEAR = TEXT + " tail"
ODD = [
    (5, TEXT), (1, NEAR), (5, OTHER), (3, TEXT), (3, TEXT), (None, TEXT), (None, "alone " + " ".join(f"n{i}" for i in range(20))),
    (None, None), (7, ""), (7, None), (8, LONG), (9, "few"), (9, "few"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in ODD], SCHEMA).repartition(4)


def _pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_near_duplicates_of_odd_rows(spark, odd):
    """A row goes for its text, never for its id; one row of each group stays, repeated rows included."""
    got = _pairs(pipeline.near_duplicates(spark, odd, SF))
    want = Counter(ODD)
    for row in ((5, TEXT), (3, TEXT), (3, TEXT), (None, TEXT), (9, "few")):
        want[row] -= 1
    assert got == +want
    assert got[1, NEAR] == got[5, OTHER] == got[9, "few"] == 1


def test_classifier_judges_rows_by_their_texts(spark, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality.with_scores(odd, labels)
    assert _pairs(scored) == Counter(ODD)
    by_text = {}
    for r in scored.collect():
        by_text.setdefault(r.text or "", set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    kept = _pairs(pipeline.quality_classifier(spark, odd, SF))
    assert kept == Counter((d, t) for d, t in ODD if min(by_text[t or ""]) >= 0.5)


def test_rules_on_odd_rows(spark, odd):
    got = _pairs(pipeline.quality_rules(spark, odd, SF))
    assert all(not base(t)[5] for _, t in got) and (7, "") not in got and (None, None) not in got


def test_substrings_of_odd_rows(spark, odd):
    got = pipeline.substring_dedup(spark, odd, SF).collect()
    want = Counter()
    for (d, t), (_, gone, kept) in zip(ODD, repeats([t for _, t in ODD], 35), strict=True):
        want[d, kept if gone else t] += 1
    assert Counter((r.doc_id, r.text) for r in got) == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_packing_of_odd_rows(spark, odd):
    rows = pipeline.best_fit_packing(spark, odd, SF).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(d for d, _ in ODD)
    places = Counter()
    for r in rows:
        places[r.sequence_id] += r.length
    assert max(places.values()) <= 2048 and sum(r.length for r in rows if r.doc_id == 9) == 2 * next(r.length for r in rows if r.doc_id == 9)


def test_clashing_columns_and_empty_tables(spark, odd):
    more = ("text_key", "places", "_row", "score", "spans", "kept", "set_id", "stats", "length", "_share", "_places", "_copies", "_rules")
    wide = odd
    for k, name in enumerate(more):
        wide = wide.withColumn(name, odd.doc_id + k)
    for _, stage in pipeline.STAGES:
        assert stage(spark, wide.limit(0), SF).count() == 0
    assert _pairs(pipeline.near_duplicates(spark, wide, SF)) == _pairs(pipeline.near_duplicates(spark, odd, SF))
    assert _pairs(pipeline.substring_dedup(spark, wide, SF)) == _pairs(pipeline.substring_dedup(spark, odd, SF))
