"""Evaluation queries over whole tables against plain Python."""

from __future__ import annotations

import pytest

from scorelake.functions import metrics as m
from scorelake.plans import queries


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_levenshtein_whole_table(spark, sf):
    table = f"/root/testdata/{sf}"
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{table}/benchmark.parquet").collect()}
    clean = m.LevenshteinSimilarity().normalizer
    want = {}
    for i, text in texts.items():
        if i + 1 in texts:
            a, b = clean(text), clean(texts[i + 1])
            want[str(i)] = pytest.approx(1 - m.edit_distance(a, b) / max(len(a), len(b)), abs=1e-9)
    got = queries.levenshtein_similarity(spark, table).collect()
    assert {r.case_id: r.score for r in got} == want and len(got) == len(want) > 30
