"""Components of link tables against a plain union of sets."""

from __future__ import annotations

import random

import pytest

from scorelake.llm import graph


def _plain(links):
    group = {}
    for u, v in links:
        a, b = group.setdefault(u, {u}), group.setdefault(v, {v})
        if a is not b:
            a |= b
            for x in b:
                group[x] = a
    return {x: min(g) for x, g in group.items()}


@pytest.mark.parametrize("at_once", [1 << 17, 40])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(graph, "_AT_ONCE", at_once)
    some = random.Random(4)
    links = [(some.randrange(-300, 300), some.randrange(-300, 300)) for _ in range(220)]
    links += [(1000 + i, 1001 + i) for i in range(60)] + [(2000 + i, 2000) for i in range(60)]
    links = [(u, v) for u, v in links if u != v]
    rows = spark.createDataFrame([*links, *links[:20], (7, 7)], "u bigint, v bigint").repartition(3)
    found = [(r.node, r.root) for r in graph.components(rows).collect()]
    assert len(found) == len(dict(found)) and dict(found) == _plain(links)
    assert graph.components(rows.limit(0)).count() == 0


def test_few_links_need_no_rounds(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(graph, "store", lambda df, what, plain=graph.store: kept.append(what) or plain(df, what))
    path = spark.range(500).selectExpr("id AS u", "id + 1 AS v")
    assert {r.root for r in graph.components(path).collect()} == {0} and kept == ["edges"]
