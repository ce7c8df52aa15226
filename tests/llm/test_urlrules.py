"""URL filters: fixed rules and mined rules against plain Python."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import pytest

from scorelake.llm import queries, urlrules

URLS = [
    "https://a.Example.com/en/7198#top", "http://example.com/en/8?x=/en/7", "https://com/en/", "https://xcom/en/1", "http://b.net/de/8", "http://example.net/de/8",
    "http://example.net/de/81.html", "http://m.example.net/de/7", "https://x.org/es/", "https://x.org/es", "x.org/es/1", None, "", "://", "https://a.example.com?en/7",
    "ftp://A.B.COM#/en/7", "https://u:p@h.com:80/en/x//y", "http://É.com/en/7",
]


def plain(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for r in urlrules.DEFAULT_RULES:
        h, _, p = r.text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r.text) > len(best.text)):
            best = r
    return host, path, best and best.text, best.verdict if best else "allow"


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "url string, marked boolean")


def test_fixed_rules(spark, none):
    df = spark.createDataFrame([(i, u, 5) for i, u in enumerate(URLS)] + [(None, URLS[0], 5)], "page_id bigint, url string, host int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.url_verdicts(df, none).collect()}
    assert got == {i: plain(u) for i, u in enumerate(URLS)} | {None: plain(URLS[0])}
    assert urlrules.url_verdicts(df.limit(0), none).count() == 0


def test_mined_rules(spark):
    rows = [(f"http://{h}.site.io/{p}/{i}", h == "spam" or (h == "blog" and p == "ads")) for i, (h, p) in enumerate(list(itertools.product(("spam", "blog", "www"), ("ads", "news", "de"))) * 12)]
    labelled = spark.createDataFrame([*rows, (None, True), ("http://n.io", None)], "url string, marked boolean")
    tokens = [(frozenset(r.t), m) for (_, m), r in zip(rows, spark.createDataFrame(rows, "url string, marked boolean").select(urlrules.tokens_of(urlrules.F.col("url")).alias("t")).collect(), strict=True)]
    every, marked = Counter(), Counter()
    for t, m in tokens:
        for k in (1, 2, 3):
            for c in itertools.combinations(sorted(t), k):
                every[c] += 1
                marked[c] += m
    n = len(rows)
    strong = {c for c in every if marked[c] / n >= 0.1 and marked[c] / every[c] >= 0.9}
    want = {c for c in strong if not any(set(o) < set(c) for o in strong)}
    got = {tuple(r.tokens) for r in urlrules.mine(labelled, 0.1, 0.9, least_rows=5, least_lift=0, least_z=-99).collect()}
    assert got == want and want
    pages = spark.createDataFrame([(1, "https://spam.site.io/x"), (2, "http://blog.site.io/ads/9"), (3, "http://blog.site.io/news/9"), (4, "http://www.site.io/ads"), (5, None)], "page_id bigint, url string")
    verdicts = {r.page_id: r.verdict for r in urlrules.url_verdicts(pages, labelled, least_support=0.1, least_confidence=0.9, least_rows=5, least_lift=0, least_z=-99).collect()}
    assert verdicts == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def test_mined_rules_of_four_tokens(spark):
    """No part of a rule reaches the confidence; sets of every size are enumerated."""
    rows = [(f"http://{h}.io/{a}/{b}?{q}={i}", (h, a, b, q) == ("spam", "sale", "cheap", "ref")) for i in range(4) for h, a, b, q in itertools.product(("spam", "blog"), ("sale", "info"), ("cheap", "plain"), ("ref", "id"))]
    rows += [(f"http://old.io/{i}/dead", True) for i in range(5)]
    labelled = spark.createDataFrame(rows, "url string, marked boolean")
    every, marked = Counter(), Counter()
    for r in labelled.select("marked", urlrules.tokens_of(urlrules.F.col("url")).alias("t")).collect():
        for k in range(1, len(r.t) + 1):
            for c in itertools.combinations(sorted(r.t), k):
                every[c] += 1
                marked[c] += r.marked
    strong = {c for c in every if marked[c] / len(rows) >= 0.05 and marked[c] / every[c] >= 0.9}
    want = {c for c in strong if not any(set(o) < set(c) for o in strong)}
    assert {len(c) for c in want} == {1, 4}
    found = urlrules.mine(labelled, 0.05, 0.9, least_rows=3, least_lift=0, least_z=-99).collect()
    assert {tuple(r.tokens) for r in found} == want and len(found) == len(want)
    pages = spark.createDataFrame([(1, "http://spam.io/sale/cheap?ref=9"), (2, "http://spam.io/sale/cheap?id=9"), (3, "http://blog.io/sale/cheap?ref=9"), (4, "http://old.io/x")], "page_id bigint, url string")
    verdicts = {r.page_id: r.verdict for r in urlrules.url_verdicts(pages, labelled, least_support=0.05, least_confidence=0.9, least_rows=3, least_lift=0, least_z=-99).collect()}
    assert verdicts == {1: "block", 2: "allow", 3: "allow", 4: "block"}


def every_rule(rows, support, confidence, least_rows, lift, z):
    """Rules of (tokens, marked) rows by enumeration of all token sets, without those that a smaller one implies."""
    every, marked = Counter(), Counter()
    for tokens, m in rows:
        for k in range(1, len(tokens) + 1):
            for c in itertools.combinations(sorted(tokens), k):
                every[c] += 1
                marked[c] += m
    n, base = len(rows), sum(m for _, m in rows) / len(rows)
    good = lambda c: marked[c] / n >= max(support, least_rows / n) - 1e-12 and marked[c] / every[c] >= max(confidence, lift * base) and marked[c] / every[c] - base >= z * (base * (1 - base) / every[c]) ** 0.5
    strong = {c for c in every if good(c)}
    return {c for c in strong if not any(tuple(sorted(o)) in strong for k in range(1, len(c)) for o in itertools.combinations(c, k))}


def test_whole_table_with_mined_rules(spark):
    """The registered query with its own settings, rules and verdicts by enumeration."""
    sf = "/root/testdata/sf0.01"
    pages, labels = spark.read.parquet(f"{sf}/pages.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    token = urlrules.tokens_of(urlrules.F.col("url")).alias("t")
    labelled = [(r.t, r.marked) for r in queries.labelled_urls(pages, labels).select(token, "marked").collect()]
    want = every_rule(labelled, 0.005, 0.3, 10, 1.25, 2.58)
    found = {tuple(r.tokens) for r in urlrules.mine(queries.labelled_urls(pages, labels)).collect()}
    assert found == want
    tokens = {r.page_id: set(r.t) for r in pages.select("page_id", token).collect()}
    for r in queries.op9_url_filters(spark, sf).collect():
        if r.rule is None:
            assert r.verdict == ("block" if any(set(c) <= tokens[r.page_id] for c in want) else "allow")


def test_long_shared_paths(spark):
    """Tokens that come together are one class: 25 shared parts make no more item sets than one, alone or with a host."""
    deep, chain = "/".join(f"deep{chr(97 + i)}" for i in range(25)), "/".join(f"q{chr(97 + i)}" for i in range(12))
    rows = [(f"http://one.io/{deep}/{i}", True) for i in range(40)] + [(f"http://h{chr(97 + i % 20)}.io/x/{i}", i % 50 == 0) for i in range(1500)]
    rows += [(f"http://m.io/{chain}/{i}", True) for i in range(30)] + [(f"http://m.io/y/{i}", False) for i in range(120)] + [(f"http://n.io/{chain}/{i}", False) for i in range(120)]
    labelled = spark.createDataFrame(rows, "url string, marked boolean")
    tokens = [(r.t, r.marked) for r in labelled.select("marked", urlrules.tokens_of(urlrules.F.col("url")).alias("t")).collect()]
    held = {}
    for i, (ts, _) in enumerate(tokens):
        for t in ts:
            held.setdefault(t, set()).add(i)
    members = {}
    for t, at in held.items():
        members.setdefault(frozenset(at), []).append(t)
    name = {t: min(ts) for ts in members.values() for t in ts}
    assert max(map(len, members.values())) > 25
    small = every_rule([(sorted({name[t] for t in ts}), m) for ts, m in tokens], 0.005, 0.3, 10, 1.25, 2.58)
    by_name = {min(ts): ts for ts in members.values()}
    want = {tuple(sorted(c)) for rule in small for c in itertools.product(*(by_name[k] for k in rule))}
    found = [tuple(r.tokens) for r in urlrules.mine(labelled).collect()]
    assert set(found) == want and len(found) == len(want) and {1, 2} <= {len(c) for c in want}
    pages = spark.createDataFrame([(1, "http://a.io/deepc/1"), (2, "http://m.io/qd/1"), (3, "http://m.io/z/1"), (4, "http://a.io/qd/1")], "page_id bigint, url string")
    verdicts = {r.page_id: r.verdict for r in urlrules.url_verdicts(pages, labelled, ()).collect()}
    assert verdicts == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_no_common_token(spark):
    labelled = spark.createDataFrame([(f"s{i}://h{i}x{'abcdefghijklmnopqrst'[i]}.d{'abcdefghijklmnopqrst'[i]}", True) for i in range(20)], "url string, marked boolean")
    assert urlrules.mine(labelled).count() == 0 and urlrules.mine(labelled.limit(0)).count() == 0


def test_rules_exist_and_rest_on_evidence(spark):
    """Marks that go with a host label make rules; the same marks dealt at random make none that is as strong."""
    rows = [(f"http://{h}.site.io/en/{1000 + i}.html", i % 10 < (6 if h == "spam" else 2)) for i in range(300) for h in ("spam", "blog")]
    found = {tuple(r.tokens) for r in urlrules.mine(spark.createDataFrame(rows, "url string, marked boolean")).collect()}
    assert ("h:spam",) in found and ("h:blog",) not in found


def test_plan_is_native(spark):
    frame = queries.op9_url_filters(spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_equal_rules_repeated_rows_and_a_long_url(spark, none):
    rules = (urlrules.UrlRule("io/x/", "block"), urlrules.UrlRule("io/x/", "allow"))
    df = spark.createDataFrame([(1, "http://a.io/x/1"), (1, "http://a.io/x/1"), (2, "http://b.io/" + "y/" * 200000)], "page_id bigint, url string")
    got = sorted((r.page_id, r.rule or "", r.verdict) for r in urlrules.url_verdicts(df, none, rules).collect())
    assert got == [(1, "io/x/", "block"), (1, "io/x/", "block"), (2, "", "allow")]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: (r.host, r.path, r.rule) for r in queries.op9_url_filters(spark, sf).collect()}
    assert got == {r.page_id: plain(r.url)[:3] for r in pages.collect()}
