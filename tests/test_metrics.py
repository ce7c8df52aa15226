"""Metrics and normalisation: hand-computed values, and columns against the Python form."""

from __future__ import annotations

import json
import math
import time
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorelake.functions import metrics as m
from scorelake.functions.text import TextNormalizer
from scorelake.operators.suite import score
from scorelake.registry import build_metric
from scorelake.sources.cases import from_records


def value(metric, a, b):
    return metric.evaluate(a, b).score


def test_normalizer():
    assert TextNormalizer()("  a \n  b\x1c ") == "a b"
    assert TextNormalizer()("é") == "é"
    assert TextNormalizer(lowercase=True, strip_punctuation=True).tokenize("Straße, don't_x!") == ["strasse", "don", "t_x"]
    assert TextNormalizer(collapse_whitespace=False)(" a  b ") == "a  b"
    assert TextNormalizer().to_dict() == {"unicode_form": "NFC", "lowercase": False, "collapse_whitespace": True, "strip_punctuation": False}
    for bad in (None, 3, True, ["a"]):
        with pytest.raises(TypeError):
            TextNormalizer()(bad)
    with pytest.raises(ValueError):
        TextNormalizer(unicode_form="NFX")
    with pytest.raises(TypeError):
        TextNormalizer(lowercase=1)


def test_hand_values():
    f1 = m.TokenF1().evaluate("red red blue", "red blue blue")
    assert f1.score == pytest.approx(2 / 3) and f1.details["overlap"] == 2
    assert [value(m.TokenF1(), *p) for p in (("", ""), ("a", ""), ("", "a"), ("a", "b"))] == [1, 0, 0, 0]
    assert value(m.CharacterF1(), "book", "boot") == 0.75 and value(m.CharacterF1(), "x", "y") == 0 and value(m.CharacterF1(), "", "") == 1
    assert value(m.ExactMatch(), " a  b", "a b ") == 1 and value(m.ExactMatch(), "a", "A") == 0
    assert value(m.LevenshteinSimilarity(), "kitten", "sitting") == pytest.approx(4 / 7)
    rouge = m.RougeL().evaluate("a b c d", "a c")
    assert (rouge.details["lcs"], rouge.details["precision"], rouge.details["recall"]) == (2, 1.0, 0.5)
    assert value(m.RougeL(beta=2.0), "a b c d", "a c") == pytest.approx(5 * 0.5 / (0.5 + 4))
    assert value(m.SentenceBleu(), "a b c d e", "a b") == pytest.approx(math.exp(-1.5))
    assert value(m.SentenceBleu(), "a b c", "a b c") == 1
    assert value(m.SentenceBleu(), "a", "b") == 0.5 and value(m.SentenceBleu(smooth=0.0), "a", "b") == 0
    assert value(m.SentenceBleu(effective_order=False), "a", "a") == 0


@pytest.mark.parametrize(("a", "b", "options", "want"), [
    ("8.25", "8.29", {"absolute_tolerance": "0.04"}, 1), (640, 656, {"relative_tolerance": 0.025}, 1), (640, 657, {"relative_tolerance": 0.025}, 0),
    ("75 %", 0.75, {"allow_percent": True}, 1), ("9,876,543.21", "9876543.21", {"allow_commas": True}, 1), ("+10,500e-1", 1050, {"allow_commas": True}, 1), ("-7,250,000%", "-72500", {"allow_commas": True, "allow_percent": True}, 1),
    ("١٢", 12, {}, 1), (".5", "0.5", {}, 1), ("8.", 8, {}, 1), ("1e-19", "2e-19", {}, 0), ("1e-19", "2e-19", {"absolute_tolerance": "1e-19"}, 1),
])
def test_numbers(a, b, options, want):
    assert value(build_metric({"kind": "numeric_equivalence", **options}), a, b) == want


@pytest.mark.parametrize("text", ["12,34", "1000,000", ",500", "7,", "7,,000", "3,000,00", "0.1,000", "NaN", "Infinity", "", ".", "-", "e5", "1 2", True, None, {}, [1], float("inf"), "50 %%", "1e99999999999999999999"])
def test_no_numbers(text):
    got = m.NumericEquivalence(allow_percent=True, allow_commas=True).evaluate(text, "n/a")
    assert got.score is None and got.reason == "unparseable reference and prediction"
    assert m.NumericEquivalence().evaluate("1", "x").reason == "unparseable prediction"


def test_percent_and_commas_are_opt_in():
    for text in ("50%", "2,500"):
        assert m.NumericEquivalence().evaluate(text, "1").reason == "unparseable reference"
    details = m.NumericEquivalence(Decimal("0.05"), Decimal(0)).evaluate("7.5", "7.53").details
    assert details == {"reference": "7.5", "prediction": "7.53", "difference": "0.03", "allowed_difference": "0.05"}


@pytest.mark.parametrize("config", [
    "nope", {"kind": 3}, {"kind": "rouge_l", "beta": 0}, {"kind": "rouge_l", "beta": float("nan")}, {"kind": "sentence_bleu", "max_order": 9}, {"kind": "sentence_bleu", "smooth": -1},
    {"kind": "exact_match", "x": 1}, {"kind": "exact_match", "normalizer": {"y": 1}}, {"kind": "numeric_equivalence", "absolute_tolerance": -1}, {"kind": "numeric_equivalence", "absolute_tolerance": "abc"},
])
def test_bad_configurations(config):
    with pytest.raises(ValueError):
        build_metric(config)


@pytest.mark.parametrize("config", [3, {"kind": "rouge_l", "beta": True}, {"kind": "rouge_l", "beta": "2"}, {"kind": "sentence_bleu", "max_order": 2.0}, {"kind": "sentence_bleu", "effective_order": 1},
    {"kind": "numeric_equivalence", "allow_commas": 1}, {"kind": "numeric_equivalence", "relative_tolerance": []}, {"kind": "exact_match", "normalizer": 3}, {"kind": "exact_match", "normalizer": {"lowercase": "yes"}}])
def test_bad_option_types(config):
    for kind in (TypeError, ValueError):
        with pytest.raises(kind):
            build_metric(config)


def test_decimal_options():
    metric = build_metric({"kind": "numeric_equivalence", "absolute_tolerance": Decimal("0.125")})
    assert metric.absolute_tolerance == Decimal("0.125") and value(metric, 1, "1.125") == 1
    for bad in (Decimal("NaN"), Decimal("Infinity"), float("nan")):
        with pytest.raises(ValueError):
            build_metric({"kind": "numeric_equivalence", "absolute_tolerance": bad})


PAIRS = [("The cat sat.", "the cat SAT on a mat"), ("", ""), ("a", ""), ("", "b c"), ("Straße été", "strasse éte"), ("x y z x", "x x y w"), ("one two three four five six", "one three two four six five"), ("\U0001f600 a", "a \U0001f600"), ("a-b_c", "a b_c")]
METRICS = [m.ExactMatch(), m.TokenF1(), m.CharacterF1(), m.RougeL(), m.RougeL(beta=2.0), m.SentenceBleu(), m.SentenceBleu(max_order=2, smooth=0.0, effective_order=False), m.LevenshteinSimilarity()]


def test_columns_equal_python(spark):
    cases = from_records(spark, [{"id": str(i), "reference": a, "prediction": b} for i, (a, b) in enumerate(PAIRS)]).repartition(3)
    for metric in METRICS:
        for native in (True, False):
            got = {int(r.case_id): r.raw for r in score(cases, metric, native).collect()}
            for i, (a, b) in enumerate(PAIRS):
                want = metric.evaluate(a, b)
                assert got[i].score == pytest.approx(want.score, abs=1e-12), (metric, native, a, b)
                details = json.loads(got[i].details)
                for k in ("overlap", "lcs", "precision", "recall", "distance", "scale", "reference_tokens", "prediction_tokens", "orders", "matches_by_order", "totals_by_order", "precisions", "brevity_penalty"):
                    assert (k in details) == (k in want.details) or k in ("overlap", "lcs")
                    if k in details and k in want.details:
                        assert details[k] == pytest.approx(want.details[k])


NUMBERS = ["1", "1.0", "25%", "0.25", "1,000", "1000.001", "n/a", "true", "-3", "+3", ".5", "5e-1", "12,34", "", " 7 ", "1e3", "\t5\n", "5 %", "٣", "0.10000005", "0.1", "1.", "+.5", ".", "-", "1,234.5", "123456789012", "1e-19", "é1", "1e999999999999999999999"]


@pytest.mark.parametrize("metric", [
    m.NumericEquivalence(Decimal("0.001"), Decimal("0.0001"), True, True), m.NumericEquivalence(), m.NumericEquivalence(Decimal(0), Decimal("0.000001"), True), m.NumericEquivalence(Decimal("1e-19"), allow_commas=True),
])
def test_numeric_columns_equal_python(spark, metric):
    pairs = [(a, b) for a in NUMBERS for b in NUMBERS] + [(1, "1"), (2.5, 2.5), (True, "1"), (None, 0), (1e300, "1e300"), (10**30, str(10**30)), (0.1, "0.1"), ([1], {"a": 1})]
    cases = from_records(spark, [{"id": str(i), "reference": a, "prediction": b} for i, (a, b) in enumerate(pairs)])
    for native in (True, False):
        got = {int(r.case_id): r.raw for r in score(cases, metric, native).collect()}
        for i, (a, b) in enumerate(pairs):
            want = metric.evaluate(a, b)
            assert (got[i].score, got[i].reason) == (want.score, want.reason), (native, a, b)
            assert {k: Decimal(v) for k, v in json.loads(got[i].details).items()} == {k: Decimal(v) for k, v in want.details.items()}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.decimals(-10**6, 10**6, places=4), st.decimals(-1, 1, places=7)), min_size=1, max_size=20), st.integers(0, 9), st.integers(0, 9))
def test_native_tolerance_is_exact(spark, pairs, a, r):
    metric = m.NumericEquivalence(Decimal(a).scaleb(-4), Decimal(r).scaleb(-6))
    rows = [(f"{x:f}", f"{x + d:f}") for x, d in pairs]
    cases = from_records(spark, [{"id": str(i), "reference": x, "prediction": y} for i, (x, y) in enumerate(rows)])
    got = {int(q.case_id): q.raw.score for q in score(cases, metric, True).collect()}
    assert got == {i: metric.evaluate(x, y).score for i, (x, y) in enumerate(rows)}


def test_long_texts_are_quick(spark):
    a, b = (" ".join(f"w{(i * k) % 997}" for i in range(4000)) for k in (3, 7))
    cases = from_records(spark, [{"id": "x", "reference": a, "prediction": b}])
    began = time.perf_counter()
    got = score(cases, m.RougeL(), True).select("raw.score").first()[0]
    assert got == m.RougeL().evaluate(a, b).score and time.perf_counter() - began < 20


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_lcs_and_edit_distance(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    edit = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
            edit[i][j] = min(edit[i - 1][j] + 1, edit[i][j - 1] + 1, edit[i - 1][j - 1] + (x != y))
    assert m.lcs_length(a, b) == table[-1][-1]
    assert m.edit_distance("".join(a), "".join(b)) == edit[-1][-1]


FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def _native(spark, normalizer, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", normalizer.column(F.col("t")).alias("t"))
    return [r.t for r in rows.orderBy("i").collect()]


@pytest.mark.parametrize("form", FORMS)
def test_native_normalizer_over_all_code_points(spark, form):
    """Every code point between letters, alone in its text, and in texts of 500 that mostly go to Python."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not 0x40000 <= c < 0xE0000 and c < 0xE1000]
    some = TextNormalizer(unicode_form=form, lowercase=True, strip_punctuation=True)
    texts = [f"aΣ{x}B {x}" for x in points]
    assert _native(spark, some, texts) == [some(t) for t in texts]
    for n in (TextNormalizer(unicode_form=form), TextNormalizer(unicode_form=form, lowercase=True, collapse_whitespace=False)):
        texts = [f"{x}b" for x in points[:: 1 if form == "NFC" else 7]] + ["".join(points[k : k + 500]) for k in range(0, len(points), 500)]
        assert _native(spark, n, texts) == [n(t) for t in texts]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.text(alphabet="aσςΣßẞﬁŉİıʼné\u0301\u0323\u1100\u1161\u11a8ǅſK _-\u2028\x1c", max_size=12)), min_size=1, max_size=30), st.sampled_from(FORMS), st.booleans(), st.booleans(), st.booleans())
def test_native_normalizer_equals_python(spark, texts, form, lower, collapse, strip):
    n = TextNormalizer(form, lower, collapse, strip)
    assert _native(spark, n, texts) == [n(t) for t in texts]


def test_plain_texts_stay_in_the_jvm(spark):
    """Ordinary text of several scripts is plain; marks, ligatures and young letters are not."""
    texts = ["plain", "Straße, été «x» – “y”", "ΟΔΟΣ ὁδ".split()[0], "Привет", "日本語のテキスト", "한국어", "e\u0301", "ﬁne", "ŉ", "\U0001f600", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", TextNormalizer(lowercase=True).plain(F.col("t")).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == [True] * 6 + [False] * 4 + [None]


def test_metrics_inherit_the_normalizer(spark):
    pairs = [("ﬁne", "fine"), ("ΟΔΟΣ", "οδοσ"), ("ŉ", "ʼn"), ("é", "e\u0301"), ("ΟΔΟΣ ﬁn", "οδος fin x"), ("", "é")]
    cases = from_records(spark, [{"id": str(i), "reference": a, "prediction": b} for i, (a, b) in enumerate(pairs)])
    lower = TextNormalizer(lowercase=True)
    for metric in (m.ExactMatch(lower), m.TokenF1(), m.CharacterF1(), m.RougeL(), m.SentenceBleu(), m.LevenshteinSimilarity(lower), m.ExactMatch(TextNormalizer("NFKD"))):
        got = {int(r.case_id): r.raw.score for r in score(cases, metric, True).collect()}
        assert got == {i: pytest.approx(metric.evaluate(a, b).score, abs=1e-12) for i, (a, b) in enumerate(pairs)}


def test_long_bags_and_distances_are_quick(spark):
    a, b = (" ".join(f"w{(i * k) % 9973}" for i in range(50_000)) for k in (3, 7))
    cases = from_records(spark, [{"id": "x", "reference": a, "prediction": b}])
    score(cases, m.TokenF1(), True).select("raw.score").first()
    began = time.perf_counter()
    assert score(cases, m.TokenF1(), True).select("raw.score").first()[0] == pytest.approx(m.TokenF1().evaluate(a, b).score)
    assert time.perf_counter() - began < 10
    began = time.perf_counter()
    assert m.edit_distance(a[:20_000], b[:20_000]) > 0 and time.perf_counter() - began < 5


def test_native_normalizer(spark):
    texts = [" A  b c\x1c", "don't — stop_1", "ÉTÉ straße", "áb", ""]
    for n in (TextNormalizer(), TextNormalizer(lowercase=True), TextNormalizer(lowercase=True, strip_punctuation=True), TextNormalizer(collapse_whitespace=False)):
        got = [r[0] for r in spark.createDataFrame([(t,) for t in texts if "́" not in t], "t string").select(n.column(F.col("t"))).collect()]
        assert got == [n(t) for t in texts if "́" not in t]
