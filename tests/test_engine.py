"""Suites, audits, statistics, comparisons, files, reports, registry and the command line."""

from __future__ import annotations

import hashlib
import json
import math
import os
import random
import sys
from fractions import Fraction

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from scorelake import cli
from scorelake import registry as reg
from scorelake.functions import metrics as m
from scorelake.model import BootstrapConfig, CaseFormatError, Contract, MetricPluginError, MetricValue, UndefinedPolicy
from scorelake.operators import audit, compare, stats, suite
from scorelake.sinks import report
from scorelake.sources import cases as src

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file


class Constant:
    name = "constant"

    def __init__(self, score):
        self.score = score

    def evaluate(self, reference, prediction):
        return MetricValue(self.score) if self.score is not None else MetricValue(None, "none")


class Counting:
    name = "counting"

    def __init__(self):
        self.n = 0

    def evaluate(self, reference, prediction):
        self.n += 1
        return MetricValue(1.0 if self.n % 2 else 0.5)


class Ordered:
    name = "ordered"

    def evaluate(self, reference, prediction):
        return MetricValue(1.0 if reference <= prediction else 0.0)


def build(spark, pairs, tags=None):
    return src.from_records(spark, [{"id": f"c{i}", "reference": a, "prediction": b, "tags": (tags or {}).get(i, [])} for i, (a, b) in enumerate(pairs)])


def results(spark, scores):
    return spark.createDataFrame([(i, f"c{i}", s) for i, s in enumerate(scores)], "ordinal bigint, case_id string, resolved_score double")


def test_policies(spark):
    df = build(spark, [("1", "1"), ("x", "1"), ("2", "y")])
    for policy, want in (("skip", [1.0, None, None]), ("zero", [1.0, 0.0, 0.0]), ("one", [1.0, 1.0, 1.0])):
        rows = suite.evaluate(df, m.NumericEquivalence(), UndefinedPolicy(policy)).orderBy("ordinal").collect()
        assert [r.resolved_score for r in rows] == want and [r.skipped for r in rows] == [policy == "skip" and w is None for w in want]
    with pytest.raises(ValueError, match="c1"):
        suite.evaluate(df, m.NumericEquivalence())
    with pytest.raises(TypeError):
        suite.evaluate(build(spark, [(1, "a")]), m.TokenF1(), UndefinedPolicy.SKIP)
    with pytest.raises(TypeError):
        suite.evaluate(build(spark, [(1, "a")]), m.TokenF1(), UndefinedPolicy.SKIP, native=True)
    s = suite.summary(suite.evaluate(df, m.NumericEquivalence(), UndefinedPolicy.SKIP)).first()
    assert (s.case_count, s.scored_count, s.skipped_count, s.mean_score) == (3, 1, 2, 1.0)
    with pytest.raises(ValueError, match="duplicate"):
        suite.evaluate(df.union(df), m.ExactMatch())


def test_exact_mean_does_not_depend_on_partitions(spark):
    values = np.random.default_rng(1).normal(0, 1e8, 5000).tolist() + [1e-9, -1e17, 1e17]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    assert {suite.exact_mean(df.repartition(k), "x") for k in (1, 3, 8)} == {float(sum(map(Fraction, values))) / len(values)}
    assert suite.exact_mean(df.limit(0), "x") is None


def test_summary_means_are_exact(spark):
    values = [1e17, 1.0, -1e17, 5e-324, 0.1, None]
    df = spark.createDataFrame([(i, f"c{i}", v, v is None, ["t", "u"][: 1 + i % 2]) for i, v in enumerate(values)], "ordinal bigint, case_id string, resolved_score double, skipped boolean, tags array<string>").repartition(3)
    mean = lambda xs: float(sum(map(Fraction, xs))) / len(xs)
    assert suite.summary(df).first().mean_score == mean(values[:5])
    assert [r.mean_score for r in suite.summarize_by_tag(df).collect()] == [mean(values[:5]), mean([1.0, 5e-324])]
    assert suite.exact_mean(spark.createDataFrame([(math.inf,), (1.0,)], "x double"), "x") is None
    one = suite.exact_sums(df, ["resolved_score", "ordinal"], ["skipped"]).orderBy("skipped").collect()
    assert [(r.n_resolved_score, r.mean_ordinal) for r in one] == [(5, 2.0), (0, 5.0)] and one[1].mean_resolved_score is None


def test_resampling_refuses_non_finite_scores(spark):
    for bad in (math.nan, math.inf):
        with pytest.raises(ValueError, match="finite"):
            stats.confidence_interval(results(spark, [0.5, bad]))


def test_tags(spark):
    df = build(spark, [("a", "a"), ("a", "b")], {0: ["short", "english"], 1: ["english"]})
    got = [tuple(r) for r in suite.summarize_by_tag(suite.evaluate(df, m.ExactMatch())).collect()]
    assert got == [("english", 2, 2, 0.5), ("short", 1, 1, 1.0)]
    with pytest.raises(ValueError):
        suite.summarize_by_tag(suite.evaluate(df, m.ExactMatch()), df.limit(1))


def rules(df, metric, contract=Contract(), **k):
    return [(r.rule, r.case_id) for r in audit.ordered(audit.audit(df, metric, contract, **k)).collect()]


def test_audits(spark):
    df = build(spark, [("a", "b"), ("b", "a"), ("a", "a")]).coalesce(1)
    assert rules(df, Constant(2.0)) == [("bounded", "c0"), ("bounded", "c1"), ("bounded", "c2"), ("identity", "c0:reference"), ("identity", "c0:prediction")]
    assert ("deterministic", "c0") in rules(df, Counting(), Contract(identity_score=None))
    assert rules(df, Ordered(), Contract(symmetric=True)) == [("symmetric", "c0"), ("symmetric", "c1")]
    assert rules(df, m.TokenF1()) == [] == rules(df, m.TokenF1(), native=True)
    empty = rules(df.limit(0), m.TokenF1())
    assert empty == [("coverage", None)]
    assert audit.passed(audit.audit(df.limit(0), m.TokenF1())) and not audit.passed(audit.audit(df, Constant(2.0)))
    mixed = src.from_records(spark, [{"id": "x", "reference": 1, "prediction": 1.0}, {"id": "y", "reference": True, "prediction": "1"}])
    assert {r.label for r in audit.distinct_payloads(mixed).collect()} == {"x:reference", "x:prediction", "y:reference", "y:prediction"}
    for bad in ({"minimum": 2}, {"identity_score": 3}, {"tolerance": -1}, {"maximum": math.inf}):
        with pytest.raises(ValueError):
            Contract(**bad)
    with pytest.raises(TypeError):
        Contract(minimum=True)


def digest(domain, *parts):
    return hashlib.sha256("\0".join([domain, *map(str, parts)]).encode()).digest()


def test_resampling_follows_the_formula(spark):
    xs = [0.1, 0.7, -0.2, 0.4, 0.0]
    c = BootstrapConfig(samples=60, confidence=0.9, seed=-3)
    rows = results(spark, xs).repartition(3)
    v = stats.vector(rows, "resolved_score", "ordinal")
    want, flips = [], []
    for r in range(60):
        a = b = 0.0
        for p in range(5):
            a += xs[int.from_bytes(digest(c.bootstrap_domain, -3, r, p)[:8], "big") % 5]
            b += xs[p] if digest(c.sign_domain, -3, r, p)[0] & 1 else -xs[p]
        want.append(a / 5)
        flips.append(b / 5)
    assert [r.value for r in stats.bootstrap_replicates(v, c).orderBy("r").collect()] == want
    assert [r.value for r in stats.sign_replicates(v, c).orderBy("r").collect()] == flips
    got = stats.confidence_interval(rows, config=c)
    assert (got["lower"], got["upper"]) == pytest.approx(tuple(np.quantile(want, [0.05, 0.95])))
    assert got["point"] == math.fsum(xs) / 5
    same = stats.confidence_interval(results(spark, [0.5] * 4), config=c)
    assert same["lower"] == same["upper"] == same["point"] == 0.5
    with pytest.raises(ValueError):
        stats.confidence_interval(results(spark, [None]), config=c)
    for bad in ({"samples": 0}, {"confidence": 1.0}):
        with pytest.raises(ValueError):
            BootstrapConfig(**bad)


@pytest.mark.parametrize("block", [1, 7, 64, 5000])
def test_blocks_give_the_doubles_of_the_array(spark, block):
    """Values of very different sizes, so that every other order of a sum gives another double."""
    some = random.Random(block)
    values = [some.choice([1e16, -1e16, 1.0, 0.1, -0.3, 1e-9, 0.0, -0.0]) * some.random() for _ in range(211)]
    rows = spark.createDataFrame([(i // 2, x if i % 17 else None) for i, x in enumerate(values)], "ordinal bigint, score double").repartition(5)
    c = BootstrapConfig(samples=23, seed=5)
    array, blocked = stats.vector(rows, "score", "ordinal"), stats.vector(rows, "score", "ordinal", 10, block)
    assert array.columns == ["xs"] and blocked.columns == ["block", "xs", "n"]
    assert [x for r in blocked.orderBy("block").collect() for x in r.xs] == array.first().xs
    for replicates in (stats.bootstrap_replicates, stats.sign_replicates):
        one, other = ([(r.r, r.value.hex()) for r in replicates(v, c).orderBy("r").collect()] for v in (array, blocked))
        assert one == other


def test_tasks_follow_values_not_blocks(spark, monkeypatch):
    rows = spark.range(1500).selectExpr("id AS ordinal", "rand(3) AS score")
    c = BootstrapConfig(samples=20, seed=5)
    spark.sparkContext.setJobGroup("blocks", "blocks")
    replicates = stats.bootstrap_replicates(stats.vector(rows, "score", "ordinal", 0, 2), c)
    got = replicates.collect()
    assert "Broadcast" not in replicates._jdf.queryExecution().executedPlan().toString()  # the draws stay on the executors
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("blocks") for s in status.getJobInfo(j).stageIds]
    spark.sparkContext.setJobGroup("", "")
    assert len(got) == 20 and max(s.numTasks for s in stages if s) <= 4 * spark.sparkContext.defaultParallelism
    # runs and parts of a few values go on from one another
    monkeypatch.setattr(stats, "RUN_ROWS", 100)
    monkeypatch.setattr(stats, "TASK_ROWS", 100)
    again = stats.bootstrap_replicates(stats.vector(rows, "score", "ordinal", 0, 2), c).collect()
    whole = stats.bootstrap_replicates(stats.vector(rows, "score", "ordinal"), c).collect()
    assert sorted((r.r, r.value.hex()) for r in got) == sorted((r.r, r.value.hex()) for r in again) == sorted((r.r, r.value.hex()) for r in whole)


def test_comparison_beyond_the_array(spark, monkeypatch):
    rows = [({"id": f"c{i}", "reference": "a b c", "prediction": "a b"}, {"id": f"c{i}", "reference": "a b c", "prediction": "a b c" if i % 3 else "x"}) for i in range(40)]
    left, right = (src.from_records(spark, [r[k] for r in rows]) for k in (0, 1))
    config = BootstrapConfig(samples=50, seed=2)
    whole = compare.compare_cases(left, right, m.TokenF1(), config=config)
    plain = compare.vector
    monkeypatch.setattr(compare, "vector", lambda *x: plain(*x, 8, 16))
    assert compare.compare_cases(left, right, m.TokenF1(), config=config) == whole


def test_paired_comparison(spark):
    c = BootstrapConfig(samples=200)
    left, right = results(spark, [0.0, 0.5, 1.0, None]), results(spark, [0.5, 0.5, 1.0, None])
    got = compare.compare_results(left, right.orderBy("case_id", ascending=False), metric="x", config=c)
    assert got.point == pytest.approx(1 / 6) and (got.compared, got.omitted) == (3, 1) and got.passed_gate
    assert compare.compare_results(left, left, metric="x", config=c).p_value == 1.0
    lower = compare.compare_results(left, right, metric="x", config=c, direction="lower")
    assert lower.improvement == {"point": -got.point, "lower": -got.upper, "upper": -got.lower} and not lower.passed_gate
    assert 0 < compare.compare_results(results(spark, [0.0] * 8), results(spark, [1.0] * 8), metric="x", config=c).p_value < 0.05
    assert not compare.compare_results(left, right, metric="x", config=c, minimum_lower_bound=0.5).passed_gate
    for a, b, k in ((left, right.limit(2), {}), (left, results(spark, [0.0, None, 1.0, None]), {}), (left.union(left), right, {}), (left, right, {"candidate_metric": "y"}), (left, right, {"direction": "up"}), (results(spark, [None]), results(spark, [None]), {})):
        with pytest.raises(ValueError):
            compare.compare_results(a, b, metric="x", config=c, **k)


def test_alignment(spark):
    a = build(spark, [("1", "x"), ("2", "y")], {0: ["p", "q"]})
    compare.require_aligned(a, build(spark, [("1", "z"), ("2", "w")], {0: ["q", "p"]}))
    for pairs, tags in (([("1", "z")], {0: ["p", "q"]}), ([("9", "z"), ("2", "w")], {0: ["p", "q"]}), ([("1", "z"), ("2", "w")], {}), ([(1, "z"), ("2", "w")], {0: ["p", "q"]})):
        with pytest.raises(ValueError):
            compare.require_aligned(a, build(spark, pairs, tags))
    one = lambda v: src.from_records(spark, [{"id": "a", "reference": v, "prediction": ""}])
    compare.require_aligned(one({"a": 1, "b": [2]}), one({"b": [2], "a": 1}))
    for x, y in ((True, 1), (1, 1.0), ([1, 2], [2, 1])):
        with pytest.raises(ValueError, match="reference"):
            compare.require_aligned(one(x), one(y))


@pytest.mark.parametrize("text", ["{}", "[1]", '[{"id": "a"}]', '[{"id": 1, "reference": 1, "prediction": 1}]', '[{"id": "a", "reference": 1, "prediction": 1, "tags": "t"}]', '[{"id": "a", "reference": 1, "prediction": 1, "metadata": 1}]',
    '[{"id": "a", "reference": 1, "prediction": 1, "x": 1}]', "[{", '[{"id": "a", "id": "b", "reference": 1, "prediction": 1}]', '[{"id": "a", "reference": NaN, "prediction": 1}]', '[{"id": " ", "reference": 1, "prediction": 1}]',
    '[{"id": "a", "reference": 1, "prediction": 1, "tags": ["t", "t"]}]'])
def test_bad_case_files(spark, tmp_path, text):
    path = tmp_path / "c.json"
    path.write_text(text)
    with pytest.raises(CaseFormatError):
        src.load_cases(spark, path)


def test_case_files(spark, tmp_path):
    path = tmp_path / "c.JSONL"
    path.write_text('{"id": "a", "reference": "é", "prediction": 1, "tags": ["t"], "metadata": {"k": 1}}\n\n  {"id": "b", "reference": null, "prediction": {"z": 1, "a": [1.0]}}\n', encoding="utf-8")
    rows = src.load_cases(spark, path).orderBy("ordinal").collect()
    assert [(r.ordinal, r.case_id, r.reference.kind, r.prediction.kind, r.tags) for r in rows] == [(1, "a", "str", "int", ["t"]), (2, "b", "null", "object", [])]
    assert rows[1].prediction.text == '{"z": 1, "a": [1.0]}' and rows[1].prediction.canon == '{"a": [1.0], "z": 1}'
    (tmp_path / "bad.jsonl").write_bytes(b'\xff{"id"}')
    for name in ("bad.jsonl", "none.jsonl"):
        with pytest.raises(CaseFormatError):
            src.load_cases(spark, tmp_path / name)
    (tmp_path / "line.jsonl").write_text('{"id": "a", "reference": 1, "prediction": 1}\n{"id"')
    with pytest.raises(CaseFormatError, match="line 2"):
        src.load_cases(spark, tmp_path / "line.jsonl")


def _whole(path):
    """The cases of a file, or its first error, from one parse of the whole text; rows (position, id, text of the reference)."""
    try:
        text = path.read_bytes().decode("utf-8")
    except UnicodeDecodeError:
        return "UTF-8"
    lines = [(i, x) for i, x in enumerate(text.splitlines(), 1) if x.strip()] if path.suffix == ".jsonl" else [(None, text)]
    values = []
    for line, x in lines:
        try:
            values.append(src.strict_json(x))
        except json.JSONDecodeError as e:
            return f"line {line or e.lineno}, column {e.colno}"
        except CaseFormatError as e:
            return str(e)
    if path.suffix != ".jsonl":
        if not isinstance(values[0], list):
            return "must hold an array"
        values = values[0]
    try:
        return [(c["ordinal"], c["case_id"], c["reference"]["text"]) for c in [src.case_of(v, i) for i, v in enumerate(values, 1)]]
    except CaseFormatError as e:
        return str(e)


def _split(spark, path):
    try:
        return [(r.ordinal, r.case_id, r.reference.text) for r in src.load_cases(spark, path).orderBy("ordinal").collect()]
    except CaseFormatError as e:
        return str(e)


@pytest.fixture
def small_splits(spark, monkeypatch):
    monkeypatch.setattr(src.files, "BLOCK_BYTES", 40)
    plain = src.files.load_array
    monkeypatch.setattr(src.files, "load_array", lambda *x: plain(*x, 40))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150b")
    spark.conf.set("spark.sql.files.openCostInBytes", "8")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _case(i, text="x"):
    return json.dumps({"id": f"c{i}", "reference": text, "prediction": {"k": [1, {"z": "}]\\\""}]}}, ensure_ascii=bool(i % 2))


GOOD = [_case(i, t) for i, t in enumerate(["é", "a]b", '"', "\\", "}{", ",,[", "\U0001f600 ü", "y" * 400, "", "z"] * 2)]


@pytest.mark.parametrize("text", [
    "\n".join(GOOD), "\r\n".join(GOOD) + "\r\n", "\n\n \n" + "\n\x0c\n".join(GOOD) + "\n\n", "\x1e".join(GOOD), "\n".join([*GOOD[:12], "{", *GOOD, "["]), "\n".join([*GOOD, '{"id": 1}', "  {]"]),
    "\n".join([*GOOD, '{"id": 1, "reference": 2, "prediction": 3}', *GOOD]), "\n".join([*GOOD, '{"id": "a", "id": "b"}']), "\ufeff" + "\n".join(GOOD), "", "\n", "\n".join(GOOD).encode() + b"\n\xff\n{", "\n".join([*GOOD, "a\u2028"]),
])
def test_split_lines_are_the_whole_file(spark, tmp_path, small_splits, text):
    path = tmp_path / "c.jsonl"
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    want, got = _whole(path), _split(spark, path)
    if text and text[0] == "\ufeff":
        want = "line 1, column 1"
    assert got == want if isinstance(want, list) else want in got


@pytest.mark.parametrize("text", [
    "[" + ",".join(GOOD) + "]", " \n[\n" + " ,\n ".join(GOOD) + "\n]\n\n", "[]", "[ \n ]", "[" + GOOD[7] + "]", "[" + ",".join(GOOD) + ",]", "[" + ",".join(GOOD) + " , \n ]", "[," + GOOD[0] + "]", "[" + ",\n".join([*GOOD, "", *GOOD]) + "]",
    "[" + ",\n".join(GOOD), "[" + ",\n".join(GOOD) + ",", "[", "[" + ",\n".join(GOOD) + "] x", "[" + ",\n".join(GOOD) + "]\n\n []", "[" + ",\n".join([*GOOD, '{"id": }', *GOOD]) + "]", "[" + ",\n".join([*GOOD, '{"id": "a" "b"}', *GOOD]) + "]",
    "[" + ",\n".join([*GOOD, "1 2", *GOOD]) + "]", "[" + ",\n".join([*GOOD, '{"id": "a"]', *GOOD]) + "]", "[" + ",\n".join(GOOD) + "}", "[" + ",\n".join([*GOOD, '"open', *GOOD]) + "]", "[" + ",\n".join([*GOOD, '{"id": "a", "id": "b"}']) + "]",
    "[" + ",\n".join([*GOOD, '{"id": 3}', *GOOD]) + "]", "[1" + ",2" * 200 + "]", '{"id": "a"}', "{", "", " ", "\ufeff[]", ("[" + ",".join(GOOD)).encode() + b"\xff]", "[" + ",\n".join([*GOOD, "NaN", *GOOD]) + "]", "[" + ",\n".join([*GOOD, "\x01", *GOOD]) + "]", "[" + ",\n".join([*GOOD, "[[1, 2], {}]", "3"]) + "]",
])
def test_split_arrays_are_the_whole_file(spark, tmp_path, small_splits, text):
    path = tmp_path / "c.json"
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    want, got = _whole(path), _split(spark, path)
    if text and text[0] == "\ufeff":
        want = "line 1, column 1"
    assert got == want if isinstance(want, list) else want in got


def test_numbers_beyond_a_double(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('[{"id": "a", "reference": 1e999, "prediction": -1e999}]')
    row = src.load_cases(spark, path).first()
    assert (src.value_of(row.reference), src.value_of(row.prediction)) == (math.inf, -math.inf)


def test_table_cases_are_checked(spark):
    def made(*rows):
        df = spark.createDataFrame(rows, "n bigint, id string, tags array<string>")
        return src.from_dataframe(df, case_id="id", reference="id", prediction="id", ordinal="n", tags="tags")

    assert [r.tags for r in made((2, "b", None), (1, "a", ["x", "y"])).orderBy("ordinal").collect()] == [["x", "y"], []]
    good = (1, "a", ["x"])
    for row, said in (((7, None, []), "case 7: id must be a string"), ((6, " \u2003", []), "case 6: id must not be blank"), ((5, "b", ["x", "x"]), "case 5: tags must be unique"), ((4, "c", [None]), "case 4: tags must be a list"), ((None, "d", []), "ordinal")):
        with pytest.raises(CaseFormatError, match=said):
            made(good, row, (9, "", []))


def test_canonical_columns(spark):
    """Table columns have the canonical text of the same JSON value in a file, but for spellings of fractions."""
    kind = "i int, m map<string,struct<z:array<int>,a:double>>, s struct<b:string,a:map<int,boolean>>, t string, l array<string>"
    rows = [(1, {"y": ([1, None], 1.0), "x\n\x01é\"\\": (None, 2.5)}, ("q", {10: True, 9: None}), "\t", [])]
    df = spark.createDataFrame(rows, kind)
    got = df.select(*(src.payload_column(df, c)["canon"].alias(c) for c in df.columns)).first()
    want = {"i": 1, "m": {"y": {"z": [1, None], "a": 1.0}, "x\n\x01é\"\\": {"z": None, "a": 2.5}}, "s": {"b": "q", "a": {"10": True, "9": None}}, "l": []}
    for c, x in want.items():
        assert got[c] == src.payload(x)["canon"]
    assert got["t"] == "\t"


def test_json_lines_of_a_table(spark):
    lines = [(3, '{"id": "b", "reference": 1, "prediction": true}'), (1, '{"id": "a", "reference": "x", "prediction": {"k": null}, "tags": ["t"]}'), (2, "  "), (4, None)]
    df = spark.createDataFrame(lines, "n bigint, line string")
    rows = src.from_json_lines(df, text="line", ordinal="n").orderBy("ordinal").collect()
    assert [(r.ordinal, r.case_id, r.prediction.kind, r.tags) for r in rows] == [(1, "a", "object", ["t"]), (3, "b", "bool", [])]
    bad = df.union(spark.createDataFrame([(9, "{"), (7, '{"id": "c", "id": "d"}')], df.schema))
    with pytest.raises(CaseFormatError, match="line 7"):
        src.from_json_lines(bad, text="line", ordinal="n")
    assert src.from_json_lines(df.limit(0), text="line", ordinal="n").count() == 0


def test_errors_name_every_id(spark):
    a = build(spark, [("1", "x")] * 150)
    with pytest.raises(ValueError) as caught:
        compare.require_aligned(a, a.where("ordinal <= 20"))
    assert str(caught.value).count(",") == 129
    with pytest.raises(ValueError) as caught:
        src.require_unique_ids(a.union(a))
    assert str(caught.value).count(",") == 149


class Entry:
    def __init__(self, name, loaded, value="v"):
        self.name, self.loaded, self.value, self.loads = name, loaded, value, 0

    def load(self):
        self.loads += 1
        if isinstance(self.loaded, Exception):
            raise self.loaded
        return self.loaded


def test_registry(monkeypatch):
    r = reg.MetricRegistry.with_builtins()
    assert r.names == m.BUILTIN_METRICS
    r.register("constant", lambda o: Constant(1.0))
    assert r.build({"kind": "constant"}).score == 1.0
    for name, factory, error in (("constant", lambda o: None, ValueError), ("Bad", lambda o: None, ValueError), (3, lambda o: None, TypeError), ("ok", 3, TypeError)):
        with pytest.raises(error):
            r.register(name, factory)
    for factory in (lambda o: 3, lambda o: Constant(1.0), lambda o: 1 / 0):
        r.register("other", factory, replace=True)
        with pytest.raises(MetricPluginError):
            r.build("other")

    def plugins(*entries):
        monkeypatch.setattr(reg.metadata, "entry_points", lambda group: list(entries))
        return entries

    good, broken = plugins(Entry("zeta", lambda o: Constant(0.0)), Entry("alpha", RuntimeError("no")))
    before = r.names
    with pytest.raises(MetricPluginError):
        r.load_plugins()
    assert r.names == before
    for bad in ("Nope", "rouge_l"):
        (entry,) = plugins(Entry(bad, lambda o: None))
        with pytest.raises(MetricPluginError):
            r.load_plugins()
        assert entry.loads == 0
    plugins(Entry("zeta", lambda o: Constant(0.0)), Entry("eta", lambda o: Constant(0.0)))
    assert r.load_plugins() == ("eta", "zeta") and "eta" in r.names


def test_reports(spark):
    df = build(spark, [("1", "1"), ("a|b", "`<x>`\n")])
    res = suite.evaluate(df, m.NumericEquivalence(), UndefinedPolicy.SKIP)
    made = report.Report("numeric_equivalence", res, audit.audit(df, m.NumericEquivalence()))
    whole = json.loads(report.render_json(made))
    assert whole["schema_version"] == 1 and whole["summary"] == {"case_count": 2, "scored_count": 1, "skipped_count": 1, "mean_score": 1.0, "passed_contracts": False}
    assert [r["undefined_reason"] for r in whole["results"]] == [None, "unparseable reference and prediction"]
    assert {f["rule"] for f in whole["findings"]} == {"identity"}
    text = report.render_markdown(made)
    assert "| `c1` | undefined | — | skipped |" in text and "**FAIL**" in text
    assert report.escape("a|`<&>\r\n\r\n") == "a&#124;&#96;&lt;&amp;&gt;<br><br>"


@pytest.mark.parametrize("n", [0, 1, 7])
def test_written_reports_are_the_rendered_ones(spark, tmp_path, n):
    df = build(spark, [("1", "1") if i % 2 else (f"a|{i}", "`é`\n") for i in range(n)]) if n else build(spark, [("1", "1")]).limit(0)
    res = suite.evaluate(df.repartition(3), m.NumericEquivalence(), UndefinedPolicy.SKIP)
    for findings in (None, audit.audit(df, m.NumericEquivalence())):
        made = report.Report("numeric|x", res, findings)
        for write, render in ((report.write_json, report.render_json), (report.write_markdown, report.render_markdown)):
            path = tmp_path / f"report-{findings is None}"
            write(made, path)
            assert path.read_text(encoding="utf-8") == render(made)
            write(made, path)  # over the old one
    assert sorted(p.name for p in tmp_path.iterdir()) == ["report-False", "report-True"]


@pytest.mark.parametrize("size", ["61b", "500b", "64m"])
def test_results_are_read_in_byte_ranges(spark, tmp_path, size):
    df = build(spark, [("1", str(i % 3)) if i % 2 else (f"a|{i}", "`é`\n    }\n") for i in range(40)])
    res = suite.evaluate(df.repartition(3), m.NumericEquivalence(), UndefinedPolicy.SKIP).withColumn("case_id", F.concat("case_id", F.lit('"}\n    },\n    {\n      "raw_score": 7')))
    for findings in (None, audit.audit(df, m.NumericEquivalence())):
        made = report.Report("numeric", res, findings)
        path = report.write_json(made, tmp_path / f"report-{findings is None}")
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            read = report.read_results(spark, path)
            assert (read.rdd.getNumPartitions() > 1) == (size != "64m")
            found = sorted((r.asDict() for r in read.collect()), key=lambda r: r["case_id"])
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        whole = [{k: r[k] for k in read.columns} for r in report.report_to_dict(made)["results"]]
        assert found == sorted(whole, key=lambda r: r["case_id"]) and len(found) == 40
    report.write_json(report.Report("numeric", res.limit(0)), tmp_path / "none")
    assert report.read_results(spark, str(tmp_path / "none")).count() == 0


def run(capsys, *args):
    code = cli.main([str(a) for a in args])
    return code, capsys.readouterr()


def test_command_line(spark, tmp_path, capsys):
    base, cand = tmp_path / "b.jsonl", tmp_path / "c.jsonl"
    for path, preds in ((base, ("x", "b")), (cand, ("a", "b"))):
        path.write_text("".join(json.dumps({"id": str(i), "reference": r, "prediction": p}) + "\n" for i, (r, p) in enumerate(zip("ab", preds, strict=True))))
    code, out = run(capsys, "list")
    assert code == 0 and out.out.split() == list(m.BUILTIN_METRICS)
    code, out = run(capsys, "run", base, "--metric", "exact_match", "--audit", "--format", "json")
    assert code == 0 and json.loads(out.out)["summary"]["mean_score"] == 0.5
    config = tmp_path / "m.json"
    config.write_text('{"kind": "rouge_l", "beta": 2}')
    target = tmp_path / "out.md"
    assert run(capsys, "run", base, "--metric-config", config, "--output", target)[0] == 0 and "rouge_l" in target.read_text()
    args = ("compare", base, cand, "--metric", "exact_match", "--samples", 50)
    code, out = run(capsys, *args, "--format", "json")
    assert code == 0 and json.loads(out.out)["delta"]["point"] == 0.5
    assert run(capsys, *args, "--minimum-delta", 0.75)[0] == 2
    assert run(capsys, *args, "--direction", "lower")[0] == 2
    assert "95% paired-bootstrap" in run(capsys, *args)[1].out
    link = tmp_path / "link"
    os.link(base, link)
    for bad in (("run", base, "--metric", "exact_match", "--output", link), ("run", tmp_path / "no", "--metric", "exact_match"), ("run", base, "--metric", "nope"), ("compare", base, cand, "--metric", "exact_match", "--output", cand)):
        code, out = run(capsys, *bad)
        assert code == 2 and out.err.startswith("scorelake: error:")
    with pytest.raises(SystemExit):
        cli.main(["--version"])
