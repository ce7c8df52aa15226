"""Evaluation queries over the driver's tables; keys as in the survey, §7.5."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics as m
from ..functions.text import TextNormalizer
from ..model import BootstrapConfig, Contract, MetricValue, UndefinedPolicy
from ..operators import audit as audits
from ..operators import compare, stats, suite
from ..operators.shared import assembled, shared_folder
from ..registry import MetricRegistry
from ..sinks.report import Report, escape_column, listed, markdown_rows, read_results, write_json, write_markdown
from ..sources.cases import broken_rules, from_dataframe, from_json_lines, load_cases

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
NUMERIC = m.NumericEquivalence(Decimal("0.001"), Decimal(0), True, True)
CONFIG = BootstrapConfig(samples=200, confidence=0.95, seed=7)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns against the user turn before them."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(w)).withColumn("asked", F.lag("role").over(w))
    rows = rows.where("role = 'assistant' and asked = 'user'").withColumn("id", F.concat_ws(":", "conv_id", "turn")).withColumn("place", F.col("conv_id") * 1000 + F.col("turn"))
    return from_dataframe(rows, case_id="id", reference="before", prediction="text", ordinal="place")


def benchmark_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item against the next one."""
    a = _table(spark, sf_dir, "benchmark")
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next"))
    return from_dataframe(a.join(b, "item_id"), case_id="item_id", reference="text", prediction="next", ordinal="item_id")


def number_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values against six spellings of a number, some of them none."""
    e = _table(spark, sf_dir, "events").select("event_id", F.col("value").cast("decimal(20,4)").alias("v"))
    k = F.col("event_id") % 6
    spelt = (
        F.when(k == 0, F.col("v").cast("string")).when(k == 1, F.concat((F.col("v") * 100).cast("decimal(20,4)").cast("string"), F.lit("%")))
        .when(k == 2, F.concat(F.lit("1,"), F.lpad((F.floor("v") % 1000).cast("string"), 3, "0"))).when(k == 3, (F.col("v") + F.lit("0.001").cast("decimal(4,3)")).cast("decimal(20,4)").cast("string"))
        .when(k == 4, "n/a").otherwise("true")
    )
    return from_dataframe(e.select("event_id", F.col("v").cast("string").alias("v"), spelt.alias("p")), case_id="event_id", reference="v", prediction="p", ordinal="event_id")


def label_cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """'1' against a quality label, and against the absence of a toxic one; tags are language and source."""
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    rows = rows.select("doc_id", F.lit("1").alias("one"), F.col("quality").cast("string").alias("q"), (1 - F.col("toxic")).cast("string").alias("t"), F.array("lang", "source").alias("tags"))
    return tuple(from_dataframe(rows, case_id="doc_id", reference="one", prediction=p, ordinal="doc_id", tags="tags") for p in ("q", "t"))


def perturbed_label_cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Label cases, and the same with some dropped, re-referenced and re-tagged."""
    left, right = label_cases(spark, sf_dir)
    k = F.col("ordinal")
    other = F.struct(F.lit("str").alias("kind"), F.lit("2").alias("text"), F.lit("2").alias("canon"))
    right = right.where(k % 50 != 0).withColumn("reference", F.when(k % 70 == 0, other).otherwise(F.col("reference"))).withColumn("tags", F.when(k % 90 == 0, F.array(F.lit("x"))).otherwise(F.reverse("tags")))
    return left.where(k % 55 != 0), right


def _scores(cases: DataFrame, metric: m.Metric) -> DataFrame:
    return suite.score(cases, metric, native=True).select("case_id", F.round("raw.score", 9).alias("score"))


@query
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(label_cases(spark, sf_dir)[0], m.ExactMatch())


#: Spellings that case folding and composition undo: a ligature, the sharp s, and letters before combining marks.
RESPELT = {"fi": "\ufb01", "ss": "ß", "é": "e\u0301", "ü": "u\u0308", "e": "E"}


def respelt(text: Column) -> Column:
    for plain, other in RESPELT.items():
        text = F.replace(text, F.lit(plain), F.lit(other))
    return text


@query
def exact_match_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against their other spelling, every fifth with a word more."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(respelt(F.col("text")), F.when(F.col("doc_id") % 5 == 0, " x").otherwise("")).alias("other"))
    cases = from_dataframe(docs, case_id="doc_id", reference="text", prediction="other", ordinal="doc_id")
    return _scores(cases, m.ExactMatch(TextNormalizer(lowercase=True)))


@query
def token_f1_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose answers have the other spelling."""
    cases = conversation_cases(spark, sf_dir)
    return _scores(cases.withColumn("prediction", F.col("prediction").withField("text", respelt(F.col("prediction.text")))), m.TokenF1())


@query
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(conversation_cases(spark, sf_dir), m.TokenF1())


@query
def character_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(conversation_cases(spark, sf_dir), m.CharacterF1())


@query
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(benchmark_cases(spark, sf_dir), m.RougeL())


@query
def rouge_l_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(conversation_cases(spark, sf_dir), m.RougeL())


@query
def rouge_l_beta2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(benchmark_cases(spark, sf_dir), m.RougeL(beta=2.0))


@query
def sentence_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(benchmark_cases(spark, sf_dir), m.SentenceBleu())


@query
def sentence_bleu_unsmoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(benchmark_cases(spark, sf_dir), m.SentenceBleu(max_order=2, smooth=0.0, effective_order=False))


@query
def levenshtein_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(benchmark_cases(spark, sf_dir), m.LevenshteinSimilarity())


def _numeric(spark: SparkSession, sf_dir: str, policy: UndefinedPolicy) -> DataFrame:
    return suite.evaluate(number_cases(spark, sf_dir), NUMERIC, policy, native=True, check=False)


def _numeric_query(policy: UndefinedPolicy) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _numeric(spark, sf_dir, policy).select("case_id", F.col("raw.score").alias("score"), F.col("raw.reason").alias("reason"), "resolved_score", "skipped")

    QUERIES[f"numeric_equivalence_{policy}"] = run


for _policy in (UndefinedPolicy.SKIP, UndefinedPolicy.ZERO, UndefinedPolicy.ONE):
    _numeric_query(_policy)


@query
def numeric_equivalence_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    metric = m.NumericEquivalence(Decimal(0), Decimal("0.00001"), True, True)
    return suite.score(number_cases(spark, sf_dir), metric, native=True).select("case_id", F.col("raw.score").alias("score"), F.col("raw.reason").alias("reason"))


@query
def json_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases written as JSON records and read back by the strict parser."""
    rows = conversation_cases(spark, sf_dir).select("ordinal", F.to_json(F.struct(F.col("case_id").alias("id"), F.col("reference.text").alias("reference"), F.length("prediction.text").alias("prediction"), F.array("case_id").alias("tags"))).alias("line"))
    cases = from_json_lines(rows, text="line", ordinal="ordinal")
    return cases.select("ordinal", "case_id", F.col("reference.kind").alias("reference_kind"), F.col("reference.text").alias("reference"), F.col("prediction.kind").alias("prediction_kind"), F.col("prediction.text").alias("prediction"), F.get("tags", F.lit(0)).alias("tag"))


def _lines_of_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records of the conversation cases in order, with raw line separators inside the references as spaces."""
    plain = F.translate("reference.text", "\v\f\x1c\x1d\x1e\x85\u2028\u2029", "        ")
    record = F.struct(F.col("case_id").alias("id"), plain.alias("reference"), F.length("prediction.text").alias("prediction"))
    return conversation_cases(spark, sf_dir).select("ordinal", F.to_json(record).alias("line"))


def _shown(cases: DataFrame) -> DataFrame:
    return cases.select("ordinal", "case_id", F.col("reference.text").alias("reference"), F.col("prediction.kind").alias("prediction_kind"), F.col("prediction.text").alias("prediction"))


def _file(spark: SparkSession, suffix: str) -> str:
    return f"{shared_folder(spark)}/files/{uuid.uuid4().hex}{suffix}"


@query
def jsonl_file_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases written as one JSONL file and read back in byte ranges."""
    return _shown(load_cases(spark, assembled(_file(spark, ".jsonl"), [_lines_of_cases(spark, sf_dir)], spark)))


@query
def json_array_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases written as one JSON array and read back in byte ranges."""
    return _shown(load_cases(spark, assembled(_file(spark, ".json"), ["[", listed(_lines_of_cases(spark, sf_dir)), "]"], spark)))


@query
def suite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suite.summary(_numeric(spark, sf_dir, UndefinedPolicy.SKIP)).withColumn("mean_score", F.round("mean_score", 9))


@query
def tag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = suite.evaluate(label_cases(spark, sf_dir)[0], m.ExactMatch(), UndefinedPolicy.SKIP, native=True, check=False)
    return suite.summarize_by_tag(results).withColumn("mean_score", F.round("mean_score", 9))


@query
def tag_summary_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags from the cases, joined to results that have none."""
    cases = label_cases(spark, sf_dir)[0]
    results = suite.evaluate(cases, m.ExactMatch(), UndefinedPolicy.SKIP, native=True, check=False).drop("tags")
    return suite.summarize_by_tag(results, cases).withColumn("mean_score", F.round("mean_score", 9))


@query
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("n")).where("n > 1")


@query
def align_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.id_differences(*perturbed_label_cases(spark, sf_dir))


@query
def align_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.case_differences(*perturbed_label_cases(spark, sf_dir)).select("case_id", "differs")


@query
def map_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that are maps: the candidate has the same entries in another order, but every seventh has another value."""
    docs = _table(spark, sf_dir, "documents").withColumn("about", F.struct("source", F.array("n_chars", F.lit(None)).alias("sizes")))
    changed = F.when(F.col("doc_id") % 7 == 0, F.struct("source", F.array(F.col("n_chars"), F.lit(0).cast("bigint")).alias("sizes"))).otherwise(F.col("about"))
    left = docs.select("doc_id", "lang", F.create_map(F.lit("a\n"), "about", F.lit("b"), "about", F.col("lang"), "about").alias("r"))
    right = docs.select("doc_id", "lang", F.create_map("lang", changed, F.lit("b"), "about", F.lit("a\n"), "about").alias("r"))
    return compare.case_differences(*(from_dataframe(x, case_id="doc_id", reference="r", prediction="lang", ordinal="doc_id") for x in (left, right))).select("case_id", "differs")


@query
def table_case_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cases of which some have no id, a blank one, or tags that repeat or are null."""
    k = F.col("doc_id") % 11
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.when(k == 1, F.lit(None)).when(k == 2, "\u2003\t").otherwise(F.col("doc_id").cast("string")).alias("id"),
        F.when(k == 3, F.array("lang", "source", "lang")).when(k == 4, F.array("lang", F.lit(None))).when(k == 5, F.lit(None)).otherwise(F.array("lang", "source")).alias("tags"),
    )
    return broken_rules(from_dataframe(docs, case_id="id", reference="text", prediction="text", ordinal="doc_id", tags="tags", check=False))


@query
def paired_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = (suite.evaluate(c, m.ExactMatch(), UndefinedPolicy.SKIP, native=True, check=False) for c in label_cases(spark, sf_dir))
    return compare.paired(left, right).select("case_id", "left", "right", "delta")


@query
def one_sided_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compare.paired(_numeric(spark, sf_dir, UndefinedPolicy.SKIP), _numeric(spark, sf_dir, UndefinedPolicy.ZERO))
    return rows.agg(F.count_if("one_sided").alias("one_sided"), F.count_if("omitted").alias("omitted"), F.count("delta").alias("compared"))


@query
def omitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _numeric(spark, sf_dir, UndefinedPolicy.SKIP)
    return compare.paired(one, one.select("case_id", "resolved_score")).where("omitted").select("case_id")


def _findings(cases: DataFrame, metric: m.Metric, contract: Contract) -> DataFrame:
    return audits.audit(cases, metric, contract, native=True).select("rule", "severity", "case_id", F.transform("observed", lambda x: F.round(x, 9)).cast("array<string>").alias("o")).select("rule", "severity", "case_id", F.array_join("o", ",", "null").alias("observed"))


@query
def audit_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(benchmark_cases(spark, sf_dir), m.RougeL(beta=2.0), Contract(symmetric=True)).select("rule", "severity", "case_id")


@query
def audit_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(benchmark_cases(spark, sf_dir), m.CharacterF1(), Contract(maximum=0.8, identity_score=None)).select("rule", "severity", "case_id", F.col("observed").cast("double").alias("observed"))


class Alternating:
    """A metric with state: every second call gives one half."""

    name = "alternating"

    def __init__(self) -> None:
        self.calls = 0

    def evaluate(self, reference: Any, prediction: Any) -> MetricValue:
        self.calls += 1
        return MetricValue(1.0 if self.calls % 2 else 0.5)


@query
def audit_deterministic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case is evaluated twice within one call, so the metric's state shows."""
    found = audits.audit(benchmark_cases(spark, sf_dir), Alternating(), Contract(identity_score=None))
    return found.select("rule", "severity", "case_id", F.get("observed", F.lit(0)).alias("first"), F.get("observed", F.lit(1)).alias("again"))


@query
def audit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit of no cases: those whose reference is unlike itself."""
    none = benchmark_cases(spark, sf_dir).where("reference.text <> reference.text")
    return audits.audit(none, m.TokenF1(), native=True).select("rule", "severity", "case_id")


@query
def audit_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(number_cases(spark, sf_dir), NUMERIC, Contract()).select("rule", "severity", "case_id")


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = (suite.evaluate(c, m.ExactMatch(), UndefinedPolicy.SKIP, native=True, check=False) for c in label_cases(spark, sf_dir))
    return compare.paired(left, right)


@query
def bootstrap_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bootstrap_replicates(stats.vector(_deltas(spark, sf_dir), "delta", "ordinal"), CONFIG).select("r", F.round("value", 12).alias("value"))


@query
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.bootstrap_replicates(stats.vector(_deltas(spark, sf_dir), "delta", "ordinal"), CONFIG)
    low = (1 - CONFIG.confidence) / 2
    both = rows.agg(F.percentile("value", F.array(F.lit(low), F.lit(1 - low))).alias("b"))
    return both.select(F.round(F.get("b", F.lit(0)), 9).alias("lower"), F.round(F.get("b", F.lit(1)), 9).alias("upper"))


@query
def sign_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sign_replicates(stats.vector(_deltas(spark, sf_dir), "delta", "ordinal"), CONFIG).select("r", F.round("value", 12).alias("value"))


@query
def bootstrap_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same replicates from values in blocks of positions, as beyond the size of an array."""
    return stats.bootstrap_replicates(stats.vector(_deltas(spark, sf_dir), "delta", "ordinal", 0, 256), CONFIG).select("r", F.round("value", 12).alias("value"))


@query
def sign_flip_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sign_replicates(stats.vector(_deltas(spark, sf_dir), "delta", "ordinal", 0, 256), CONFIG).select("r", F.round("value", 12).alias("value"))


def _compared(spark: SparkSession, sf_dir: str, direction: str) -> DataFrame:
    c = compare.compare_cases(*label_cases(spark, sf_dir), m.ExactMatch(), UndefinedPolicy.SKIP, native=True, config=CONFIG, direction=direction)
    better = c.improvement
    row = (c.compared, c.omitted, *(round(x, 9) + 0.0 for x in (c.baseline_mean, c.candidate_mean, c.point, better["point"], better["lower"], better["upper"], c.probability_improvement)), c.passed_gate)
    return spark.createDataFrame([row], "compared bigint, omitted bigint, baseline_mean double, candidate_mean double, delta double, improvement double, lower double, upper double, probability double, passed boolean")


@query
def paired_comparison_higher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir, "higher")


@query
def paired_comparison_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir, "lower")


@query
def markdown_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown_rows(_numeric(spark, sf_dir, UndefinedPolicy.SKIP)).select("line")


@query
def markdown_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of a Markdown report that executors wrote."""
    report = Report("numeric_equivalence", _numeric(spark, sf_dir, UndefinedPolicy.SKIP))
    return spark.read.text(write_markdown(report, _file(spark, ".md"))).where("value <> ''").select(F.col("value").alias("line"))


@query
def json_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results in a JSON report that executors wrote."""
    report = Report("numeric_equivalence", _numeric(spark, sf_dir, UndefinedPolicy.ZERO))
    return read_results(spark, write_json(report, _file(spark, ".json")))


@query
def markdown_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(escape_column(F.col("text"))).alias("escaped_md5"))


@query
def confidence_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of one run's scores, here of the candidate's less the baseline's."""
    found = stats.confidence_interval(_deltas(spark, sf_dir), "delta", "ordinal", CONFIG)
    row = (*(round(found[k], 9) + 0.0 for k in ("point", "lower", "upper")), found["samples"])
    return spark.createDataFrame([row], "point double, lower double, upper double, samples bigint")


@query
def registry_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered metric, built by its name, over all label cases: how many it scores as one, as less, and not at all."""
    registry = MetricRegistry.with_builtins()
    cases = label_cases(spark, sf_dir)[0].cache()
    rows = [suite.score(cases, registry.build({"kind": name}), native=True).select(F.lit(name).alias("name"), "raw") for name in registry.names]
    every = functools.reduce(DataFrame.unionByName, [r.select("name", "raw.score") for r in rows])
    return every.groupBy("name").agg(F.count_if(F.col("score") == 1).alias("ones"), F.count_if(F.col("score") < 1).alias("less"), F.count_if(F.col("score").isNull()).alias("undefined"))


@query
def plugin_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact (Arrow) form of a metric, as plugins run."""
    return suite.score(benchmark_cases(spark, sf_dir), m.RougeL()).select("case_id", F.round("raw.score", 9).alias("score"))
