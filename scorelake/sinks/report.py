"""Reports as versioned objects, JSON and Markdown."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import ordered, passed
from ..operators.compare import Comparison
from ..operators.shared import assembled
from ..operators.suite import exact_mean, summary

SCHEMA_VERSION = 1
#: Characters with a meaning in Markdown cells, the ampersand first.
_ESCAPES = (("&", "&amp;"), ("|", "&#124;"), ("`", "&#96;"), ("<", "&lt;"), (">", "&gt;"), ("\r\n", "<br>"), ("\r", "<br>"), ("\n", "<br>"))


def escape(text: str) -> str:
    """``text`` safe inside a Markdown cell."""
    for a, b in _ESCAPES:
        text = text.replace(a, b)
    return text


def escape_column(text: Column) -> Column:
    """The column form of ``escape``."""
    for a, b in _ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


@dataclass(frozen=True)
class Report:
    """A metric's results and findings; both stay DataFrames until they are rendered."""

    metric: str
    results: DataFrame
    findings: DataFrame | None = None

    @property
    def passed_contracts(self) -> bool:
        return self.findings is None or passed(self.findings)


def _summary(report: Report) -> dict[str, Any]:
    counts = summary(report.results).first()
    return {"case_count": counts.case_count, "scored_count": counts.scored_count, "skipped_count": counts.skipped_count, "mean_score": exact_mean(report.results, "resolved_score"), "passed_contracts": report.passed_contracts}


def _result(r: dict[str, Any]) -> dict[str, Any]:
    return {"case_id": r["case_id"], "raw_score": r["raw"]["score"], "resolved_score": r["resolved_score"], "undefined_reason": r["raw"]["reason"], "skipped": r["skipped"], "details": json.loads(r["raw"]["details"] or "{}")}


def _finding(f: dict[str, Any]) -> dict[str, Any]:
    seen = f["observed"]
    observed = None if seen is None or f["rule"] == "identity" and seen[0] is None else seen[0] if len(seen) == 1 else list(seen)
    return {"rule": f["rule"], "severity": f["severity"], "message": f["message"], "case_id": f["case_id"], "observed": observed}


def report_to_dict(report: Report) -> dict[str, Any]:
    """The whole report as an object on the driver; ``write_json`` is for results of any size."""
    rows = report.results.orderBy("ordinal").select("case_id", "raw", "resolved_score", "skipped").collect()
    found = ordered(report.findings).collect() if report.findings is not None else []
    return {
        "schema_version": SCHEMA_VERSION,
        "metric": report.metric,
        "summary": _summary(report),
        "results": [_result(r.asDict(recursive=True)) for r in rows],
        "findings": [_finding(f.asDict(recursive=True)) for f in found],
    }


def _json(value: dict[str, Any]) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False, sort_keys=True, allow_nan=False) + "\n"


def render_json(report: Report) -> str:
    return _json(report_to_dict(report))


def markdown_rows(results: DataFrame) -> DataFrame:
    """(ordinal, line): the table row of each case."""
    number = lambda c, none: F.coalesce(F.format_string("%.6f", c), F.lit(none))
    state = F.when(F.col("skipped"), "skipped").otherwise(F.coalesce("raw.reason", F.lit("scored")))
    raw = F.when(F.col("raw.score").isNull(), "undefined").otherwise(F.format_string("%.6f", F.col("raw.score")))
    resolved = F.when(F.col("resolved_score").isNull(), "—").otherwise(F.format_string("%.6f", F.col("resolved_score")))
    return results.select("ordinal", F.concat(F.lit("| `"), escape_column(F.col("case_id")), F.lit("` | "), raw, F.lit(" | "), resolved, F.lit(" | "), escape_column(state), F.lit(" |")).alias("line"))


def _finding_lines(findings: DataFrame) -> DataFrame:
    """(phase, ordinal, rank, line): the list entry of each finding."""
    where = F.when(F.col("case_id") != "", F.concat(F.lit(" (`"), escape_column(F.col("case_id")), F.lit("`)"))).otherwise("")
    line = F.concat(F.lit("- **"), F.upper("severity"), F.lit("** `"), escape_column(F.col("rule")), F.lit("`"), F.coalesce(where, F.lit("")), F.lit(": "), escape_column(F.col("message")))
    return findings.select("phase", "ordinal", "rank", line.alias("line"))


def _markdown_parts(report: Report) -> list[str | DataFrame]:
    s = _summary(report)
    mean = "n/a" if s["mean_score"] is None else f"{s['mean_score']:.6f}"
    # The report's headings and labels.
    head = [
        f"# Metric report: `{escape(report.metric)}`", "",
        f"- Contract status: **{'PASS' if s['passed_contracts'] else 'FAIL'}**",
        f"- Cases: {s['case_count']} ({s['scored_count']} scored, {s['skipped_count']} skipped)",
        f"- Macro mean: {mean}", "", "## Cases", "", "| Case | Raw | Resolved | State |", "|---|---:|---:|---|", "",
    ]
    none = report.findings is None or report.findings.isEmpty()
    return ["\n".join(head), markdown_rows(report.results), "\n## Contract findings\n\n", "No contract findings.\n" if none else _finding_lines(report.findings)]


def render_markdown(report: Report) -> str:
    """The Markdown report as a text on the driver; ``write_markdown`` is for results of any size."""
    lines = lambda part: "".join(f"{r.line}\n" for r in part.orderBy(*(c for c in part.columns if c != "line")).collect())
    return "".join(part if isinstance(part, str) else lines(part) for part in _markdown_parts(report))


def write_markdown(report: Report, path: str | Path) -> str:
    """The text of ``render_markdown`` as a file, whose cases and findings executors write."""
    return assembled(str(path), _markdown_parts(report), report.results.sparkSession)


def listed(lines: DataFrame) -> DataFrame:
    """``lines`` with a comma after all but the last in order of its other columns, which tell rows apart."""
    keys = F.struct(*(c for c in lines.columns if c != "line"))
    last = lines.agg(F.max(keys).alias("_last"))
    return lines.join(F.broadcast(last)).select(*(c for c in lines.columns if c != "line"), F.concat("line", F.when(keys == F.col("_last"), "").otherwise(",")).alias("line"))


def _items(rows: DataFrame | None, keys: list[str], shape: Callable[[dict[str, Any]], dict[str, Any]]) -> list[str | DataFrame]:
    """A list inside the report object; each row is rendered where it stands."""
    if rows is None or rows.isEmpty():
        return ["[]"]

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(f"    {x}" for x in _json(shape(r))[:-1].split("\n")) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(texts, pa.string())], [*keys, "line"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return ["[\n", listed(rows.mapInArrow(render, f"{kinds}, line string")), "  ]"]


def write_json(report: Report, path: str | Path) -> str:
    """The text of ``render_json`` as a file, whose cases and findings executors write."""
    head = _json({"metric": report.metric})[4:-3]
    tail = _json({"schema_version": SCHEMA_VERSION, "summary": _summary(report)})[2:]
    results = report.results.select("ordinal", "case_id", "raw", "resolved_score", "skipped")
    findings = report.findings
    parts = ['{\n  "findings": ', *_items(findings, ["phase", "ordinal", "rank"], _finding), f",\n  {head},\n  \"results\": ", *_items(results, ["ordinal"], _result), ",\n" + tail]
    return assembled(str(path), parts, report.results.sparkSession)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The results in a file of ``write_json``, without their details, read in byte ranges.

    Only the end of a list's item is a line of four blanks and a brace: texts hold no line feed.
    """
    item = F.concat(F.lit("{"), F.substring_index("value", "\n    {\n", -1), F.lit("}"))
    schema = "case_id string, raw_score double, resolved_score double, skipped boolean, undefined_reason string"
    own = spark.read.option("lineSep", "\n    }").text(path).where(F.col("value").contains('\n      "raw_score": '))
    return own.select(F.from_json(item, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def comparison_to_dict(c: Comparison) -> dict[str, Any]:
    return {
        "schema_version": SCHEMA_VERSION,
        "metric": c.metric,
        "baseline_mean": c.baseline_mean,
        "candidate_mean": c.candidate_mean,
        "delta": {"point": c.point, "lower": c.lower, "upper": c.upper, "confidence": c.confidence, "bootstrap_samples": c.samples},
        "improvement": {"direction": c.direction, **c.improvement},
        "methods": {"confidence_interval": "paired-percentile-bootstrap-v1", "p_value": "paired-sign-flip-monte-carlo-v1", "p_value_samples": c.samples},
        "probability_improvement": c.probability_improvement,
        "two_sided_p_value": c.p_value,
        "compared_count": c.compared,
        "omitted_count": c.omitted,
        "gate": {"minimum_delta": c.minimum_delta, "minimum_lower_bound": c.minimum_lower_bound, "passed": c.passed_gate},
    }


def render_comparison_json(c: Comparison) -> str:
    return _json(comparison_to_dict(c))


def render_comparison_markdown(c: Comparison) -> str:
    better = c.improvement
    lines = [
        f"# Metric comparison: `{escape(c.metric)}`", "",
        f"- Regression gate: **{'PASS' if c.passed_gate else 'FAIL'}**",
        f"- Compared cases: {c.compared}",
        f"- Omitted on both sides: {c.omitted}",
        f"- Optimization direction: {c.direction}",
        f"- Baseline macro mean: {c.baseline_mean:.6f}",
        f"- Candidate macro mean: {c.candidate_mean:.6f}",
        f"- Candidate - baseline (raw): {c.point:+.6f}",
        f"- Direction-oriented improvement: {better['point']:+.6f}",
        f"- {c.confidence * 100:g}% paired-bootstrap interval (oriented improvement): [{better['lower']:+.6f}, {better['upper']:+.6f}] ({c.samples} samples)",
        f"- Bootstrap mass above zero improvement: {c.probability_improvement:.6f}",
        f"- Two-sided paired sign-flip p-value: {c.p_value:.6f} ({c.samples} Monte Carlo samples)",
        f"- Minimum observed improvement: {c.minimum_delta:+.6f}",
    ]
    if c.minimum_lower_bound is not None:
        lines.append(f"- Minimum confidence lower bound: {c.minimum_lower_bound:+.6f}")
    return "\n".join(lines) + "\n"
