"""Audit a metric against its contract."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import Metric
from ..model import Contract, Severity
from ..sources.cases import value_of
from .suite import call, native_value

FINDINGS = "rule string, severity string, message string, case_id string, observed array<double>, phase int, ordinal bigint, rank int"
_AGAIN = "struct<first:double,again:double,swapped:double>"


def _apart(a: Column, b: Column, tolerance: float) -> Column:
    """Not both undefined and not within the tolerance."""
    return ~((a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False)))


def _exact(metric: Metric, swap: bool, reference: Column, prediction: Column) -> Column:
    """Two evaluations of a pair, and one of the swapped pair, within one call."""

    @F.pandas_udf(_AGAIN)
    def run(r: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = []
        for x, y in zip(r.to_dict("records"), p.to_dict("records"), strict=True):
            a, b = value_of(x), value_of(y)
            got = [call(metric, a, b), call(metric, a, b), call(metric, b, a) if swap else {"score": None, "error": None}]
            for g in got:
                if g["error"]:
                    raise ValueError(g["error"])
            out.append([g["score"] for g in got])
        return pd.DataFrame(out, columns=["first", "again", "swapped"], dtype="float64")

    return run.asNondeterministic()(reference, prediction)


def _native(metric: Metric, reference: Column, prediction: Column) -> Column:
    first = native_value(metric, reference, prediction)["score"]
    return F.struct(first.alias("first"), first.alias("again"), native_value(metric, prediction, reference)["score"].alias("swapped"))


def _finding(rule: str, severity: Severity, message: Column, case_id: Column, observed: Column, phase: int, ordinal: Column, rank: int) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(str(severity)).alias("severity"), message.alias("message"), case_id.alias("case_id"), observed.alias("observed"), F.lit(phase).alias("phase"), ordinal.cast("bigint").alias("ordinal"), F.lit(rank).alias("rank"))


def distinct_payloads(cases: DataFrame) -> DataFrame:
    """Distinct payloads of both sides with the label and place of their first occurrence."""
    side = lambda name, k: cases.select(F.col(name).alias("payload"), F.concat("case_id", F.lit(f":{name}")).alias("label"), (2 * F.col("ordinal") + k).alias("seq"))
    both = side("reference", 0).union(side("prediction", 1))
    return both.groupBy("payload.kind", "payload.text").agg(F.min_by(F.struct("payload", "label"), "seq").alias("x"), F.min("seq").alias("seq")).select("x.payload", "x.label", "seq")


def audit(cases: DataFrame, metric: Metric, contract: Contract = Contract(), *, native: bool = False) -> DataFrame:
    """Findings (rule, severity, message, case_id, observed, ...) in no order; see ``ordered``.

    Per case: bounds, determinism and symmetry; per distinct payload: the score
    of the pair with itself; and a warning when there are no cases.
    Columns are deterministic by construction, so determinism is put to the test
    only by ``evaluate``.
    """
    tol, both = contract.tolerance, lambda a, b: F.array(F.col(a), F.col(b))
    pair = _native(metric, F.col("reference"), F.col("prediction")) if native else _exact(metric, contract.symmetric, F.col("reference"), F.col("prediction"))
    seen = cases.select("ordinal", "case_id", pair.alias("s")).select("ordinal", "case_id", "s.*")
    checks = [F.when((F.col("first") < contract.minimum - tol) | (F.col("first") > contract.maximum + tol), _finding("bounded", Severity.ERROR, F.lit(f"score outside [{contract.minimum:g}, {contract.maximum:g}]"), F.col("case_id"), F.array("first"), 0, F.col("ordinal"), 0))]
    if contract.deterministic:
        checks.append(F.when(_apart(F.col("first"), F.col("again"), tol), _finding("deterministic", Severity.ERROR, F.lit("a second evaluation gave another score"), F.col("case_id"), both("first", "again"), 0, F.col("ordinal"), 1)))
    if contract.symmetric:
        checks.append(F.when(_apart(F.col("first"), F.col("swapped"), tol), _finding("symmetric", Severity.ERROR, F.lit("swapping the sides gave another score"), F.col("case_id"), both("first", "swapped"), 0, F.col("ordinal"), 2)))
    found = seen.select(F.explode(F.array_compact(F.array(*checks))).alias("f")).select("f.*")
    if contract.identity_score is not None:
        own = _native(metric, F.col("payload"), F.col("payload")) if native else _exact(metric, False, F.col("payload"), F.col("payload"))
        alone = distinct_payloads(cases).select("label", "seq", own["first"].alias("first"))
        wrong = F.col("first").isNull() | ~F.coalesce(F.abs(F.col("first") - contract.identity_score) <= tol, F.lit(False))
        message = F.lit(f"a value scored against itself is not {contract.identity_score:g}")
        found = found.unionByName(alone.where(wrong).select(_finding("identity", Severity.ERROR, message, F.col("label"), F.array("first"), 1, F.col("seq"), 0).alias("f")).select("f.*"))
    if cases.isEmpty():
        none = cases.sparkSession.range(1).select(_finding("coverage", Severity.WARNING, F.lit("there are no cases to audit"), F.lit(None).cast("string"), F.lit(None).cast("array<double>"), 2, F.lit(0), 0).alias("f"))
        found = found.unionByName(none.select("f.*"))
    return found


def ordered(findings: DataFrame) -> DataFrame:
    """Findings in report order."""
    return findings.orderBy("phase", "ordinal", "rank")


def passed(findings: DataFrame) -> bool:
    """Whether no finding is an error."""
    return findings.where(F.col("severity") == str(Severity.ERROR)).isEmpty()
