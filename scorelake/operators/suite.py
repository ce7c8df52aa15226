"""Evaluate cases under an undefined policy."""

from __future__ import annotations

import builtins
import json
from collections.abc import Iterator
from fractions import Fraction
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import Metric, NumericEquivalence
from ..model import MetricValue, UndefinedPolicy
from ..sources.cases import require_unique_ids, value_of

VALUE = "struct<score:double,reason:string,details:string>"
_CALL = "struct<score:double,reason:string,details:string,error:string>"


def call(metric: Metric, reference: Any, prediction: Any) -> dict[str, Any]:
    """One evaluation as a row; a metric's own exception is kept, never swallowed."""
    out: dict[str, Any] = {"score": None, "reason": None, "details": None, "error": None}
    try:
        got = metric.evaluate(reference, prediction)
        if not isinstance(got, MetricValue):
            raise TypeError(f"{metric.name} returned {type(got).__name__}, not a MetricValue")
        return out | {"score": got.score, "reason": got.reason, "details": json.dumps(got.details, sort_keys=True, ensure_ascii=False, default=str)}
    except Exception as e:
        return out | {"error": f"{type(e).__name__}: {e}"}


def exact_value(metric: Metric, reference: Column, prediction: Column) -> Column:
    """The metric's own ``evaluate`` as an Arrow function; with field ``error``."""

    @F.pandas_udf(_CALL)
    def run(r: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        pairs = zip(r.to_dict("records"), p.to_dict("records"), strict=True)
        return pd.DataFrame([call(metric, value_of(x), value_of(y)) for x, y in pairs], columns=["score", "reason", "details", "error"])

    return run.asNondeterministic()(reference, prediction)


def native_value(metric: Metric, reference: Column, prediction: Column) -> Column:
    """The metric's JVM form; text metrics have an error where a payload is no string."""
    if isinstance(metric, NumericEquivalence):
        return metric.column(reference, prediction).withField("error", F.lit(None).cast("string"))
    strings = (reference["kind"] == "str") & (prediction["kind"] == "str")
    value = metric.column(reference["text"], prediction["text"])
    return F.when(strings, value.withField("error", F.lit(None).cast("string"))).otherwise(F.struct(F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("details"), F.lit("TypeError: text metrics need strings").alias("error")))


def score(cases: DataFrame, metric: Metric, native: bool = False) -> DataFrame:
    """``cases`` with ``raw``, the metric's value before any policy; lazy."""
    value = (native_value if native else exact_value)(metric, F.col("reference"), F.col("prediction"))
    # one element, exploded: a value whose fields are read several times is still computed once
    return cases.drop("raw").select("*", F.explode(F.array(value)).alias("raw"))


def resolve(scored: DataFrame, policy: UndefinedPolicy) -> DataFrame:
    """``resolved_score`` and ``skipped`` by the policy; undefined scores stay null under ``error``."""
    fill = {UndefinedPolicy.ZERO: 0.0, UndefinedPolicy.ONE: 1.0}.get(policy)
    s = F.col("raw.score")
    return scored.withColumn("resolved_score", F.coalesce(s, F.lit(fill).cast("double"))).withColumn("skipped", s.isNull() & F.lit(policy == UndefinedPolicy.SKIP))


def _raise(message: str) -> None:
    """The metric's own exception again, if it is a built-in kind that takes a message; else a RuntimeError that names it."""
    kind, _, text = message.partition(": ")
    found = getattr(builtins, kind, None)
    if isinstance(found, type) and issubclass(found, Exception) and not issubclass(found, UnicodeError):
        raise found(text)
    raise RuntimeError(message)


def evaluate(cases: DataFrame, metric: Metric, policy: UndefinedPolicy = UndefinedPolicy.ERROR, *, native: bool = False, check: bool = True) -> DataFrame:
    """Results of every case: ordinal, case_id, tags, raw, resolved_score, skipped.

    With ``check``, repeated ids are refused, then the first case in order with
    a metric error or (under ``error``) an undefined score raises; without it
    the result is lazy and those rows have nulls. A checked result is cached, so that
    no case is scored twice; ``unpersist`` it after use.
    """
    policy = UndefinedPolicy(policy)
    if check:
        require_unique_ids(cases)
    out = resolve(score(cases, metric, native), policy)
    if check:
        out = out.cache()
        bad = F.col("raw.error").isNotNull() | (F.col("raw.score").isNull() & F.lit(policy == UndefinedPolicy.ERROR))
        first = out.where(bad).agg(F.min_by(F.struct("case_id", "raw.reason", "raw.error"), "ordinal")).first()[0]
        if first is not None:
            if first.error:
                _raise(first.error)
            raise ValueError(f"case {first.case_id!r} is undefined: {first.reason}")
    return out


def _partial(values: np.ndarray) -> int:
    """The exact sum of finite doubles, in units of 2**-1074."""
    mantissa, exponent = np.frexp(values)
    whole = (mantissa * 2.0**53).astype(np.int64)
    kinds, group = np.unique(exponent, return_inverse=True)
    high, low = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
    np.add.at(high, group, whole >> 26)
    np.add.at(low, group, whole & (1 << 26) - 1)
    shift = lambda n, k: n << k if k >= 0 else n >> -k  # exact: a double has no bit below 2**-1074
    return sum(shift((int(h) << 26) + int(v), int(e) - 53 + 1074) for h, v, e in zip(high, low, kinds, strict=True))


def exact_sums(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Per key (all rows without keys): n_<column>, the non-null values, and mean_<column>, their correctly rounded sum over n.

    Partitions add in whole numbers, so the results depend neither on partitions nor
    on order; each sends one row a key. A sum with a non-finite value is null.
    """
    keys = keys or []
    shape = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), *(f"`n{i}` bigint, `s{i}` string" for i in range(len(columns)))])

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[Any, list[Any]] = {}
        for frame in frames:
            for key, rows in frame.groupby(keys, dropna=False, sort=False) if keys else [((), frame)]:
                own = totals.setdefault(key, [0, 0] * len(columns))
                for i in range(len(columns)):
                    values = rows[f"c{i}"].dropna().to_numpy(float)
                    own[2 * i] += len(values)
                    if own[2 * i + 1] is not None:
                        own[2 * i + 1] = own[2 * i + 1] + _partial(values) if np.isfinite(values).all() else None
        if totals:
            yield pd.DataFrame([[*k, *(x if j % 2 == 0 or x is None else str(x) for j, x in enumerate(v))] for k, v in totals.items()], columns=[*keys, *(f"{x}{i}" for i in range(len(columns)) for x in "ns")])

    @F.pandas_udf("double")
    def mean(sums: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for parts, n in zip(sums, counts, strict=True):
            known = n and all(p is not None for p in parts)
            out.append(float(Fraction(sum(map(int, parts)), 1 << 1074)) / n if known else None)
        return pd.Series(out, dtype=object)

    partial = df.select(*(F.col(f"`{k}`") for k in keys), *(F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns))).mapInPandas(part, shape)
    listed = lambda i: F.collect_list(F.coalesce(F.col(f"s{i}"), F.lit("x"))).alias(f"l{i}")
    found = partial.groupBy(*keys).agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(len(columns))), *(listed(i) for i in range(len(columns))))
    sums = lambda i: F.transform(f"l{i}", lambda x: F.when(x != "x", x))
    return found.select(*(F.col(f"`{k}`") for k in keys), *(x for i, c in enumerate(columns) for x in (F.coalesce(f"n{i}", F.lit(0)).alias(f"n_{c}"), mean(sums(i), F.coalesce(f"n{i}", F.lit(0))).alias(f"mean_{c}"))))


def exact_mean(df: DataFrame, column: str) -> float | None:
    """The correctly rounded sum of a column over its count; None without values."""
    return exact_sums(df, [column]).first()[1]


def summary(results: DataFrame) -> DataFrame:
    """One row: case_count, scored_count, skipped_count, mean_score (the exact mean)."""
    one = F.lit(1).alias("k")
    counts = results.agg(F.count("*").alias("case_count"), F.count("resolved_score").alias("scored_count"), F.count_if("skipped").alias("skipped_count")).select("*", one)
    return counts.join(exact_sums(results, ["resolved_score"]).select(F.col("mean_resolved_score").alias("mean_score"), one), "k").drop("k")


def summarize_by_tag(results: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Per tag: case_count (skipped ones included), scored_count, mean_score (the exact mean).

    ``cases`` gives tags to results without them; both must have the same ids.
    """
    rows = results
    if cases is not None:
        require_unique_ids(cases)
        both = results.select("case_id", F.lit(1).alias("l")).join(cases.select("case_id", F.lit(1).alias("r")), "case_id", "full")
        if not both.where("l is null or r is null").isEmpty():
            raise ValueError("results and cases must have the same ids")
        rows = results.drop("tags").join(cases.select("case_id", "tags"), "case_id")
    tagged = rows.select(F.explode("tags").alias("tag"), "resolved_score")
    counts = tagged.groupBy("tag").agg(F.count("*").alias("case_count"))
    means = exact_sums(tagged, ["resolved_score"], ["tag"]).select("tag", F.col("n_resolved_score").alias("scored_count"), F.col("mean_resolved_score").alias("mean_score"))
    return counts.join(means, "tag").orderBy("tag")
