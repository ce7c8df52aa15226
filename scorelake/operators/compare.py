"""Compare two aligned runs."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import Metric
from ..model import BootstrapConfig, UndefinedPolicy, finite
from ..sources.cases import require_unique_ids
from .stats import bootstrap_replicates, interval, sign_flip_p_value, vector
from .suite import evaluate, exact_sums


def id_differences(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(case_id, missing_from) of ids on one side only."""
    b, c = baseline.select("case_id", F.lit(1).alias("b")), candidate.select("case_id", F.lit(1).alias("c"))
    return b.join(c, "case_id", "full").where("b is null or c is null").select("case_id", F.when(F.col("c").isNull(), "candidate").otherwise("baseline").alias("missing_from"))


def case_differences(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(ordinal, case_id, differs) of shared ids whose reference or tags differ, by baseline order.

    References are compared with their JSON types and regardless of key order, tags as sets.
    """
    b = baseline.select("ordinal", "case_id", F.col("reference.kind").alias("bk"), F.col("reference.canon").alias("bc"), F.array_sort("tags").alias("bt"))
    c = candidate.select("case_id", F.col("reference.kind").alias("ck"), F.col("reference.canon").alias("cc"), F.array_sort("tags").alias("ct"))
    differs = F.when(~F.col("bk").eqNullSafe(F.col("ck")) | ~F.col("bc").eqNullSafe(F.col("cc")), "reference").when(~F.col("bt").eqNullSafe(F.col("ct")), "tags")
    return b.join(c, "case_id").select("ordinal", "case_id", differs.alias("differs")).where("differs is not null")


def require_aligned(baseline: DataFrame, candidate: DataFrame) -> None:
    """ValueError with the first way in which two case sets do not align."""
    require_unique_ids(baseline, "baseline")
    require_unique_ids(candidate, "candidate")
    missing = id_differences(baseline, candidate).groupBy("missing_from").agg(F.array_sort(F.collect_list("case_id")).alias("ids")).orderBy(F.desc("missing_from")).collect()
    if missing:
        raise ValueError("; ".join(f"missing from {r.missing_from}: {', '.join(r.ids)}" for r in missing))
    first = case_differences(baseline, candidate).agg(F.min_by(F.struct("case_id", "differs"), "ordinal")).first()[0]
    if first:
        raise ValueError(f"{first.differs} of case {first.case_id!r} differs")


def paired(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Results joined by id: ordinal (the baseline's), case_id, left, right, delta, omitted, one_sided."""
    left = baseline.select("ordinal", "case_id", F.col("resolved_score").alias("left"))
    rows = left.join(candidate.select("case_id", F.col("resolved_score").alias("right")), "case_id")
    l_null, r_null = F.col("left").isNull(), F.col("right").isNull()
    return rows.select("ordinal", "case_id", "left", "right", (F.col("right") - F.col("left")).alias("delta"), (l_null & r_null).alias("omitted"), (l_null != r_null).alias("one_sided"))


@dataclass(frozen=True)
class Comparison:
    """Paired statistics; ``improvement`` turns the delta by the direction."""

    metric: str
    direction: str
    baseline_mean: float
    candidate_mean: float
    point: float
    lower: float
    upper: float
    confidence: float
    samples: int
    probability_improvement: float
    p_value: float
    compared: int
    omitted: int
    minimum_delta: float = 0.0
    minimum_lower_bound: float | None = None

    @property
    def improvement(self) -> dict[str, float]:
        if self.direction == "higher":
            return {"point": self.point, "lower": self.lower, "upper": self.upper}
        return {"point": -self.point, "lower": -self.upper, "upper": -self.lower}

    @property
    def passed_gate(self) -> bool:
        better = self.improvement
        return better["point"] >= self.minimum_delta and (self.minimum_lower_bound is None or better["lower"] >= self.minimum_lower_bound)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


def compare_results(
    baseline: DataFrame, candidate: DataFrame, *, metric: str, candidate_metric: str | None = None, config: BootstrapConfig = BootstrapConfig(),
    minimum_delta: float = 0.0, minimum_lower_bound: float | None = None, direction: str = "higher",
) -> Comparison:
    """Paired comparison of two results tables with the same ids; cases skipped on both sides are left out."""
    if direction not in ("higher", "lower"):
        raise ValueError("direction must be 'higher' or 'lower'")
    finite(minimum_delta, "minimum_delta")
    if minimum_lower_bound is not None:
        finite(minimum_lower_bound, "minimum_lower_bound")
    if candidate_metric is not None and candidate_metric != metric:
        raise ValueError("the reports use different metrics")
    require_unique_ids(baseline, "baseline")
    require_unique_ids(candidate, "candidate")
    if not id_differences(baseline, candidate).isEmpty():
        raise ValueError("the reports must have the same ids")
    rows = paired(baseline, candidate).cache()
    one = rows.where("one_sided").agg(F.min_by("case_id", "ordinal")).first()[0]
    if one is not None:
        raise ValueError(f"case {one!r} is skipped on one side only")
    kept = rows.where("not omitted")
    compared, omitted = rows.agg(F.count_if(~F.col("omitted")), F.count_if("omitted")).first()
    xs = vector(kept, "delta", "ordinal").cache()
    replicates = bootstrap_replicates(xs, config).cache()
    lower, upper = interval(replicates, config)
    sign = 1.0 if direction == "higher" else -1.0
    better = replicates.select((F.col("value") * sign).alias("v"))
    mass = better.agg(F.avg(F.when(F.col("v") > 0, 1.0).when(F.col("v") == 0, 0.5).otherwise(0.0))).first()[0]
    means = exact_sums(kept, ["delta", "left", "right"]).first()
    point = means.mean_delta
    out = Comparison(
        metric, direction, means.mean_left, means.mean_right, point, lower, upper, config.confidence, config.samples,
        mass, sign_flip_p_value(xs, point, config), compared, omitted, minimum_delta, minimum_lower_bound,
    )
    for frame in (replicates, xs, rows):
        frame.unpersist()
    return out


def compare_cases(baseline: DataFrame, candidate: DataFrame, metric: Metric, policy: UndefinedPolicy = UndefinedPolicy.ERROR, *, native: bool = False, **options: Any) -> Comparison:
    """Align two case sets, evaluate both with one metric, and compare."""
    require_aligned(baseline, candidate)
    left, right = (evaluate(x, metric, policy, native=native) for x in (baseline, candidate))
    try:
        return compare_results(left, right, metric=metric.name, **options)
    finally:
        left.unpersist(), right.unpersist()
