"""Deterministic resampling: bootstrap intervals and sign-flip tests.

A draw is the SHA-256 digest of (domain, seed, replicate, position), joined by
NUL, so replicates need nothing of each other. Each replicate sums its values in
the order of their positions, from left to right. Up to ``ARRAY_ROWS`` values
travel as one array that is joined to the replicates. More of them stand in blocks
of positions: a replicate's draws for one run of positions look up the blocks
that they hit by a join, come back in order, and its sum goes on from run to run. Both
forms give the same doubles, bit for bit. Tasks follow the number of values, not
that of the blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import BootstrapConfig
from .shared import cut
from .suite import exact_mean

#: Values that travel as one array (8 MB a million), and positions of a block beyond that.
ARRAY_ROWS, BLOCK_ROWS = 5_000_000, 1 << 16
#: Values that are put in order by one task, and positions that a replicate draws at once.
TASK_ROWS, RUN_ROWS = 1 << 16, 1 << 20
_INDEX = (1 << 33) - 1


def vector(rows: DataFrame, value: str, order: str, array_rows: int = ARRAY_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The non-null values in order: one row ``xs``, or beyond ``array_rows`` values rows ``block, xs, n``, each with ``block_rows`` of all ``n`` values.

    ValueError without values, or with one that is not finite. Equal orders go by value.
    """
    x = F.col(value).cast("double")
    own = rows.where(F.col(value).isNotNull())
    n, odd = own.agg(F.count("*"), F.count_if(F.isnan(x) | (F.abs(x) == float("inf")))).first()
    if not n:
        raise ValueError("there are no resolved scores")
    if odd:
        raise ValueError("resampling takes finite scores only")
    pairs = own.select(F.col(order).alias("o"), x.alias("x"))
    if n <= array_rows:
        return pairs.agg(F.array_sort(F.collect_list(F.struct("o", "x"))).alias("v")).select(F.transform("v", lambda s: s["x"]).alias("xs"))
    spark = rows.sparkSession
    parts = max(-(-n // TASK_ROWS), min(spark.sparkContext.defaultParallelism, -(-n // block_rows)))
    ranked = pairs.repartitionByRange(parts, "o", "x").sortWithinPartitions("o", "x")
    placed = cut(ranked.select("x", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(_INDEX).alias("i")))
    before, bases = 0, []
    for r in placed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # one row a part
        bases.append((r.part, before))
        before += r.n
    at = placed.join(F.broadcast(spark.createDataFrame(bases, "part int, base bigint")), "part").select("x", (F.col("base") + F.col("i")).alias("p"))
    blocks = at.groupBy(F.expr(f"p div {block_rows}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("v"))
    return cut(blocks.select("block", F.transform("v", lambda s: s["x"]).alias("xs"), F.lit(n).cast("bigint").alias("n")))


def _digest(domain: str, seed: int, replicate: Column, position: Column) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit(domain), F.lit(str(seed)), replicate.cast("string"), position.cast("string")), 256)


def _replicates(xs: DataFrame, config: BootstrapConfig) -> DataFrame:
    """``r`` from 0 with the vector at its side; the vector is one row of checked size."""
    spark = xs.sparkSession
    tasks = max(1, min(config.samples, spark.sparkContext.defaultParallelism))
    return spark.range(0, config.samples, 1, tasks).withColumnRenamed("id", "r").withColumn("_k", F.lit(1)).join(F.broadcast(xs.withColumn("_k", F.lit(1))), "_k").drop("_k")


def _mean_of(term) -> Column:
    positions = F.sequence(F.lit(0), F.size("xs") - 1)
    return F.aggregate(positions, F.lit(0.0), lambda acc, p: acc + term(p)) / F.size("xs")


def _size_of(blocks: DataFrame) -> tuple[int, int]:
    """All values of a blocked vector, and those of each block but the last."""
    return blocks.agg(F.max("n"), F.max(F.size("xs"))).first()


def _draw(domain: str, seed: int, replicate: int, position: int) -> bytes:
    return hashlib.sha256(f"{domain}\0{seed}\0{replicate}\0{position}".encode()).digest()


def _blocked_bootstrap(blocks: DataFrame, config: BootstrapConfig) -> DataFrame:
    spark = blocks.sparkSession
    n, size = _size_of(blocks)
    step = max(size, RUN_ROWS)
    runs = -(-n // step)
    samples, domain, seed = config.samples, config.bootstrap_domain, config.seed

    def draws(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The draws of one replicate for one run of positions, by the block that they hit."""
        for frame in frames:
            for r, run in zip((frame["id"] // runs).tolist(), (frame["id"] % runs).tolist(), strict=True):
                first = run * step
                last = min(n, first + step)
                hit = np.fromiter((int.from_bytes(_draw(domain, seed, r, p)[:8], "big") % n for p in range(first, last)), np.int64, last - first)
                order = np.argsort(hit // size, kind="stable")
                block = (hit // size)[order]
                edges = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
                cuts = [*zip(edges.tolist(), [*edges[1:].tolist(), len(block)], strict=True)]
                yield pd.DataFrame({"r": r, "run": run, "block": block[edges], "at": [order[a:b].astype(np.int32) for a, b in cuts], "inner": [(hit[order[a:b]] % size).astype(np.int32) for a, b in cuts]})

    tasks = min(samples * runs, max(spark.sparkContext.defaultParallelism, samples * n >> 24))
    drawn = spark.range(0, samples * runs, 1, tasks).mapInPandas(draws, "r bigint, run bigint, block bigint, at array<int>, inner array<int>")
    # without the hint Spark takes the draws for a table as small as the range and sends them all through the driver
    found = drawn.hint("merge").join(blocks.select("block", "xs"), "block").select("r", "run", "at", F.transform("inner", lambda i: F.get("xs", i)).alias("x"))

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums of replicates whose parts arrive run by run; one run's values are held."""
        here: tuple[int, int] | None = None
        held: list[tuple[Any, Any]] = []
        total = 0.0

        def close() -> None:
            nonlocal total
            values = np.empty(1 + sum(len(at) for at, _ in held))
            values[0] = total
            for at, x in held:
                values[1 + np.asarray(at)] = x
            total = float(np.cumsum(values)[-1])  # cumsum adds from left to right

        for frame in frames:
            for r, run, at, x in frame.itertuples(index=False):
                if here is not None and here != (r, run):
                    close()
                    held = []
                    if here[0] != r:
                        yield pd.DataFrame({"r": [here[0]], "value": [total / n]})
                        total = 0.0
                here = (r, run)
                held.append((at, x))
        if here is not None:
            close()
            yield pd.DataFrame({"r": [here[0]], "value": [total / n]})

    parts = max(1, min(samples, spark.sparkContext.defaultParallelism * 4))
    return found.repartition(parts, "r").sortWithinPartitions("r", "run").mapInPandas(add, "r bigint, value double")


def _blocked_signs(blocks: DataFrame, config: BootstrapConfig) -> DataFrame:
    spark = blocks.sparkSession
    n, size = _size_of(blocks)
    groups = max(1, min(config.samples, spark.sparkContext.defaultParallelism * 4))
    samples, domain, seed = config.samples, config.sign_domain, config.seed

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums of the replicates of a group over blocks that arrive in order; a sum a replicate is held."""
        totals: dict[int, float] = {}
        for frame in frames:
            for group, block, xs in frame.itertuples(index=False):
                first = block * size
                for r in range(group, samples, groups):
                    odd = np.array([_draw(domain, seed, r, p)[0] & 1 for p in range(first, first + len(xs))], bool)
                    totals[r] = float(np.cumsum(np.concatenate(([totals.get(r, 0.0)], np.where(odd, xs, -xs))))[-1])
        if totals:
            yield pd.DataFrame({"r": list(totals), "value": [t / n for t in totals.values()]})

    # each block goes to every group of replicates once, whatever the number of replicates
    dealt = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "block", "xs")
    return dealt.repartitionById(groups, "group").sortWithinPartitions("group", "block").mapInPandas(add, "r bigint, value double")


def bootstrap_replicates(xs: DataFrame, config: BootstrapConfig) -> DataFrame:
    """(r, value): the mean of each resample of a ``vector``."""
    if "block" in xs.columns:
        return _blocked_bootstrap(xs, config)

    def drawn(p: Column) -> Column:
        head = F.conv(F.substring(_digest(config.bootstrap_domain, config.seed, F.col("r"), p), 1, 16), 16, 10).cast("decimal(20,0)")
        return F.get("xs", (head % F.size("xs").cast("decimal(20,0)")).cast("int"))

    return _replicates(xs, config).select("r", _mean_of(drawn).alias("value"))


def sign_replicates(xs: DataFrame, config: BootstrapConfig) -> DataFrame:
    """(r, value): the mean of a ``vector`` with each sign drawn at random."""
    if "block" in xs.columns:
        return _blocked_signs(xs, config)

    def flipped(p: Column) -> Column:
        low = F.conv(F.substring(_digest(config.sign_domain, config.seed, F.col("r"), p), 1, 2), 16, 10).cast("int") % 2
        return F.when(low == 1, F.get("xs", p)).otherwise(-F.get("xs", p))

    return _replicates(xs, config).select("r", _mean_of(flipped).alias("value"))


def interval(replicates: DataFrame, config: BootstrapConfig) -> tuple[float, float]:
    """Percentile bounds by linear interpolation between order statistics."""
    low = (1 - config.confidence) / 2
    return tuple(replicates.agg(F.percentile("value", F.array(F.lit(low), F.lit(1 - low)))).first()[0])


def confidence_interval(rows: DataFrame, value: str = "resolved_score", order: str = "ordinal", config: BootstrapConfig = BootstrapConfig()) -> dict[str, float]:
    """Point (correctly rounded mean), lower, upper, confidence and samples of a column's non-null values."""
    lower, upper = interval(bootstrap_replicates(vector(rows, value, order), config), config)
    return {"point": exact_mean(rows, value), "lower": lower, "upper": upper, "confidence": config.confidence, "samples": config.samples}


def sign_flip_p_value(xs: DataFrame, observed: float, config: BootstrapConfig) -> float:
    """(extreme + 1) / (samples + 1)."""
    extreme = sign_replicates(xs, config).where(F.abs("value") >= abs(observed)).count()
    return (extreme + 1) / (config.samples + 1)
