"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import batch_of, release, store

#: Links that one task makes into stars at once.
_AT_ONCE = 1 << 17


def _stars(links: DataFrame, at_once: int) -> DataFrame:
    """Edges (u, v) with u > v that reach what ``links(u, v)`` reach: stars of each ``at_once`` links of a task."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}
        met = 0

        def top(x: int) -> int:
            while (p := above.get(x, x)) != x:
                above[x] = above.get(p, p)
                x = above[x]
            return x

        def drawn() -> pa.RecordBatch:
            nodes = list(above)
            return batch_of(schema, nodes, [top(x) for x in nodes])

        for whole in batches:
            for lo in range(0, whole.num_rows, at_once):
                batch = whole.slice(lo, at_once)
                if met + batch.num_rows > at_once and above:
                    yield drawn()
                    above, met = {}, 0
                met += batch.num_rows
                for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    u, v = top(u), top(v)
                    if u != v:
                        above[max(u, v)] = min(u, v)
        if above:
            yield drawn()

    return links.mapInArrow(run, "u bigint, v bigint")


def _contract(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with u > v."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(lowest, "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v"))
    roots = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(roots, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(roots.select("u", F.col("m").alias("v"))).distinct()


def _is_settled(edges: DataFrame) -> bool:
    """Whether every node points to one node alone, which points nowhere."""
    ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """``links(u, v)`` to (node, root): root is the smallest node that the node reaches.

    Nodes without a link are left out. Links stay on the executors; each round
    is a written table, and rounds follow the logarithm of the longest path. Up to
    ``_AT_ONCE`` links are one task's stars, which need no round.
    """
    uneven = links.where("u <> v").select("u", "v")
    if uneven.count() <= _AT_ONCE:
        edges = store(_stars(uneven.coalesce(1), _AT_ONCE), "edges")
    else:
        edges = store(_stars(uneven, _AT_ONCE).distinct(), "edges")
        while not _is_settled(edges):
            before, edges = edges, store(_contract(edges), "edges")
            release(before)
    own = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return own.union(own.select(F.col("root").alias("node"), "root").distinct())
