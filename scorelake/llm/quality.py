"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

Documents become a few statistics in one pass over their bytes. The Gaussian
kernel over them is approximated by cosines of fixed random projections. Every
partition sums its own normal equations; the sums meet by rounds of tasks and one
fixed-size system is solved on the driver. Ridge scores are calibrated by
isotonic regression on a fixed number of bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _scan
from ._io import batch_of, row_slices, store, text_buffers

_LOWER, _UPPER, _DIGIT, _SPACE, _NEWLINE, _SYMBOL, _PIPE, _BANG, _STOP, _PUNCT, _HIGH, _CONTROL = range(12)
_CLASS = np.full(256, _PUNCT, np.uint8)
_CLASS[:32] = _CONTROL
_CLASS[127] = _CONTROL
_CLASS[[9, 11, 12, 13, 32]] = _SPACE
_CLASS[10] = _NEWLINE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _UPPER
_CLASS[97:123] = _LOWER
_CLASS[[ord(c) for c in "#*$%&<>"]] = _SYMBOL
_CLASS[ord("|")] = _PIPE
_CLASS[ord("!")] = _BANG
_CLASS[[ord(c) for c in ".,;:?"]] = _STOP
_CLASS[128:] = _HIGH

_SLICE = 2 << 20
#: Partition sums that one task adds up; with more of them they meet in several rounds.
_FAN_IN = 64

#: Statistics of a document, in order.
STATISTICS = ("lower", "upper", "digit", "space", "newline", "symbol", "pipe", "bang", "stop", "punct", "high", "control", "log_words", "word_length", "word_spread", "log_longest", "distinct", "adjacent", "line_words")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``STATISTICS`` for each text; an empty text has zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, len(STATISTICS)))
    if not len(data):
        return out
    sizes = np.diff(offsets)
    rows = np.repeat(np.arange(n) * 16, sizes)
    counts = np.bincount(rows + _CLASS[data], minlength=16 * n).reshape(n, 16)[:, :12]
    out[:, :12] = counts / np.maximum(sizes, 1)[:, None]
    starts, ends, reach = _scan.word_bounds(data, offsets)
    words = np.diff(reach)
    some = np.maximum(words, 1)
    doc = np.repeat(np.arange(n), words)
    length = (ends - starts).astype(np.float64)
    hashes = _scan.slice_hashes(data, starts, ends)
    mean = np.bincount(doc, length, n) / some
    out[:, 12] = np.log1p(words)
    out[:, 13] = mean
    out[:, 14] = np.sqrt(np.maximum(np.bincount(doc, length * length, n) / some - mean * mean, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    out[:, 15] = np.log1p(longest)
    codes, _ = pd.factorize(hashes ^ _scan.mix(doc.astype(np.uint64) + np.uint64(1)))
    fresh = np.zeros(len(codes), bool)
    if len(codes):
        fresh[np.unique(codes, return_index=True)[1]] = True
    out[:, 16] = np.bincount(doc, fresh, n) / some
    same = np.zeros(len(doc))
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    out[:, 17] = np.bincount(doc, same, n) / some
    out[:, 18] = np.log1p(words / (1 + counts[:, _NEWLINE]))
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to (doc_id, stats array<double>) over whole texts; null texts are empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("stats", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for lo, hi in row_slices(offsets, _SLICE):
                own = offsets[lo : hi + 1]
                x = statistics(data[own[0] : own[-1]], own - own[0])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield batch_of(schema, batch.column(0).slice(lo, hi - lo), lists)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass(frozen=True)
class Classifier:
    """A fitted model; its size depends on ``features`` alone."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        out = np.ones((len(x), self.weights.shape[1] + 1))
        out[:, 1:] = np.cos(z @ self.weights + self.phases) * np.sqrt(2 / self.weights.shape[1])
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.clip(self.features(x) @ self.beta, -1, 2)
        return np.clip(np.interp(raw, self.knots, self.values), 0, 1)


def isotonic(weights: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit of ``means`` with ``weights``."""
    pools: list[list[float]] = []
    for w, m in zip(weights, means, strict=True):
        pools.append([w, m, 1])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            w2, m2, n2 = pools.pop()
            w1, m1, n1 = pools.pop()
            pools.append([w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), n1 + n2])
    return np.repeat([p[1] for p in pools], [int(p[2]) for p in pools])


def _summed(rows: DataFrame, width: int, of: object) -> np.ndarray:
    """Sum over all rows of ``of(x, y)``, a vector of ``width``: by partition, then ``_FAN_IN`` sums a task, then here.

    Sums are added in tasks until at most ``_FAN_IN`` are left, so the driver never
    gets one from every partition.
    """
    schema = pa.schema([("part", pa.int32()), ("total", pa.binary())])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros(width), False
        for batch in batches:
            if batch.num_rows:
                any_row = True
                total += of(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False))
        if any_row:
            yield batch_of(schema, [TaskContext.get().partitionId()], [total.tobytes()])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros(width), False
        for batch in batches:
            for value in batch.column(1):
                total += np.frombuffer(value.as_py())
                any_row = True
        if any_row:
            yield batch_of(schema, [TaskContext.get().partitionId()], [total.tobytes()])

    sums = rows.select("stats", "y").mapInArrow(first, "part int, total binary")
    left = rows.rdd.getNumPartitions()
    while left > _FAN_IN:
        left = -(-left // _FAN_IN)
        sums = sums.repartitionById(left, F.col("part")).mapInArrow(second, "part int, total binary")
    return sum((np.frombuffer(r.total) for r in sums.orderBy("part").collect()), np.zeros(width))


def fit(training: DataFrame, features: int = 256, gamma: float = 0.04, ridge: float = 1e-3, bins: int = 1024, seed: int = 7) -> Classifier:
    """Fit on all rows of ``training(stats, y)``; y is 0 to 1.

    Without rows every score is 1/2. ``ridge`` is a share of the number of rows.
    """
    d = len(STATISTICS)
    moments = _summed(training, 2 * d + 1, lambda x, y: np.concatenate(([len(x)], x.sum(0), (x * x).sum(0))))
    n = moments[0]
    rng = np.random.default_rng(seed)
    weights = rng.normal(0, np.sqrt(2 * gamma), (d, features))
    phases = rng.uniform(0, 2 * np.pi, features)
    flat = Classifier(np.zeros(d), np.ones(d), weights, phases, np.zeros(features + 1), np.array([-1.0, 2.0]), np.array([0.5, 0.5]))
    if not n:
        return flat
    mean = moments[1 : d + 1] / n
    deviation = np.sqrt(np.maximum(moments[d + 1 :] / n - mean**2, 0))
    model = Classifier(mean, np.where(deviation > 1e-9, deviation, 1.0), weights, phases, flat.beta, flat.knots, flat.values)
    m = features + 1

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.concatenate(((z.T @ z).ravel(), z.T @ y))

    sums = _summed(training, m * m + m, equations)
    penalty = np.full(m, ridge * n)
    penalty[0] = 0
    beta = np.linalg.solve(sums[: m * m].reshape(m, m) + np.diag(penalty + 1e-9 * n), sums[m * m :])
    model = Classifier(mean, model.scale, weights, phases, beta, flat.knots, flat.values)

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        raw = np.clip(model.features(x) @ beta, -1, 2)
        at = np.minimum(((raw + 1) / 3 * bins).astype(np.int64), bins - 1)
        return np.concatenate((np.bincount(at, minlength=bins), np.bincount(at, y, bins), np.bincount(at, raw, bins)))

    count, hits, total = _summed(training, 3 * bins, binned).reshape(3, bins)
    used = np.flatnonzero(count > 0.5)
    values = isotonic(count[used], hits[used] / count[used])
    return Classifier(mean, model.scale, weights, phases, beta, total[used] / count[used], values)


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 3; rows with 1 are held out (null ids are not)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0))


def score(stats: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, stats) to doc_id, held_out, score, predicted."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch_of(schema, batch.column(0), np.round(model.score(_matrix(batch.column(1))), 9))

    rows = stats.select("doc_id", "stats").mapInArrow(run, "doc_id bigint, score double")
    return rows.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _marks(labels: DataFrame) -> DataFrame:
    """(doc_id, y): the mean quality of each labelled doc_id outside the held-out third."""
    return (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold(F.col("doc_id")) != 1))
        .groupBy("doc_id").agg(F.avg("y").alias("y"))
    )


def quality_scores(docs: DataFrame, labels: DataFrame, **settings: float) -> DataFrame:
    """Score every row of ``docs(doc_id, text)`` as ``labels(doc_id, quality)`` marks quality.

    Only labels outside the held-out third are learnt; a doc_id labelled more
    than once counts once, by its mean; null labels are left out; a doc_id that
    several rows have is learnt from each of them. Scores never
    see labels, ids or other columns. Null and empty texts are scored from
    zero statistics; null and repeated doc_ids are kept.
    """
    stats = store(with_statistics(docs), "statistics")
    training = store(stats.join(_marks(labels), "doc_id").select("stats", "y"), "training")
    return score(stats, fit(training, **settings))


def with_scores(docs: DataFrame, labels: DataFrame, **settings: float) -> DataFrame:
    """``docs(doc_id, text, ...)``, each row with its own score; fitted as in ``quality_scores``.

    A row's verdict follows from its text alone, so it needs no join back: rows
    with a null or a repeated doc_id have their own scores. A column named score
    is replaced.
    """
    stats = with_statistics(docs)
    training = store(stats.join(_marks(labels), "doc_id").select("stats", "y"), "training")
    model = fit(training, **settings)
    others = [c for c in docs.columns if c not in ("score", "text")]
    own = docs.select(*(F.col(f"`{c}`") for c in others), F.col("text").cast("string").alias("text"))
    names = [*others, "text", "score"]
    schema = ", ".join([f"`{c}` {t}" for c, t in own.dtypes] + ["score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(len(others)))
            for lo, hi in row_slices(offsets, _SLICE):
                own_offsets = offsets[lo : hi + 1]
                x = statistics(data[own_offsets[0] : own_offsets[-1]], own_offsets - own_offsets[0])
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.round(model.score(x), 9))], names=names)

    return own.mapInArrow(run, schema).select(*(F.col(f"`{c}`") for c in docs.columns if c != "score"), "score")
