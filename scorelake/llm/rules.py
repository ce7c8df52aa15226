"""Quality rules: surface counts and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Two multinomials over hashed words and word pairs are counted, one over the
trusted target and one over the raw corpus. A document's score is the sum of
the log ratios of its n-grams' buckets divided by their number; every document
whose score reaches the threshold is kept, every other one is not.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The words of the contract, and the surface signs that are counted.
_GAP = r"[\x20\x09-\x0D]+"
_INK = r"[^\x20\x09-\x0D]"
_SYMBOLS = r"[#*$%&|<>]"
_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), _GAP), "")


def _bucket(value: Column, buckets: int) -> Column:
    return F.pmod(value, F.lit(buckets))


def _pairs(hashes: Column, f: Callable[[Column], Column]) -> Column:
    n = F.size(hashes)
    return F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: f(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1))))).otherwise(F.array().cast("array<bigint>"))


def _window_hash(hashes: list[Column]) -> Column:
    return F.xxhash64(*hashes)


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def buckets_of(text: Column, buckets: int) -> Column:
    """The buckets of a text's words and of its pairs of neighbouring words."""
    return let(_hashes(words_of(text)), lambda h: F.concat(F.transform(h, lambda x: _bucket(x, buckets)), _pairs(h, lambda x: _bucket(x, buckets))))


def log_ratios(docs: DataFrame, target: DataFrame, buckets: int = 1 << 14, alpha: float = 1.0) -> list[float]:
    """log(p_target / p_raw) of each bucket, with ``alpha`` added to all counts.

    ``docs(doc_id, text)`` is the raw corpus, ``target(doc_id)`` names the
    trusted rows in it. Counts cover every row; only ``buckets`` sums leave the
    executors. An empty target gives zeros, so every score is zero.
    """
    trusted = target.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().withColumn("_trusted", F.lit(1))
    marked = docs.select("doc_id", "text").join(trusted.hint("merge"), "doc_id", "left")  # the target grows with the corpus: never broadcast
    counted = (
        marked.select(F.coalesce("_trusted", F.lit(0)).cast("bigint").alias("t"), F.explode(buckets_of(F.col("text"), buckets)).alias("bucket"))
        .groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("trusted"))
    )
    raw, good = [0] * buckets, [0] * buckets
    for r in counted.collect():  # one row a bucket
        raw[r.bucket], good[r.bucket] = r.raw, r.trusted
    all_raw, all_good = sum(raw) + alpha * buckets, sum(good) + alpha * buckets
    if not sum(good):
        return [0.0] * buckets
    return [round(math.log((g + alpha) / all_good) - math.log((n + alpha) / all_raw), 6) for g, n in zip(good, raw, strict=True)]


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words covered by windows of five words that occur twice or more in the text.

    Windows are sorted by hash; those with an equal neighbour are sorted again by
    their words, and neighbours that are equal then are repeats. So neither a text's
    length nor windows with one hash change the count.
    """
    five = lambda i: [F.get(hashes, i + k) for k in range(5)]
    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - 5), lambda i: _window_hash(five(i)))

    def neighbours(rows: Column, field: str) -> Column:
        """Rows of a sorted array that have their field in common with the row before or after."""
        at = lambda j: F.get(rows, j)[field]
        return F.filter(rows, lambda x, j: (F.when(j > 0, at(j - 1) == x[field]).otherwise(False)) | (F.when(j < F.size(rows) - 1, at(j + 1) == x[field]).otherwise(False)))

    def covered(alike: Column) -> Column:
        spelt = F.sort_array(F.transform(alike, lambda x: F.struct(F.slice(words, x["i"] + 1, F.lit(5)).alias("w"), x["i"].alias("i"))))
        starts = let(spelt, lambda rows: F.array_sort(F.transform(neighbours(rows, "w"), lambda x: x["i"])))
        step = lambda acc, s: F.struct((acc["n"] + s + 5 - F.greatest(s, acc["end"])).alias("n"), (s + 5).alias("end"))
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"])

    def found(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        alike = let(ordered, lambda rows: neighbours(rows, "h"))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(alike, covered))

    return F.when(F.size(words) < 6, F.lit(0)).otherwise(let(windows, found))


def _judged(text: Column, ratios: list[float], threshold: float, least_words: int, most_repeated: int) -> Column:
    """The counts, score and verdict of a text, as one struct.

    Everything is bound inside one expression: a filter on one of its fields that
    the optimizer moves computes it once more at most.
    """
    n = len(ratios)
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")  # folded to a literal
    whole = F.coalesce(text.cast("string"), F.lit(""))
    inked = F.filter(F.split(whole, "\n"), lambda x: x.rlike(_INK))
    ratio = lambda x: F.get(table, _bucket(x, n).cast("int"))

    def scored(h: Column) -> Column:
        ones = F.aggregate(h, F.lit(0.0), lambda acc, x: acc + ratio(x))
        twos = F.aggregate(F.sequence(F.lit(0), F.size(h) - 2), F.lit(0.0), lambda acc, i: acc + ratio(F.xxhash64(F.get(h, i), F.get(h, i + 1))))
        return F.round((ones + F.when(F.size(h) > 1, twos).otherwise(0.0)) / F.greatest(2 * F.size(h) - 1, F.lit(1)), 6)

    def counted(w: Column, h: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            F.regexp_count(whole, F.lit(_SYMBOLS)).cast("bigint").alias("n_symbols"),
            let(inked, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            _repeat_words(w, h).cast("bigint").alias("n_repeat_words"),
            scored(h).alias("score"),
        )

    def verdict(c: Column) -> Column:
        failed = (c["n_words"] < least_words) | (100 * c["n_repeat_words"] > most_repeated * c["n_words"])
        return F.struct(*(c[k].alias(k) for k in _FIELDS[:6]), failed.alias("base_failed"), (~failed & (c["score"] >= threshold)).alias("kept"))

    return let(words_of(text), lambda w: let(_hashes(w), lambda h: let(counted(w, h), verdict)))


def with_rules(docs: DataFrame, ratios: list[float], threshold: float = -0.1, least_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed and kept.

    base_failed: fewer than ``least_words`` words, or more than
    ``most_repeated`` per cent of them in repeated windows. kept: not
    base_failed and a score of ``threshold`` or more. Null and empty texts have
    zero counts and fail. Columns of ``docs`` with these names are replaced;
    rows are never dropped or merged.
    """
    others = [c for c in docs.columns if c not in _FIELDS]
    name = "rules_" + "_".join(docs.columns)  # no column of docs has this name
    judged = docs.withColumn(name, _judged(F.col("text"), ratios, threshold, least_words, most_repeated))
    return judged.select(*(F.col(f"`{c}`") for c in others), *(F.col(f"`{name}`")[c].alias(c) for c in _FIELDS))


def quality_rules(docs: DataFrame, labels: DataFrame, **settings: float) -> DataFrame:
    """Fit the ratios with the rows of ``labels(doc_id, quality)`` marked 1 as the target, and judge every row.

    A doc_id that is marked 1 at least once is in the target, once, with every row
    that has it; null ids and null labels are not. Without a target all
    ratios and scores are 0, so the base rules alone decide.
    """
    ratios = log_ratios(docs, labels.where(F.col("quality") == 1))
    return with_rules(docs, ratios, **settings)
