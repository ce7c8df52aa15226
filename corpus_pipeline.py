"""A corpus pipeline of five stages over ``documents``.

Each stage reads what the one before it kept, as Parquet. All but the last
return the columns of documents: ``doc_id, text, lang, source, n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import jaccard, packing, quality, rules, substring
from scorelake.llm._io import place_of, release, store, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that the classifier scores under one half.

    Every row is judged by its own text, so rows with a null or repeated doc_id
    stay or go by themselves. Null and empty texts are scored from zero
    statistics. Without usable labels every score is one half and every row stays.
    """
    scored = quality.with_scores(docs.select(*COLUMNS), _labels(spark, sf_dir))
    return scored.where("score >= 0.5").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that the quality rules do not keep.

    Null, empty and short texts fail the base rules and go. Rows are never
    merged: repeated rows all stay or all go.
    """
    return rules.quality_rules(docs.select(*COLUMNS), _labels(spark, sf_dir)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest doc_id, null ids last, any one of equal rows.

    Rows are grouped by their texts alone; different texts with one doc_id are
    different documents. Null and blank texts are in no group and stay.
    """
    return jaccard.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 35 words that stand elsewhere too; a text that loses nothing stays as it is.

    Every row stays, also one whose text becomes empty; repeated rows lose all
    their windows. Null texts stay null, with a null n_chars.
    """
    cut = substring.remove_repeats(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all token pieces in sequences of 2048; a null or empty text is one piece of its end id.

    Rows with a null or repeated doc_id are packed each by itself.
    """
    return packing.best_fit_packing(docs.select("doc_id", "text"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]

#: The classifier, the ratios and the tokens are not expressible in SQL; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written to the shared folder and read again.

    What a stage wrote for itself, and the rows that it read, are deleted once its
    own rows are written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        before = written()
        kept = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            stored = store(kept, name.replace(" ", "-"))
            release(*(written() - before - {place_of(stored)}), docs)
            kept = stored
        docs = kept
    return docs
