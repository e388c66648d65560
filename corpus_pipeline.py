"""From raw documents to a training mix: reject bad documents, drop copies, near copies and benchmark passages, mix sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlspike.llm import decontaminate, exact_dedup, mixing, near_dedup, quality
from marlspike.llm.common import written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the line field, fitted on the labelled documents, doesn't reject.

    Null and empty texts are scored as the empty text; each of repeated rows has the same score; long texts count whole. An
    empty table stays empty. This holds for all stages: columns beside doc_id, text and source don't matter, and come out as they went in."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal texts, the one with the smallest doc_id; null and empty texts are equal, and of repeated rows one stays. Long texts are compared whole."""
    return exact_dedup.drop_exact_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest doc_id; of repeated rows one stays. Texts without words, null and empty ones too, all stay. Long texts count whole."""
    return near_dedup.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark item is found. Null and empty texts hold none and stay, as do all where the benchmark is empty; repeated rows go or stay together; long texts are searched whole."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source, source_size, target, taken. A null text has size 0, a null source is one of its own; repeated rows are documents of their own; long texts are counted whole."""
    return mixing.mix(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: The classifier's and the near-duplicate stage's rows can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over all documents, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
