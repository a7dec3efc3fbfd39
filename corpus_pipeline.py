"""Corpus pipeline: from raw documents to a training mix, each stage written and read again.

Counted as part of the training-data subpackage. STAGES are functions of (spark, docs, sf_dir); all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from depmatrix.llm import decontamination, mixing, quality_classifier, quality_rules, simhash
from depmatrix.llm.shared import written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned list rejects go; so do null and empty texts, which have no words. Repeated rows go or stay together, rows with a
    null id are judged too but teach nothing. Empty tables: nothing is learned, no rows. Other columns, also with clashing names, stay as they are."""
    return quality_rules.keep_good(docs, _labels(spark, sf_dir))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality, by their own evidence and that of their site, go. Null text is judged as an empty one, null source or lang is a site of its
    own, repeated rows count each. No labels: the evidence is a constant. Empty table: no rows. Other columns stay as they are."""
    return quality_classifier.keep_good(docs, _labels(spark, sf_dir))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest doc_id. Null and empty texts are near duplicates of one another; rows with a null
    id stay; of rows that share id and group one stays, rows that share an id but not the group are judged each. Empty table: no rows. Other columns stay as they are."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none and stay, repeated rows go or stay together. No items or no documents: all rows that
    there are. Other columns stay as they are."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What each document gives to the mix: the columns of op8. Null text gives nothing, null source is a source of its own, repeated rows are separate documents;
    empty table: no rows; other columns aren't looked at."""
    return mixing.by_document(mixing.mix(docs))


STAGES = [
    ("quality rules", rules_stage),
    ("quality classifier", classifier_stage),
    ("simhash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The learned stages and SimHash have no SQL; tests hold the pipeline against its operators stage by stage, and against kinds of documents planted for them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last goes through a table in the shared folder. What becomes of nulls, empty and very long texts, repeated
    rows and empty tables is said in each stage; rows with a null id pass all stages that their text passes, and are rows of the result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
