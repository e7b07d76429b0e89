"""Corpus pipeline: quality classifier, quality rules, line dedup, near dedup, packing.

STAGES is a list of (name, function(spark, docs, sf_dir) -> DataFrame). Each stage is written as Parquet
and read again as the next one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import line_dedup as lines
from tallyforge.llm import packing, quality_classifier, quality_rules, simhash
from tallyforge.llm.common import materialize, table


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model scores 0.5 or more."""
    return quality_classifier.filter_docs(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base checks and the boosted rules.

    The rules are fitted on the labelled documents of the corpus as it came, as the classifier has already
    removed most that are labelled poor.
    """
    forest = quality_rules.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.filter_docs(docs, forest)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each without the lines that an earlier one holds within two edits; n_chars follows the text."""
    kept = lines.line_dedup(docs).drop("lines_in", "lines_out")
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.near_dedup(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every document in its length bucket's batches."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier_stage),
    ("quality_rules", quality_rules_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("packing", packing_stage),
]

#: The trained stages and hashes of SQL engines differ: SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
