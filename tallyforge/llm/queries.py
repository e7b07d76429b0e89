"""Registered queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_rules, train

    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, train(docs, table(spark, sf_dir, "labels")))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify, train

    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op6_quality_classifier": op6_quality_classifier,
}

ORACLE_SQL: dict[str, str] = {}


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_in", "lines_out")


QUERIES["op8_line_dedup"] = op8_line_dedup


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import render

    return render(table(spark, sf_dir, "conversations"))


QUERIES["op10_packing"] = op10_packing
QUERIES["op4_chat_format"] = op4_chat_format


def _oracles() -> None:
    from . import centroids, chat_format, fill_in_middle, line_dedup

    ORACLE_SQL["op4_chat_format"] = chat_format.ORACLE
    ORACLE_SQL["op8_line_dedup"] = line_dedup.ORACLE
    ORACLE_SQL["op12_fill_in_middle"] = fill_in_middle.ORACLE
    ORACLE_SQL["op13_centroid_clustering"] = centroids.ORACLE


_oracles()


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify, train

    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES["op9_toxicity"] = op9_toxicity


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import clean_vectors, search

    vectors = clean_vectors(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where("vec_id % 100 = 0"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


QUERIES["op5_nearest_neighbours"] = op5_nearest_neighbours
QUERIES["op7_html_extraction"] = op7_html_extraction


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .sentencepiece_codec import encode

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return encode(docs, decoded=True).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), same.alias("round_trip"))


QUERIES["op2_sentencepiece"] = op2_sentencepiece


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import digests

    return digests(table(spark, sf_dir, "documents"))


QUERIES["op12_fill_in_middle"] = op12_fill_in_middle


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster

    return cluster(table(spark, sf_dir, "embeddings"))


QUERIES["op13_centroid_clustering"] = op13_centroid_clustering


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(table(spark, sf_dir, "documents")).drop("found")


QUERIES["op11_license_scan"] = op11_license_scan
