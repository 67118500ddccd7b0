"""From raw documents to sampled piece ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkgauge.llm import exact_dedup, lang_id, minhash_join, mixing, piece_sampling
from inkgauge.llm.common import stage, table


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the labels know; what no language explains goes."""
    return lang_id.in_a_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, the one with the largest id."""
    return exact_dedup.without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; copies are linked from 0.85, as in op4."""
    return minhash_join.without_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document comes up to twice."""
    return mixing.mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids of a sampled segmentation, their number, and whether decoding gave the text back."""
    return piece_sampling.encode(docs)


STAGES = [
    ("language_id", languages), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("piece_sampling", pieces),
]
#: Language, near copies, the mix and the sampling have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
