"""A training corpus from documents: language, repeated lines, near copies, benchmark leaks, mixture.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns
of documents; the last returns them with what the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quireflow.llm import decontaminate, langid, lines, mixing, simhash
from quireflow.llm.common import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected; those without a letter go too."""
    return langid.accepted(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document or line has; a document that loses all lines is empty."""
    return lines.dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id."""
    return simhash.dedup(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which the mix takes words, with size, source_size, target and taken."""
    return mixing.mixed(docs)


STAGES = [("language ID", language), ("line dedup", repeated_lines), ("SimHash near-dedup", near_copies), ("benchmark decontamination", benchmark_leaks), ("mixing", mixture)]

#: Learnt models and 64-bit hashes are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "documents")
    return STAGES[-1][1](spark, docs, sf_dir)
