"""A training corpus from raw documents: language ID, exact and near deduplication, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm import decontaminate, exact_dedup, language, near_dedup, packing
from lakeloom.llm.common import cut, read_table, temporary
from lakeloom.llm.queries import tokenizer_path


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an identified language."""
    return language.drop_unidentified(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.drop_near(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language", identified), ("exact_dedup", distinct), ("near_dedup", dissimilar), ("decontamination", uncontaminated), ("packing", packed)]

#: SQL can't express tokenisation, sketches or the language model; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that stay. Each stage's result is stored, and what the stage itself stored is deleted."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporary(spark):
            docs = cut(stage(spark, docs, sf_dir), f"stage-{name}", outer=True)
    return STAGES[-1][1](spark, docs, sf_dir)
