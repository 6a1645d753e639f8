"""The queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm import chat, decontaminate, exact_dedup, language, near_dedup, packing, pii, shards, urls, wordpiece
from lakeloom.llm.common import read_table

#: In production the secret comes from a secret store; the query's results must be repeatable.
PII_SECRET = "lakeloom surrogate key 1"


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(read_table(spark, sf_dir, "documents"), PII_SECRET)


def op3_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair_conversations(read_table(spark, sf_dir, "conversations"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shards.write_shards(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return shards.read_shards(spark, path)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(read_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read_table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontaminate, op2_surrogates, op3_role_repair, op4_language, op5_exact_dedup, op6_token_shards, op7_packing, op8_near_dedup, op9_token_counts, op10_url_filter, pipeline)
}

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS normal FROM documents),
        g AS (SELECT doc_id, normal, first_value(doc_id) OVER (PARTITION BY normal ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY normal) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(normal) AS text_sha256 FROM g""",
}
