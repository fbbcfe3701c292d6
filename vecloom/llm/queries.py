"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecloom.llm import decontaminate, embedding_dedup, fill_in_middle, filter_audit, language_id, mixing, packing, sentence_dedup, sharding, simhash_dedup, token_counts, tool_calls, toxicity
from vecloom.llm.tables import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_chat_tool_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.linked_events(table(spark, sf_dir, "conversations"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.document_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_token_counts(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.document_languages(table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(table(spark, sf_dir, "embeddings"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_components(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_dedup.document_substrings(table(spark, sf_dir, "documents"))


def op9_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_mixture(table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.document_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.document_packing(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.document_filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.document_fim(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_chat_tool_linking, op3_toxicity, op4_token_counts, op5_language_id, op6_embedding_near_dedup, op7_simhash_near_dedup, op8_substring_dedup, op9_mixing_weights, op10_benchmark_decontamination, op11_packing, op12_filter_audit, op13_fill_in_middle)}
ORACLE_SQL: dict[str, str] = {"op2_chat_tool_linking": tool_calls.CONVERSATIONS_SQL, "op9_mixing_weights": mixing.mixture_sql(), "op12_filter_audit": filter_audit.AUDIT_SQL, "op13_fill_in_middle": fill_in_middle.FIM_SQL}
