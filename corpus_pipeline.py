"""A corpus from raw documents to shards: five stages, each written as Parquet and read again.

language identification -> near-duplicate removal -> benchmark decontamination -> mixing -> sharding.
Every stage works on all rows its predecessor kept; the first four return the columns of documents,
the last adds shard and slot.

Defined results: documents whose text is null or holds no letters go at the first stage; a null doc_id,
lang or source is a value like any other, but of a near-duplicate group a row with an id stays before one
without; of rows equal in every column one stays; very long texts are read whole; other columns pass through
all stages, and a table that has a column ``shard`` or ``slot`` (in any case) is refused before the first;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecloom.llm import decontaminate, language_id, mixing, sharding, simhash_dedup
from vecloom.llm.tables import table
from vecloom.plans.durable import materialize


def recognise_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; wordless texts and unrecognised ones go."""
    return language_id.keep_recognised(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, that of the smallest id."""
    return simhash_dedup.keep_one_per_component(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the source, language and topic targets."""
    return mixing.keep_sampled(docs)


def deal_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents with their shard and slot."""
    return sharding.shard_rows(docs)


STAGES = [
    ("language_id", recognise_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing_weights", mix_sources),
    ("sharding", deal_into_shards),
]

#: Learned language models, fingerprints and random draws have no SQL form; tests/llm checks run() by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    clash = {"shard", "slot"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"documents already have columns {sorted(clash)}")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
