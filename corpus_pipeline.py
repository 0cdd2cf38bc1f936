"""The documents of a corpus in five stages: quality, near-duplicates, personal data, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import bpe, mixing, pii, quality, simhash
from foliant.llm.queries import tokenizer
from foliant.llm.storage import read_table, saved


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the policy; null and empty texts have no words and go; an empty table gives no rows."""
    return quality.keep(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group; repeated ids are one, rows without an id stay, ties go to the smallest id."""
    return simhash.keep_one(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced; null texts stay null, repeated rows are cleaned alike."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's rate says; a null source is one of its own, sources of no words give no rows."""
    return mixing.mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with token_ids of their whole texts; null: an empty list; a column of that name is replaced."""
    return bpe.encode(docs, *tokenizer())


STAGES = [("quality", quality_rules), ("simhash", simhash_dedup), ("pii", private_data), ("mixing", mix_sources), ("bpe", byte_bpe)]

#: The stages use compiled hashes, component search and BPE, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
