"""From raw documents to token files: identify the language, drop near copies and benchmark texts, mix sources, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarterlight.llm import decontaminate, language_id, mixing, near_dup, token_files
from quarterlight.llm.common import save, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected."""
    return language_id.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dup.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, number and checksum of each document's ids, read back from the token files."""
    return token_files.token_digests(docs)


STAGES = [
    ("language_id", identify),
    ("near_dup", deduplicate),
    ("decontaminate", clean),
    ("mix_sources", mix),
    ("token_files", encode),
]

#: Compression, signatures and tokenizers aren't SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
