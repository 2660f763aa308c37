"""A training-data pipeline over the table documents: each stage calls one operator, its rows are written and read again.

Documents without a recognisable language go, one document of each group of near duplicates stays, secrets are replaced,
sources are mixed to their target weights (whole documents, repeated by epoch), and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import bpe, language_mixture, mixing, order_minhash, secrets
from weftline.llm.common import ship, table, write_table
from weftline.llm.queries import vocabulary_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_mixture.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.drop_near_duplicates(docs)


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_digests(docs, vocabulary_path())


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", replace_secrets),
    ("mix_sources", mix_sources),
    ("bpe_encoding", encode),
]

#: Near-duplicate search, language models and encoding aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
