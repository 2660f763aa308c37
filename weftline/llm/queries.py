"""The contract queries: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat_format, hard_negatives, kneser_ney, language_mixture, licences, mixing, multi_index, order_minhash, quality, repeats, secrets, turn_repair
from .common import table

#: The vocabulary file of the encoding query.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op2_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.similar_vectors(table(spark, sf_dir, "embeddings"))


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_mixture.identify(table(spark, sf_dir, "documents"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_texts(table(spark, sf_dir, "documents"), language_mixture.held_out(7))


def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_licence_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_matches(table(spark, sf_dir, "documents"))


def op10_maximal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = chat_format.format_digests(chat_format.with_hostile(table(spark, sf_dir, "conversations")), vocabulary_path())
    return digests.drop("n_tokens")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.relabelled(table(spark, sf_dir, "embeddings")))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_digests(turn_repair.damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (op1_mix_sources, op2_quality_forest, op3_multi_index, op4_language_mixture, op5_kneser_ney, op6_bpe_tree, op7_order_minhash, op8_guess_cost, op9_licence_dice, op10_maximal_repeats, op11_chat_format, op12_hard_negatives, op13_turn_repair)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL can express."""
    return {"op1_mix_sources": mixing.MIX_SQL, "op9_licence_dice": licences.licence_sql(), "op11_chat_format": chat_format.format_sql(), "op12_hard_negatives": hard_negatives.MINE_SQL}
