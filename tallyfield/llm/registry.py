"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm import chat_format, conversation_repair, decontamination, embedding_dedup, hard_negatives, language_id, license_scan, lm_scoring, minhash_dedup, secret_scan, sentencepiece_codec, substring_dedup, token_output
from tallyfield.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@_query
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Docs whose crc32(doc_id) mod 7 is 2 are held out of the training counts."""
    held_out = language_id.fold("doc_id", 7) == 2
    scored = lm_scoring.score(table(spark, sf_dir, "documents"), held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"))


@_query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@_query
def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.encode_and_read_back(table(spark, sf_dir, "documents"))


@_query
def op6_chat_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return chat_format.format_pairs(turns, chat_format.opening_pairs(turns))


SQL["op6_chat_preference"] = chat_format.SQL


@_query
def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@_query
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


@_query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op7_benchmark_decontamination"] = decontamination.sql()


@_query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.known_licenses(spark))


SQL["op10_license_scan"] = license_scan.sql()


@_query
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@_query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    return conversation_repair.digest(conversation_repair.repair(damaged))


@_query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.relabelled(hard_negatives.quantised(table(spark, sf_dir, "embeddings")))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


SQL["op11_hard_negatives"] = hard_negatives.SQL
