"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the columns of
documents; rows with a null doc_id pass the stages that decide by id. An empty table stays empty. Stages bound the bytes of a
batch of texts, so that what a task holds does not depend on how long texts are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm import decontamination, language_id, minhash_dedup, sentencepiece_codec, substring_dedup
from tallyfield.session import bound_batches, stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that belong to no language: null texts and texts without a letter."""
    bound_batches(spark)
    profiles = language_id.train(docs)
    rows = docs.select(F.struct("*").alias("row"), F.col("text"))
    return language_id.predict(rows, profiles, ["row"]).where(F.col("lang_pred") != "und").select("row.*") if profiles.names else docs.where(F.col("text").rlike(r"\p{L}"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group that shares at least 80 % of its five-word shingles."""
    bound_batches(spark)
    groups = minhash_dedup.near_duplicates(docs, k=5, percent=80)
    gone = groups.where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages, and documents of which no word is left; n_chars follows the text."""
    bound_batches(spark)
    kept = substring_dedup.remove_repeats(docs, keep=docs.columns).where(F.expr(r"n_removed = 0 or text rlike '[^ \\t\\n\\x0B\\f\\r]'"))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left."""
    bound_batches(spark)
    return sentencepiece_codec.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_spans),
    ("decontamination", drop_benchmark_leaks),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None  # signatures, spans and pieces are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
