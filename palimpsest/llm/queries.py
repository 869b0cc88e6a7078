"""The registered queries of the training-data operators: thin contracts over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import audio, chat, common, fingerprint, licenses, mixing, neardup, packing, quality, secrets, tokens


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(common.table(spark, sf_dir, "documents"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(common.table(spark, sf_dir, "documents")).drop("found")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count(common.table(spark, sf_dir, "documents"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(common.table(spark, sf_dir, "documents"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.encode(common.table(spark, sf_dir, "documents"), keep_media=False).drop("seek")


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edits(common.table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "shards")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(common.table(spark, sf_dir, "documents")).drop("row")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    traffic = chat.as_tool_traffic(common.table(spark, sf_dir, "conversations"))
    return chat.link(traffic, chat.RESPOND)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_classifier, op2_best_fit_packing, op3_secret_scans, op4_token_counts, op5_license_scans, op6_media_columns, op7_document_fingerprints, op8_mixing, op9_minhash_near_dedup, op10_chat_formatting)}
