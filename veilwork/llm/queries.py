"""The operators as registered queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, line_dedup, media, mixing, quality, secrets, simhash, substring_dedup, token_store, toxicity
from .common import documents
from .oracles import ORACLES


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary lies; executors have the same files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(documents(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_line_words_removed",
    )


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored_documents(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = F.array_join(F.col("passes.position").cast("array<string>"), ",").alias("positions")
    return mixing.by_first_position(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken", "position", positions
    )


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir), with_pixels=False).select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        "media_bytes",
        "media_sha256",
        "feature",
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(documents(spark, sf_dir), tokenizer_file("byte_bpe_multi_50k.tiktoken"), with_ids=False)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    graded = toxicity.grade_documents(documents(spark, sf_dir), labels)
    return graded.select("doc_id", "severity", "p_toxic", "toxic")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    kept = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", kept)


def queries() -> dict:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_secrets": op2_secrets,
        "op3_simhash": op3_simhash,
        "op4_token_store": op4_token_store,
        "op5_mixing": op5_mixing,
        "op6_quality": op6_quality,
        "op7_media": op7_media,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_toxicity": op9_toxicity,
        "op10_line_dedup": op10_line_dedup,
    }


def oracle_sql() -> dict:
    return {k: v for k, v in ORACLES.items() if k in queries()}
