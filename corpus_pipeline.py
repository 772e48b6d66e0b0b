"""From raw documents to token ids: five stages, each a table to a table.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. ``run`` writes each
stage's result as Parquet in the shared folder and reads it again, so a lost executor
repeats part of one stage at most. All stages but the last return the columns of
``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm import byte_bpe, line_dedup, mixing, simhash, toxicity
from veilwork.llm.common import documents, stash, unpacked
from veilwork.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model finds toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, labels)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in the last of them only; no document goes."""
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return line_dedup.cut_lines(docs).select(*[own.get(c, v) for c, v in zip(docs.columns, unpacked(docs.columns))])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their fingerprints the one with the smallest doc_id stays."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those that it doesn't take go."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of what they decode to."""
    return byte_bpe.encode(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level bpe", encode),
]

#: Hashes of shingles and byte-pair merges have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
