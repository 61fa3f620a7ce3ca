"""A cleaning pipeline over ``documents``: bad texts, near copies and benchmark texts go, secrets are blanked, the rest is encoded.

Each stage reads all rows that the one before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywatch.llm import decontam, pieces, quality, secrets, simhash
from tallywatch.llm.common import written


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labelled ones among them."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def single_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    return simhash.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark; n_chars follows the text."""
    return secrets.redact(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and the text that they decode to."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    # Written between the two, so that a task has one Python worker at a time.
    coded = written(pieces.encode(docs.select("doc_id", "lang", "source", "text"), path).drop("text"), "piece-ids")
    return pieces.decode(coded, path).select("doc_id", "lang", "source", F.col("decoded").alias("text"), F.size("piece_ids").alias("n_pieces"), "piece_ids")


STAGES = [
    ("quality classifier", good_texts),
    ("near-dedup", single_copies),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("encoding", encoded),
]

#: The trained classifier and the encoder have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again before the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
