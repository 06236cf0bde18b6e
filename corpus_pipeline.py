"""From raw documents to token ids: five stages, each one operator of ``textveil.llm``.

A stage takes ``(spark, docs, sf_dir)`` and returns what it keeps; it is written as Parquet
and read again for the next. All stages but the last return the columns of ``documents``.
Where a stage changes ``text`` and there is a column ``n_chars``, that follows. Further columns
are carried along, whatever their names.

Null and empty texts are rejected by the first stage. Rows that repeat ``doc_id`` and ``text``
are one document, of which one row stays. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.llm import bpe, decontaminate, jaccard_join, language_id, line_dedup
from textveil.plans.storage import stage

LEAST_PHRASE = 2.0  # bytes: shorter phrases on average mean that no known language fits


def _with_text(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without letters and texts that no labelled language explains."""
    training = docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select("text", "lang")
    found = language_id.identify_language(docs, training)
    fits = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("phrase_bytes") >= LEAST_PHRASE)
    return found.where(fits).select("row.*")


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that repeat an earlier one; documents that had no other lines go."""
    left = line_dedup.without_duplicate_lines(docs)
    return _with_text(left.where(F.col("text").rlike(r"\S")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 % of their five-word shingles the first one stays."""
    kept = jaccard_join.similar_documents(docs).where("kept").select("row.*")
    return kept.dropDuplicates(["doc_id", "text"])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out; documents that were nothing else go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    clean = decontaminate.Decontaminator(benchmark).clean(F.col("text"))
    return _with_text(docs.withColumn("text", clean).where(F.col("text").rlike(r"\S")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether they decode to the text."""
    codec = bpe.Codec(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    both = docs.select("doc_id", "text", codec.round_trip(F.col("text")).alias("r"))
    return both.select("doc_id", F.size("r.ids").cast("long").alias("n_tokens"), "r.ids",
                       (F.col("r.decoded") == F.col("text").cast("binary")).alias("round_trip"))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", distinct_lines),
    ("jaccard_join", one_of_each_group),
    ("decontaminate", without_benchmark),
    ("bpe", encoded),
]

ORACLE_SQL = None  # no SQL for cross-parsing or BPE; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
