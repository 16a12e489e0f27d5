"""A training corpus from ``documents``: five stages, each one operator, a table between them.

A stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps, with the
columns of ``documents``; the last returns token ids. Columns beyond those that a
stage works on pass through.

Documents of null, empty or letterless text go in the first stage, a very long one is
worked on whole, and empty tables pass as such. Rows of a null or an equal id are judged
apart; of rows that repeat id and text one stays. Ties go to the least id.

Stages set the size of Arrow batches on the session, and leave it set, because the
batches are made when the returned table is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewright.llm import bpe, contamination, jaccard, language, runs
from citewright.llm.shared import written

# Rows and bytes of documents that go to a Python worker at once, whatever the session
# has: batches lie in the executor and in each worker, several times over.
BATCH = {"maxRecordsPerBatch": "1000", "maxBytesPerBatch": str(4 << 20)}


def _small_batches(spark: SparkSession) -> None:
    for name, value in BATCH.items():
        spark.conf.set(f"spark.sql.execution.arrow.{name}", value)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of the learned ones."""
    _small_batches(spark)
    model = language.learn(docs, public_tokenizers.path("piece_bpe_32k.model"))
    # The text travels once; the other columns are carried in a struct, where no name clashes.
    others = [name for name in docs.columns if name.lower() != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{name}`") for name in others]).alias("carried"), F.col("text").cast("string").alias("text"))
    found = language.identify(rows, model).filter(F.col("lang_pred") != language.UNKNOWN)
    return found.select(*[F.col("text").alias(name) if name.lower() == "text" else F.col("carried")[name].alias(name) for name in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id: sets of five-word
    shingles with a similarity of 0.8. (The ``op2`` query keeps four words and 0.85.)"""
    _small_batches(spark)
    return jaccard.one_of_each(docs, size=5, share=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; ``n_chars`` follows."""
    _small_batches(spark)
    cleaned = runs.cleaned(docs)
    counted = F.when(F.col("text").isNotNull(), F.length("text").cast("long"))
    return cleaned.withColumn("n_chars", counted) if "n_chars" in docs.columns else cleaned


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination.without(docs, items)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids, exact``: token ids, and whether they decode to the text."""
    _small_batches(spark)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select("doc_id", "lang", "source", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    both = bpe.round_trip(rows, ranks, public_tokenizers.PATTERN, by_words=True)
    exact = (F.col("decoded") == F.col("text").cast("binary")).alias("exact")
    return both.select("doc_id", "lang", "source", "n_tokens", "ids", exact)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("byte_bpe", tokens),
]

# Language scores have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
