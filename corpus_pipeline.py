"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing, piece encoding.

Every stage works on all rows that the one before it kept and is written as Parquet on the shared folder before the
next one reads it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import language, mixing, near_dedup, pieces
from lodestrata.llm.common import shared_dir, table
from lodestrata.llm.exact_dedup import keep_one

#: Language ID rejects texts whose language cannot be told, and those it is less sure of than this.
LEAST_SURE = 0.2
#: Rows that Spark hands to a Python worker at once: texts are long, and memory for a batch is held on both sides.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; the model learns from the rows' own labels."""
    small_batches(spark)
    model = language.train(docs)
    return language.accepted(docs, model, least=LEAST_SURE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the longest; of these the row with the smallest id."""
    small_batches(spark)
    return keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the row with the smallest id."""
    small_batches(spark)
    return near_dedup.keep_one(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated so that the domains' token totals meet the target weights; no domain shrinks."""
    return mixing.mixed(docs, mixing.train(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their piece ids."""
    small_batches(spark)
    return pieces.encode(docs, kept=False)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_domains),
    ("sentencepiece", encode_pieces),
]

#: SQL expresses neither the classifiers nor the fingerprints; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
