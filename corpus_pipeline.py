"""A corpus pipeline: language ID, line dedup, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; its result is written as Parquet and read again. All stages but the last
give the columns of documents and ignore others. A null in any column but text
changes nothing; repeated rows and ids are rows like any other unless a stage
says otherwise; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from nomoform.llm import langid, linededup, packing, secrets, simhash
from nomoform.llm.common import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones go, and with them null texts and texts without letters."""
    small_batches(spark)
    return langid.keep_identified(docs.select(COLUMNS), langid.train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of lines that occurred before; one that loses lines and has no word left goes.

    A null text stays. Rows with equal doc_id and text count as one and lose nothing to each other.
    """
    kept = linededup.passage_dedup(docs.select(COLUMNS))
    changed = kept.where((F.col("n_removed_lines") == 0) | F.col("text").rlike(linededup.WORDED))
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the smallest doc_id, nulls last, then a hash of the row; null texts are a group."""
    small_batches(spark)
    return simhash.keep_one(docs.select(COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark; null texts stay null."""
    clean = secrets.redact(docs.select(COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences; a null text is empty, one piece with the end id."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), added=True)


def small_batches(spark: SparkSession) -> None:
    """Batches of whole texts for Python workers: few rows, as one text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language ID learns its model, which SQL cannot; tests hold each stage against a brute-force version.
ORACLE_SQL = None
