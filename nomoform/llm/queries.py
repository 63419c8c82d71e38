"""The registered queries of the text operators: each applies one to its whole table.

Null columns, empty and very long texts, ties, repeated rows and empty tables
give what the operator's own docstring says; only the columns that an operator
names are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, chat, collocations, langid, linededup, ngramjoin, orderhash, packing, quality, secrets, simhash, suffixdedup, whitening
from .sql import ORACLES

RANKS = "byte_bpe_50k.tiktoken"
VOCABULARY = "byte_bpe_50k.json"


def _documents(spark: SparkSession, sf_dir: str, rows: int | None = 512) -> DataFrame:
    """The documents; ``rows`` bounds the batches of texts that Python workers get."""
    if rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = langid.identify(docs, langid.train(docs))
    return found.withColumn("held_out", F.expr("crc32(cast(doc_id as string)) % 5 = 0")).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_documents(spark, sf_dir, None))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(text).alias("text"))
                    for i, role in enumerate(("user", "assistant"))
                ]
            )
        ).alias("t")
    )
    return chat.digest(*chat.formatted_parts(turns.unionByName(extra.select("t.*"))))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return suffixdedup.digest(suffixdedup.suffix_dedup(docs))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(_documents(spark, sf_dir)))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secret_scan(_documents(spark, sf_dir, None)))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderhash.order_minhash(_documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), added=True)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(RANKS)
    docs = _documents(spark, sf_dir)
    return bpe.digest(bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN), ranks)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.line_dedup(_documents(spark, sf_dir, None).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.ngram_join(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_language_id, op2_quality_rules, op3_chat_formatting, op4_suffix_dedup, op5_simhash_near_dedup,
            op6_secret_scan, op7_order_minhash, op8_packing, op9_byte_bpe, op10_line_dedup,
            op11_embedding_whitening, op12_phrase_collocations, op13_ngram_jaccard_join,
        )
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
