"""The ten operators and the pipeline as queries over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_lm, exact_dedup, hilbert, language_id, minhash_icws, mixing, ogg, packing, pii_bilstm, quality_nbsvm
from .common import fold_of

VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fold(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", fold_of(F.col("doc_id")) == 0)


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard_documents(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs))
    return with_fold(found).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op3_pii_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii_bilstm.detect(docs, pii_bilstm.fit(docs))


def op4_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_nbsvm.fit(docs, table(spark, sf_dir, "labels"))
    return with_fold(quality_nbsvm.score(docs, model)).select("doc_id", "held_out", "score", "predicted")


def op5_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.features(ogg.store(table(spark, sf_dir, "documents")))


def op6_minhash_icws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_icws.near_classes(table(spark, sf_dir, "documents"))


def op7_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op8_splitting_tree_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix_counts(table(spark, sf_dir, "documents"))
    draws = F.array_join(F.transform("draws", lambda d: F.concat_ws(":", d["epoch"], d["shard"])), ",")
    return found.withColumn("draws", draws)  # epoch:shard of each


def op9_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score(table(spark, sf_dir, "documents"))


def op10_streaming_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_hilbert_sharding, op2_language_id, op3_pii_bilstm_crf, op4_quality_nbsvm, op5_ogg_media, op6_minhash_icws, op7_sum_of_squares_packing, op8_splitting_tree_mix, op9_stupid_backoff, op10_streaming_exact_dedup]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op10_streaming_exact_dedup": EXACT_COPIES}


EXACT_COPIES = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept,
       text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
