"""The corpus pipeline: five stages over documents, each of which keeps the columns of documents but the last.

language ID drops the documents whose language it rejects; exact and near deduplication keep one document of each group;
mixing repeats and leaves out rows so that sources meet their targets, and returns them shard by shard in the shards' own
random order; packing cuts documents into sequences, each from one run of the mix as it is stored."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lakefold.llm import exact_dedup, language_id, minhash_icws, mixing, packing
from lakefold.llm.common import forget, scratch_path


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs, language_id.fit(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_icws.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_order(mixing.mixed(docs)).select(*[f"`{c}`" for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cache=1 << 18, by_place=True)  # the stages share workers


STAGES = [
    ("language_id", known_languages),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: Classifier, stream and tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Every stage's copy of the documents goes when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            forget(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
