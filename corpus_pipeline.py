"""The corpus pipeline: documents through five stages, each stored and read again as the next one's input.

1. language: documents without a language (no letter in them) go; profiles are learned from the labelled ones.
2. quality: documents that fail the base counts or repeat themselves too much go.
3. near-duplicates: of each group of SimHash neighbours the document with the smallest id stays.
4. mix: sources are mixed to their target weights; a document may come once or twice, whole or in part.
5. packing: what is left becomes sequences of at most 2048 tokens.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from aislefix.llm import language, mixing, packing, repetition, simhash
from aislefix.sources.tables import materialize

TOKENIZER = "byte_bpe_50k.json"
#: Blocks of the mix: long enough that a part of a document still reads as one.
MIX = mixing.MixSettings(block_words=256, shard_slots=4096)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    profiles = language.fit_profiles(docs.where(~language.held_out(F.col("doc_id"))))
    return language.keep_known_languages(docs, profiles)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repetition.keep_by_repetition(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each_group(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs, settings=MIX)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("near-duplicates", without_near_copies),
    ("mix", mixed_sources),
    ("packing", packed),
]

# Profiles, 64-bit XXH64 majorities and byte-level merges cannot be said in SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
