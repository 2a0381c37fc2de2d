"""A training corpus from raw documents: each stage takes what its predecessor kept, written as Parquet and read again.

Quality rules drop documents that fail the current policy; of each group of near duplicates (connected by the n-gram Jaccard join) the document with
the least doc_id stays, and of repeated rows of a document one; documents that hold a benchmark item go; sources are mixed to target weights; what is left becomes
bit-packed token ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fathomdex.llm import decontamination, mixing, ngram_jaccard, quality_rules, token_binary
from fathomdex.sources import storage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.one_row(ngram_jaccard.keep_one(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.select(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_binary.token_binary(docs)


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("decontamination", decontaminate), ("mixing", mix), ("token_binary", tokens)]
#: SQL can express neither the tokenizer's merges nor the packing; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, before = f"{storage.scratch(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            storage.remove(spark, before)  # what it held is in its successor
        before = path
    return docs
