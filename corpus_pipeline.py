"""Documents to tokens in five stages, each a DataFrame to a DataFrame.

A stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but
the last return the columns of documents. ``run`` writes each stage as Parquet in the
cluster's shared folder and reads it again, so a lost executor costs at most a stage.

Quality rules use ``labels`` to learn and drop what they reject; exact and near dedup
leave one document of each group; mixing repeats and drops words of documents to meet
the sources' targets, one row per pass over a document; encoding returns a document's
token count and digests of its ids and of the text decoded from them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clientpulse.llm import bpe, exact_dedup, minhash, mixing, quality
from clientpulse.llm.common import Scratch

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: The executors' JVMs have grown over four stages when the last one starts.
ENCODER_SHARE = 0.2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digest_table(docs, RANKS, public_tokenizers.PATTERN, share=ENCODER_SHARE)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: SQL can express neither the learned rules nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
