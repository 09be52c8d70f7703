"""A corpus pipeline over the table `documents`: rules, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as the
next stage's docs. All but the last return the columns of `documents`. Null or empty texts fail the rules; rows that
repeat an id are decided on alike; an empty table passes through all stages as an empty table.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.llm import bpe, line_dedup, mixing, near_dedup, quality_rules
from paperlode.shared import shared_folder

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Near-duplicates share this part of their sets of five words or more; op10_near_dedup has a threshold of its own.
NEAR_PERCENT = 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.accepted(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines; n_chars is the text's length again."""
    return line_dedup.deduped(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.deduped(docs, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of each row."""
    return bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("quality rules", keep_good), ("line dedup", dedup_lines), ("near dedup", dedup_near), ("mixing", mix_sources), ("byte-level BPE", encode)]

#: The stages need a similarity join and a tokenizer, which SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is a table in the folder that the cluster's machines share."""
    folder, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
