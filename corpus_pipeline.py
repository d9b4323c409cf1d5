"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing to target weights, tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetwatch.llm import bpe, lines, mixing, neardup, quality
from fleetwatch.llm.common import shared_dir, words_of
from fleetwatch.llm.queries import SEED, domain_of, vocabulary, weight_table

#: Share of the tokens left that the mix takes, in one epoch: no document comes twice.
MIX_SHARE, MIX_EPOCHS = 0.8, 1
#: Near duplicates are of similarity 0.8: one shares none of 28 bands with probability 4e-7; 64 slots are six standard errors below the 90 of 112 expected.
NEAR_PERCENT, NEAR_BANDS, NEAR_AGREED = 80, 28, 64


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site lines go but for their first place; documents left without a word go."""
    return lines.without_boilerplate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return neardup.one_of_each(docs, NEAR_PERCENT, NEAR_BANDS, NEAR_AGREED)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents up to their leaf's budget stay."""
    out = mixing.mix(docs, weight_table(spark), MIX_SHARE, SEED, MIX_EPOCHS, tokens=F.size(words_of(F.col("text"))), domain=domain_of())
    return out.select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of ids and decoded text."""
    return bpe.tokenize(docs, vocabulary(), keep=("doc_id", "lang", "source"), with_ids=True)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mix_sources", mix_sources), ("tokens", tokens)]
#: Hashed n-grams, signatures and tokens have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's result is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
