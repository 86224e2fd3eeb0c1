"""From raw documents to shards: the stages of a training-data pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesift.llm import decontamination, mixing, sharding, simhash, toxicity
from namesift.session import stage


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score as toxic."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: texts whose SimHash fingerprints link, or that share most shingles."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the documents in the order of the mix."""
    return mixing.in_order(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the shard of each document and its place in the mix; columns of the added names are replaced.

    The mixing stage returns the columns of documents and no more, so its order is worked out again from the same rows,
    which gives the same numbers. Rows are written by shard and place.
    """
    names = {"shard": "shard", "depth": "shard_depth", "shard_bytes": "shard_bytes"}
    placed = mixing.mixed(docs.drop("mix_order", *names.values())).select("doc.*", F.col("order").alias("mix_order"))
    rows = sharding.shards(placed)
    return rows.select("doc.*", *[F.col(c).alias(name) for c, name in names.items()]).sortWithinPartitions("shard", "mix_order")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

# Learnt scores, greedy tiling and verified near copies are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
