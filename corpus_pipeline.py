"""A pipeline over the documents table; every stage calls one operator of landshift.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from landshift.llm import decontaminate, mixing, near_dup, sharding, toxicity
from landshift.llm.queries import SHARDS, TABLE_SIZE, learnable, table
from landshift.session import configure, materialize

# All sources together get 1.9 times their words and no source more than twice its own. Weights
# are a source's words times 3, 1 or 2, so that even a source of the lowest weight is kept in
# practice, and the mix shows in how often documents repeat.
MIX_SHARE, MIX_EPOCHS, MIX_CYCLE = 1.9, 2.0, (3, 1, 2)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are more likely toxic than not."""
    configure(spark)
    machine = toxicity.train(docs, learnable(spark, sf_dir))
    return toxicity.with_score(docs, machine, "__score").where("__score < 0.5").select(*docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: a similarity of 0.8 on five-word shingles."""
    configure(spark)
    return near_dup.deduplicate(docs, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, edited or not."""
    configure(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that sources meet their target weights."""
    configure(spark)
    weigh = lambda ordinal, size: mixing.cycled(ordinal, size, MIX_CYCLE) * size
    return mixing.repeat_rows(docs, weigh, MIX_SHARE, MIX_EPOCHS)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the shard of each document; copies of a document share it."""
    configure(spark)
    return sharding.place(docs, "doc_id", SHARDS, TABLE_SIZE)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mix_stage),
    ("sharding", shard_stage),
]

# Toxicity is a trained model and edit distance over all windows is no SQL expression.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the documents table to placed documents."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for position, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if position < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
