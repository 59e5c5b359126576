"""A corpus pipeline of five stages over ``documents``.

Each stage is a function of (session, documents, folder of the tables) and returns a table that
is written and read again as the next one's documents. All but the last return the columns of
documents. The tables that a stage stores on its way go when the next one begins. Null and empty texts, repeated rows and further columns are handled as each
operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from themeloom.llm import decontaminate, mixing, near_dedup, quality, sharding
from themeloom.session import begin_stage, end_stages, forget, materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    begin_stage(spark, "quality")
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    begin_stage(spark, "near-dedup")
    return near_dedup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    begin_stage(spark, "decontamination")
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, once or twice or not at all."""
    begin_stage(spark, "mixing")
    return mixing.apply_mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the shard and the slot they are written to."""
    begin_stage(spark, "sharding")
    return sharding.shard_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Hashed classifiers, signatures and tokens are not to be had in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Of the tables in between, those of one stage are stored at a time."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}", staged=False)
        written = docs.inputFiles()[0].rpartition("/")[0]
        if before is not None:
            forget(spark, before)
        before = written
    end_stages(spark)
    return docs
