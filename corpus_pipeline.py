"""A corpus from raw documents to a weighted mix, in five stages.

toxicity      documents that the classifier scores 0.7 or more go
exact dedup   of equal texts the row with the largest doc_id stays
near dedup    of documents linked by 80 % of their five-word shingles one stays
benchmark     documents that hold a benchmark item, re-parameterised or not, go
mixing        sources are mixed 5 : 2 : 1; rows that the mix takes, and how often

Every stage works on what the one before kept, takes (spark, docs, sf_dir) and
returns the columns of its docs; the last one adds mix_copies. Labels and
benchmark are read from sf_dir. An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskpanel.llm import decontaminate, exact_dedup, mixing, near_dedup, toxicity
from riskpanel.llm.store import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one_of_each(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one_of_each_group(spark, docs, width=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

#: The first stage scores documents with a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; every stage but the last is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.store(stage(spark, docs, sf_dir), f"stage-{n}")
        if n:
            scratch.drop(f"stage-{n - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
