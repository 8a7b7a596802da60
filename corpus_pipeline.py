"""A corpus pipeline in stages; each reads what its predecessor wrote.

Rejected by quality, near copies, benchmark passages: those documents go. Mixing then repeats or thins sources toward
their target weights, and sharding deals the mix out. Every stage works on all rows it is given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authorscope.llm.common import read
from authorscope.llm.decontamination import contamination
from authorscope.llm.mixing import mixed_documents
from authorscope.llm.near_dedup import without_near_copies
from authorscope.llm.quality import quality, trained
from authorscope.llm.sharding import shard_rows
from authorscope.plans.durable import shared_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    scored = quality(docs, trained(docs, read(spark, sf_dir, "labels")))
    return scored.where("kept").select(*[f"`{c}`" for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words in a row with a benchmark item."""
    found = contamination(docs, read(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*[f"`{c}`" for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, or the parts of them, that the mix takes; a row for each time."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and slot."""
    return shard_rows(docs)


STAGES = [
    ("quality", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The classifier and the alignment can't be written as SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet in the shared folder and read again."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
