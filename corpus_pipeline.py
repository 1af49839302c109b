"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemetrics.llm import decontamination, packing, quality_rules, simhash, substring
from lakemetrics.llm.common import shared_dir, spread, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and the isolation forest keep."""
    return quality_rules.kept(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return simhash.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document with a smaller doc_id has too."""
    found = substring.dedup(docs, joined=False)
    columns = {c: F.col("rest")[c] for c in docs.columns if c not in ("doc_id", "text")} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    columns["n_chars"] = F.when(F.col("text").isNotNull(), F.length("text")).cast("long")
    return found.select(*[columns[c].alias(c) for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences, one row each."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("packing", packing_),
]

#: SQL can't express the forest, the fingerprints' components or the packing; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage but the last is written as Parquet to the shared folder and read again."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid4().hex}"
    docs = spread(table(spark, sf_dir, "documents"))
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
