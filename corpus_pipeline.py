"""A corpus through five stages, one of the operators each.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps; all but the
last return the columns of documents. The stages are written and read again in
between, so each starts from a plain scan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import decontamination, jaccard, mixing, quality, secrets
from weftgraph.operators.checkpoints import cut, folder, remove


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return jaccard.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark passage."""
    return decontamination.keep(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With a mark in place of each secret."""
    return secrets.redact(docs, secrets.thresholds(cut(secrets.inspect(docs))))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes; taken / size is how often."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [("quality classifier", classified), ("n-gram Jaccard join", deduplicated), ("benchmark decontamination", decontaminated), ("secret scans", redacted), ("mixing sources", mixed)]
#: SQL has no boosted trees.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the folder between two stages goes when the next one is written, the last one stays for the result."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            at = f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
            docs.write.parquet(at)
            docs = spark.read.parquet(at)
            if before:
                remove(spark, before)
            before = at
    return docs
