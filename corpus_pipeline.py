"""Corpus pipeline: five stages over ``documents``, each written as Parquet in
the shared checkpoint folder and read again by the next.

A stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``.  Stages share executors, so each bounds what goes to Python at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leaklens.llm import decontamination, mixing, near_dup, substring_dedup, toxicity
from leaklens.llm.graph import written
from leaklens.session import bound_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents with a toxicity score of 0.5 or more go."""
    bound_batches(spark)
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the document with the smallest doc_id of each class stays."""
    bound_batches(spark)
    return near_dup.drop_near_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: repeated passages are cut out of all documents but one."""
    bound_batches(spark)
    return substring_dedup.drop_repeated_passages(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a benchmark item go."""
    bound_batches(spark)
    return decontamination.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: each document as often as the mix takes it (column copy)."""
    bound_batches(spark)
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The toxicity model, the signatures and the latent directions have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
