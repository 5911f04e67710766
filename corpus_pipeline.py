"""Five stages from raw documents to packed training sequences.

Each stage reads what its predecessor kept and is written as Parquet before the
next one starts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontam, near_dup, packing, pii, toxicity
from keyloom.llm.common import drop, scratch, shared_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.without_toxic(spark, docs, table(spark, sf_dir, "labels"))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dup.deduplicated(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the new text."""
    return pii.sanitised(docs).withColumn("n_chars", F.length("text").cast("long"))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in bins."""
    return packing.packed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _toxicity),
    ("near_dedup", _near_dedup),
    ("decontamination", _decontamination),
    ("pii", _pii),
    ("packing", _packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table. A stage's tables are deleted when its result is written, and that when the next one is."""
    docs, before = table(spark, sf_dir, "documents"), []
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        drop(spark, before)
        before = [f"{top}/{name}"]
        docs = spark.read.parquet(*before)
    return docs


#: The classifier and MinHash can't be put in SQL; tests compare the stages with brute force.
ORACLE_SQL = None
