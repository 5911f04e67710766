"""MULTI, EXEC, WATCH over an op log: blocks of rows with one tx_id, applied whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def committed(log: DataFrame, watched: DataFrame, versions: DataFrame, key: str = "key") -> DataFrame:
    """Rows of ``log`` whose transaction commits.

    ``watched`` (tx_id, key, version) holds what WATCH saw, ``versions``
    (key, version) what is current; a difference, or a key that came or went
    (version 0 is absence), aborts the whole transaction. Rows without a tx_id apply.
    """
    now = versions.select(key, F.col("version").alias("_now"))
    broken = watched.join(now, key, "left").where(F.col("version") != F.coalesce("_now", F.lit(0))).select("tx_id").distinct()
    return log.join(broken, "tx_id", "left_anti")


def bump(log: DataFrame, versions: DataFrame, key: str = "key") -> DataFrame:
    """Versions after the writes of ``log``: one step for each write."""
    steps = log.groupBy(key).agg(F.count("*").alias("_n"))
    return versions.join(steps, key, "full").select(key, (F.coalesce("version", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("bigint").alias("version"))
