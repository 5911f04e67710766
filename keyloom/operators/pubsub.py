"""Messages routed to channel and pattern subscribers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.columns import matches


def route(messages: DataFrame, subscriptions: DataFrame, patterns: list[tuple[str, str]], channel: str = "channel") -> DataFrame:
    """PUBLISH: a row for each message and receiver (subscriber, via).

    ``subscriptions`` (channel, subscriber) meets by equality; ``patterns`` is a
    bounded list of (glob, subscriber) tested in one pass, without a join.
    """
    direct = messages.join(subscriptions, channel).withColumn("via", F.lit("channel"))
    hits = F.array_compact(F.array(*(F.when(matches(F.col(channel), p), F.struct(F.lit(s).alias("subscriber"), F.lit(p).alias("via"))) for p, s in patterns)))
    by_pattern = messages.withColumn("_s", F.explode(hits)).select("*", "_s.subscriber", "_s.via").drop("_s") if patterns else direct.limit(0)
    return direct.unionByName(by_pattern)


def numsub(subscriptions: DataFrame, channel: str = "channel") -> DataFrame:
    """PUBSUB NUMSUB; its channels are PUBSUB CHANNELS."""
    return subscriptions.groupBy(channel).agg(F.count_distinct("subscriber").alias("n"))
