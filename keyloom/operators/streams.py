"""Append-only streams (key, ts_ms, seq, ...) and consumer groups, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID = ("ts_ms", "seq")


def entry_id(ts: str = "ts_ms", seq: str = "seq") -> Column:
    return F.concat_ws("-", F.col(ts).cast("string"), F.col(seq).cast("string"))


def parse_id(text: str, default_seq: int = 0) -> tuple[int, int]:
    ms, _, seq = text.partition("-")
    return int(ms), int(seq) if seq else default_seq


def with_auto_seq(rows: DataFrame, order: str, key: str = "key") -> DataFrame:
    """XADD with ``ms-*``: seq counts from 0 within each (key, ts_ms)."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(key, "ts_ms").orderBy(order)).cast("bigint") - 1)


def accepted(rows: DataFrame, arrival: str, key: str = "key") -> DataFrame:
    """XADD with explicit ids: entries whose id exceeds every earlier one of the key; others are refused."""
    before = Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(F.struct(*ID)).over(before)
    return rows.withColumn("_top", top).where(F.col("_top").isNull() | (F.struct(*ID) > F.col("_top"))).drop("_top")


def _bound(text: str, low: bool) -> Column:
    if text == ("-" if low else "+"):
        return F.lit(True)
    ms, seq = parse_id(text)
    same = F.col("ts_ms") == ms
    return (F.col("ts_ms") > ms) | (same & (F.col("seq") >= seq)) if low else (F.col("ts_ms") < ms) | (same & (F.col("seq") <= seq))


def xrange(rows: DataFrame, start: str = "-", end: str = "+", count: int | None = None, reverse: bool = False, key: str = "key") -> DataFrame:
    """XRANGE, XREVRANGE for every key; a bare ms means seq 0, for the end too. COUNT holds for each key."""
    hits = rows.where(_bound(start, True) & _bound(end, False))
    if count is None:
        return hits
    order = [F.col(c).desc() if reverse else F.col(c) for c in ID]
    return hits.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= count).drop("_r")


def xread(rows: DataFrame, after: DataFrame, count: int | None = None, key: str = "key") -> DataFrame:
    """XREAD: entries beyond the id in ``after`` (key, last_ms, last_seq) of each stream."""
    hits = rows.join(after, key).where((F.col("ts_ms") > F.col("last_ms")) | ((F.col("ts_ms") == F.col("last_ms")) & (F.col("seq") > F.col("last_seq")))).drop("last_ms", "last_seq")
    return hits if count is None else xrange(hits, count=count, key=key)


def xtrim_maxlen(rows: DataFrame, n: int, key: str = "key") -> DataFrame:
    """XTRIM MAXLEN: the newest ``n`` entries of each stream."""
    return xrange(rows, count=n, reverse=True, key=key)


def xtrim_minid(rows: DataFrame, least: str) -> DataFrame:
    return rows.where(_bound(least, True))


def xinfo(rows: DataFrame, key: str = "key") -> DataFrame:
    """XINFO STREAM: length, first and last id."""
    text = lambda s: F.concat_ws("-", s["ts_ms"].cast("string"), s["seq"].cast("string"))
    a = rows.groupBy(key).agg(F.count("*").alias("length"), F.min(F.struct(*ID)).alias("_a"), F.max(F.struct(*ID)).alias("_b"))
    return a.select(key, "length", text(F.col("_a")).alias("first_id"), text(F.col("_b")).alias("last_id"))


def readgroup(rows: DataFrame, consumers: list[str], count: int, key: str = "key") -> DataFrame:
    """XREADGROUP ``>``: each stream is delivered in batches of ``count`` to the consumers in turn."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*ID)).cast("bigint") - 1
    names = F.array(*map(F.lit, consumers))
    return rows.withColumn("batch", F.floor(nth / count).cast("bigint")).withColumn("consumer", F.get(names, (F.col("batch") % len(consumers)).cast("int"))).withColumn("delivery_count", F.lit(1).cast("bigint"))


def pending(deliveries: DataFrame, acks: DataFrame, key: str = "key") -> DataFrame:
    """The pending entries: deliveries without acknowledgement (XACK is a row in ``acks``)."""
    return deliveries.join(acks.select(key, *ID).distinct(), [key, *ID], "left_anti")


def xpending(pel: DataFrame, key: str = "key") -> DataFrame:
    """XPENDING summary by consumer: entries, smallest and largest id."""
    text = lambda s: F.concat_ws("-", s["ts_ms"].cast("string"), s["seq"].cast("string"))
    a = pel.groupBy(key, "consumer").agg(F.count("*").alias("n"), F.min(F.struct(*ID)).alias("_a"), F.max(F.struct(*ID)).alias("_b"))
    return a.select(key, "consumer", "n", text(F.col("_a")).alias("min_id"), text(F.col("_b")).alias("max_id"))


def idle(pel: DataFrame, now_ms: int, least: int = 0, delivered: str = "delivered_ms") -> DataFrame:
    """XPENDING detail: idle milliseconds of each entry, at least ``least``."""
    return pel.withColumn("idle_ms", F.lit(now_ms) - F.col(delivered)).where(F.col("idle_ms") >= least)


def xclaim(pel: DataFrame, consumer: str, now_ms: int, least_idle: int, ids: DataFrame | None = None, force: bool = False, key: str = "key") -> DataFrame:
    """XCLAIM: the entries in ``ids`` (all without it) that are idle enough, or with ``force`` any, move to ``consumer``."""
    named = pel.withColumn("_named", F.lit(True)) if ids is None else pel.join(ids.select(key, *ID).distinct().withColumn("_named", F.lit(True)), [key, *ID], "left")
    hit = F.coalesce("_named", F.lit(False)) & (F.lit(force) | (F.lit(now_ms) - F.col("delivered_ms") >= least_idle))
    out = named.withColumn("_hit", hit)
    return (
        out.withColumn("consumer", F.when(F.col("_hit"), F.lit(consumer)).otherwise(F.col("consumer")))
        .withColumn("delivery_count", F.col("delivery_count") + F.col("_hit").cast("bigint"))
        .withColumn("delivered_ms", F.when(F.col("_hit"), F.lit(now_ms)).otherwise(F.col("delivered_ms"))).drop("_named", "_hit")
    )


def xautoclaim(pel: DataFrame, now_ms: int, least_idle: int, start: str = "0-0", count: int = 100, key: str = "key") -> DataFrame:
    """XAUTOCLAIM: the entries of each stream it would claim, oldest delivery first."""
    hits = idle(pel, now_ms, least_idle).where(_bound(start, True))
    w = Window.partitionBy(key).orderBy("delivered_ms", *ID)
    return hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= count).drop("_r")


def group_cursor(deliveries: DataFrame, key: str = "key") -> DataFrame:
    """XINFO GROUPS: last delivered id, entries read and consumers of each stream's group."""
    text = lambda s: F.concat_ws("-", s["ts_ms"].cast("string"), s["seq"].cast("string"))
    a = deliveries.groupBy(key).agg(F.max(F.struct(*ID)).alias("_b"), F.count("*").alias("entries_read"), F.count_distinct("consumer").alias("consumers"))
    return a.select(key, text(F.col("_b")).alias("last_delivered"), "entries_read", "consumers")


def history(pel: DataFrame, consumer: str, start: str = "0-0", key: str = "key") -> DataFrame:
    """XREADGROUP with an id: the consumer's own pending entries from there on; counters stay."""
    return pel.where((F.col("consumer") == consumer) & _bound(start, True))


def del_consumer(pel: DataFrame, consumer: str) -> DataFrame:
    """XGROUP DELCONSUMER: its pending entries go, from every index."""
    return pel.where(F.col("consumer") != consumer)
