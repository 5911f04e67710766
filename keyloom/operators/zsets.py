"""Sorted sets: rows (key, member, score), ordered by score and then member bytewise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.columns import in_range, lex_between, score_between


def _order(reverse: bool) -> list[Column]:
    return [F.col("score").desc(), F.col("member").desc()] if reverse else [F.col("score"), F.col("member")]


def ranked(rows: DataFrame, reverse: bool = False, key: str = "key") -> DataFrame:
    """ZRANK, ZREVRANK: the 0-based ``rank`` of every member; reversing reverses ties too."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*_order(reverse))).cast("bigint") - 1)


def zrange(rows: DataFrame, start: int, stop: int, reverse: bool = False, key: str = "key") -> DataFrame:
    """ZRANGE, ZREVRANGE by rank in every set. With fixed non-negative ends the window keeps the top rows of each task only."""
    r = ranked(rows, reverse, key)
    if start >= 0 and stop >= 0:
        return r.where((F.col("rank") >= start) & (F.col("rank") <= stop))
    n = F.count("*").over(Window.partitionBy(key))
    return r.withColumn("_n", n).where(in_range(F.col("rank"), F.col("_n"), start, stop)).drop("_n")


def zrange_by_score(rows: DataFrame, low: str, high: str, reverse: bool = False, offset: int = 0, limit: int | None = None, key: str = "key") -> DataFrame:
    """ZRANGEBYSCORE in every set; LIMIT counts within each."""
    hits = rows.where(score_between(F.col("score"), low, high))
    if not offset and limit is None:
        return hits
    top = ranked(hits, reverse, key).where(F.col("rank") >= offset)
    return (top if limit is None else top.where(F.col("rank") < offset + limit)).drop("rank")


def zrange_by_lex(rows: DataFrame, low: str, high: str, offset: int = 0, limit: int | None = None, key: str = "key") -> DataFrame:
    """ZRANGEBYLEX for sets in which all scores are equal (whatever the score is); others give no rows."""
    w = Window.partitionBy(key)
    flat = rows.withColumn("_lo", F.min("score").over(w)).withColumn("_hi", F.max("score").over(w)).where("_lo = _hi").drop("_lo", "_hi")
    hits = flat.where(lex_between(F.col("member"), low, high))
    if not offset and limit is None:
        return hits
    top = ranked(hits, False, key).where(F.col("rank") >= offset)
    return (top if limit is None else top.where(F.col("rank") < offset + limit)).drop("rank")


def zcount(rows: DataFrame, low: str, high: str, key: str = "key") -> DataFrame:
    """ZCOUNT of every set, 0 included."""
    return rows.groupBy(key).agg(F.count_if(score_between(F.col("score"), low, high)).alias("n"))


def zlexcount(rows: DataFrame, low: str, high: str, key: str = "key") -> DataFrame:
    """ZLEXCOUNT of every set."""
    return rows.groupBy(key).agg(F.count_if(lex_between(F.col("member"), low, high)).alias("n"))


def zadd(log: DataFrame, mode: str = "", key: str = "key", seq: str = "seq") -> DataFrame:
    """Fold of ZADD rows (key, member, score, seq): last wins, or NX the first, GT the largest, LT the smallest, INCR the sum.

    GT and LT still add new members.
    """
    how = {"": F.max_by("score", seq), "NX": F.min_by("score", seq), "GT": F.max("score"), "LT": F.min("score"), "INCR": F.sum("score")}[mode]
    return log.groupBy(key, "member").agg(how.alias("score"))


def zadd_to(table: DataFrame, batch: DataFrame, mode: str = "", key: str = "key") -> DataFrame:
    """ZADD onto a table: (key, member, score, added, changed), the last two for the replies without and with CH."""
    new = batch.select(key, "member", F.col("score").alias("_new"))
    both = table.select(key, "member", "score").join(new, [key, "member"], "full")
    old, put = F.col("score"), F.col("_new")
    keep = {"": F.coalesce(put, old), "NX": F.coalesce(old, put), "XX": F.when(old.isNotNull(), F.coalesce(put, old)), "GT": F.greatest(old, put), "LT": F.least(old, put)}[mode]
    out = both.withColumn("_keep", keep).where("_keep is not null")
    return out.select(key, "member", F.col("_keep").alias("score"), old.isNull().cast("int").alias("added"), (old.isNull() | (old != F.col("_keep"))).cast("int").alias("changed"))


def zremrange(rows: DataFrame, start: int, stop: int, key: str = "key") -> DataFrame:
    """ZREMRANGEBYRANK: what stays."""
    n = F.count("*").over(Window.partitionBy(key))
    return ranked(rows, False, key).withColumn("_n", n).where(~in_range(F.col("rank"), F.col("_n"), start, stop)).drop("rank", "_n")


def zremrange_by_score(rows: DataFrame, low: str, high: str) -> DataFrame:
    return rows.where(~score_between(F.col("score"), low, high))


def zremrange_by_lex(rows: DataFrame, low: str, high: str, key: str = "key") -> DataFrame:
    """ZREMRANGEBYLEX in sets with equal scores; others stay whole."""
    w = Window.partitionBy(key)
    same = F.min("score").over(w) == F.max("score").over(w)
    return rows.withColumn("_same", same).where(~(F.col("_same") & lex_between(F.col("member"), low, high))).drop("_same")


def zpop(rows: DataFrame, n: int, highest: bool = False, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """ZPOPMIN, ZPOPMAX: (popped, left)."""
    r = ranked(rows, highest, key)
    return r.where(F.col("rank") < n), r.where(F.col("rank") >= n).drop("rank")


def _weighted(rows: DataFrame, keys: list[str], weights: list[float] | None, key: str) -> DataFrame:
    weights = weights or [1.0] * len(keys)
    factors = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(w)).alias("w")) for k, w in zip(keys, weights, strict=True)))
    named = rows.where(F.col(key).isin(keys)).withColumn("_f", F.explode(F.filter(factors, lambda f: f["k"] == F.col(key))))
    return named.select(key, "member", (F.col("score") * F.col("_f.w")).alias("score"))


def zstore(rows: DataFrame, keys: list[str], weights: list[float] | None = None, aggregate: str = "SUM", inter: bool = False, key: str = "key") -> DataFrame:
    """ZUNIONSTORE and, with ``inter``, ZINTERSTORE: (member, score). A key named twice counts twice."""
    how = {"SUM": F.sum, "MIN": F.min, "MAX": F.max}[aggregate]
    out = _weighted(rows, keys, weights, key).groupBy("member").agg(how("score").alias("score"), F.count("*").alias("_n"))
    return (out.where(F.col("_n") == len(keys)) if inter else out).drop("_n")


def zrangestore(rows: DataFrame, src: str, dst: str, low: str, high: str, by: str = "RANK", reverse: bool = False, offset: int = 0, limit: int | None = None, key: str = "key") -> DataFrame:
    """ZRANGESTORE: the range of src as rows of dst."""
    one = rows.where(F.col(key) == src)
    if by == "RANK":
        out = zrange(one, int(low), int(high), reverse, key)
    elif by == "SCORE":
        out = zrange_by_score(one, low, high, reverse, offset, limit, key)
    else:
        out = zrange_by_lex(one, low, high, offset, limit, key)
    return out.select(F.lit(dst).alias(key), "member", "score")
