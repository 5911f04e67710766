"""Strings and counters. Values are text or bytes; numbers are read from text on use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mget(requests: DataFrame, table: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """MGET, GET, HMGET, ZMSCORE: the value of each requested (pos, key), null where there is none."""
    return requests.join(table.select(key, value), key, "left")


def msetnx(table: DataFrame, batch: DataFrame, key: str = "key") -> DataFrame:
    """MSETNX: ``table`` and the batch, or ``table`` alone if any key of the batch is there already."""
    taken = batch.join(table.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("_taken"))
    return table.unionByName(batch.join(F.broadcast(taken), F.col("_taken") == 0).drop("_taken"))  # one row is broadcast


def mset(table: DataFrame, batch: DataFrame, key: str = "key") -> DataFrame:
    """MSET: rows of ``batch`` replace those of ``table`` with the same key."""
    return table.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)


def incr_by(log: DataFrame, keys: list[str], delta: str) -> DataFrame:
    """INCR, DECR, INCRBY, DECRBY, HINCRBY: the final counter; overflow of 64 bits is an error as in the commands."""
    return log.groupBy(*keys).agg(F.sum(F.col(delta).cast("bigint")).alias("value"))


def incr_returns(log: DataFrame, keys: list[str], delta: str, seq: str = "seq") -> DataFrame:
    """What each increment returns: the running value in order of ``seq``."""
    w = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("value", F.sum(F.col(delta).cast("bigint")).over(w))


def incr_by_float(log: DataFrame, keys: list[str], delta: str) -> DataFrame:
    """INCRBYFLOAT, HINCRBYFLOAT, ZINCRBY: sums of doubles."""
    return log.groupBy(*keys).agg(F.sum(F.col(delta).cast("double")).alias("value"))


def get_range(value: Column, start: int, end: int) -> Column:
    """GETRANGE on bytes: inclusive, negative from the end, clamped, empty if nothing is left."""
    b = value.cast("binary")
    n = F.octet_length(b)
    first = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    last = F.least(F.lit(end) if end >= 0 else n + end, n - 1)
    return F.when((first > last) | (first >= n), F.lit("").cast("binary")).otherwise(F.substring(b, first + 1, last - first + 1))


def set_range(value: Column, offset: int, put: str) -> Column:
    """SETRANGE on bytes: overwrite from ``offset``, padded with zero bytes; an empty ``put`` changes nothing."""
    b, new = value.cast("binary"), F.lit(put).cast("binary")
    if not put:
        return b
    n = F.octet_length(b)
    pad = F.unhex(F.repeat(F.lit("00"), F.greatest(F.lit(offset) - n, F.lit(0))))
    return F.concat(F.substring(b, 1, offset), pad, new, F.substring(b, F.lit(offset + len(put.encode()) + 1), n))


def append(log: DataFrame, keys: list[str], value: str, seq: str = "seq") -> DataFrame:
    """APPEND: all values of a key in order of ``seq`` as one."""
    parts = F.sort_array(F.collect_list(F.struct(seq, value)))
    return log.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p[value]), "").alias("value"))


def strlen(value: Column) -> Column:
    """STRLEN: bytes, 0 for none."""
    return F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint")


def getset(log: DataFrame, keys: list[str], value: str, seq: str = "seq") -> DataFrame:
    """GETSET: what each write returned, the value before it."""
    return log.withColumn("old", F.lag(value).over(Window.partitionBy(*keys).orderBy(seq)))


def getdel(table: DataFrame, requests: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """GETDEL: (the values of the requested keys, the table without them)."""
    asked = requests.select(key).distinct()
    return table.join(asked, key, "left_semi"), table.join(asked, key, "left_anti")


def setex(rows: DataFrame, now: Column, seconds: Column, expire_at: str = "expire_at") -> DataFrame:
    """SETEX, PSETEX, GETEX EX: rows whose expiry is ``seconds`` (fractions allowed) after ``now``; a lifetime that is not positive is refused."""
    return rows.where(seconds > 0).withColumn(expire_at, now + F.make_dt_interval(secs=seconds))


def _applied(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The SET commands of a log that write: a key is there from its first command without XX on, and NX ones after that are void."""
    born = log.where(~F.col("xx")).groupBy(*keys).agg(F.min(seq).alias("_born"))
    return log.join(born, keys).where((F.col(seq) == F.col("_born")) | ((F.col(seq) > F.col("_born")) & ~F.col("nx"))).drop("_born")


def set_options(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """SET with EX, PX, EXAT, PXAT (``expire_at``, null for none), KEEPTTL, NX and XX (booleans): value and expiry of each key after the log.

    Keys do not lapse between the commands of one log; ``keyspace.live`` drops
    what has lapsed at its end.
    """
    done = _applied(log, keys, seq)
    lifetime = F.max_by(F.when(~F.col("keepttl"), F.struct("expire_at")), F.when(~F.col("keepttl"), F.col(seq)))
    return done.groupBy(*keys).agg(F.max_by("value", seq).alias("value"), lifetime["expire_at"].alias("expire_at"))


def set_returns(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """What each SET with GET returns: the value before it (``old``), null where the key was not there."""
    done = _applied(log, keys, seq).select(*keys, seq, F.lit(True).alias("_applied"))
    w = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    wrote = log.join(done, [*keys, seq], "left")
    return wrote.withColumn("old", F.last(F.when(F.col("_applied"), F.col("value")), ignorenulls=True).over(w)).drop("_applied")


def getex(table: DataFrame, requests: DataFrame, key: str = "key") -> DataFrame:
    """GETEX: ``table`` (key, value, expire_at) after ``requests`` (key, persist, new_expire_at): PERSIST drops the expiry, a new one replaces it, neither keeps it."""
    after = F.when(F.col("persist"), None).otherwise(F.coalesce("new_expire_at", "expire_at"))
    return table.join(requests, key, "left").withColumn("expire_at", after).drop("persist", "new_expire_at")
