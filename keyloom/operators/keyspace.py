"""Keys of all types: live rows, folds of an op log, expiry, renames, scans, eviction.

A keyspace table has one row for each element; an op log has a total order
``seq`` for each key. ``now`` is always an argument, so results are repeatable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.columns import matches


def live(df: DataFrame, now: Column, expire_at: str = "expire_at") -> DataFrame:
    """Rows without an expiry or with one after ``now``."""
    return df.where(F.col(expire_at).isNull() | (F.col(expire_at) > now))


def last_write(log: DataFrame, keys: list[str], values: list[str], seq: str = "seq") -> DataFrame:
    """Last write wins: the values of the row with the largest ``seq`` for each key."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(*values), seq).alias("_v")).select(*keys, "_v.*")


def first_write(log: DataFrame, keys: list[str], values: list[str], seq: str = "seq") -> DataFrame:
    """Write only if absent (NX): the values of the first row for each key."""
    return log.groupBy(*keys).agg(F.min_by(F.struct(*values), seq).alias("_v")).select(*keys, "_v.*")


def overwrite(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Write only if present (XX): rows of ``base`` with the values of ``updates`` where the key has one."""
    new = updates.withColumnsRenamed({c: f"_new_{c}" for c in updates.columns if c not in keys})
    put = [F.coalesce(f"_new_{c}", c).alias(c) if f"_new_{c}" in new.columns else F.col(c) for c in base.columns if c not in keys]
    return base.join(new, keys, "left").select(*keys, *put)


def delete(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """DEL, UNLINK, HDEL, SREM, ZREM, XDEL: rows whose keys are not in ``gone``."""
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def exists_count(requests: DataFrame, catalogue: DataFrame, key: str = "key") -> DataFrame:
    """EXISTS: how many requested keys are there, repeated ones counted each time."""
    return requests.join(catalogue.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n"))


def catalogue(tables: dict[str, DataFrame], key: str = "key") -> DataFrame:
    """(key, type) over typed tables; TYPE is a look-up in it."""
    out = None
    for kind, df in sorted(tables.items()):
        one = df.select(key).distinct().withColumn("type", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def wrong_types(types: DataFrame, key: str = "key") -> DataFrame:
    """Keys with more than one type, which a keyspace must not have."""
    return types.groupBy(key).agg(F.count_distinct("type").alias("types")).where("types > 1")


def ttl(df: DataFrame, now: Column, expire_at: str = "expire_at") -> DataFrame:
    """TTL and PTTL: whole seconds and milliseconds left, -1 without expiry, -2 if expired."""
    left = F.timestamp_diff("MILLISECOND", now, F.col(expire_at))
    code = lambda v: F.when(F.col(expire_at).isNull(), F.lit(-1)).when(left <= 0, F.lit(-2)).otherwise(v).cast("bigint")
    return df.withColumn("ttl", code(F.floor(left / 1000))).withColumn("pttl", code(left))


def expire(df: DataFrame, after: Column, expire_at: str = "expire_at") -> DataFrame:
    """EXPIRE family: set the expiry to a timestamp column; PERSIST is a null one."""
    return df.withColumn(expire_at, after)


def scan_page(df: DataFrame, after: str | None, count: int, pattern: str = "*", key: str = "key") -> DataFrame:
    """SCAN by key set paging: the next ``count`` matching keys beyond the cursor ``after``."""
    rows = df if after is None else df.where(F.col(key) > after)
    rows = rows if pattern == "*" else rows.where(matches(F.col(key), pattern))
    return rows.orderBy(key).limit(count)


def scan_pages(df: DataFrame, keys: list[str], member: str, after: object, count: int, pattern: str = "*") -> DataFrame:
    """HSCAN, SSCAN, ZSCAN for every key at once: the next ``count`` matching members of each key beyond the cursor ``after``."""
    rows = df if after is None else df.where(F.col(member) > F.lit(after))
    rows = rows if pattern == "*" else rows.where(matches(F.col(member), pattern))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(member))).where(F.col("_n") <= count).drop("_n")


def rename(df: DataFrame, pairs: DataFrame, key: str = "key", only_new: bool = False) -> DataFrame:
    """RENAME and RENAMENX: ``pairs`` (src, dst) move all rows of src to dst; an old dst goes, or with ``only_new`` the pair is void."""
    names = df.select(key).distinct()
    pairs = pairs.join(names.withColumnRenamed(key, "src"), "src", "left_semi")
    if only_new:
        pairs = pairs.join(names.withColumnRenamed(key, "dst"), "dst", "left_anti")
    kept = df.join(pairs.select(F.col("dst").alias(key)).join(pairs.select(F.col("src").alias(key)), key, "left_anti"), key, "left_anti")
    return kept.join(pairs, F.col(key) == F.col("src"), "left").select(F.coalesce("dst", key).alias(key), *(c for c in df.columns if c != key))


def evict(df: DataFrame, order: list[Column], size: str, budget: int) -> DataFrame:
    """Rows to evict, first in ``order``, until the sizes left fit ``budget``.

    The running total needs a global order: ranges of the first order column are
    summed first, so only their totals meet in one task.
    """
    buckets = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    parts = df.repartitionByRange(int(buckets), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    total = parts.groupBy("_part").agg(F.sum(size).alias("_size"))
    before = total.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"), F.sum("_size").over(Window.partitionBy()).alias("_all"))
    run = F.sum(size).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    placed = parts.withColumn("_run", F.coalesce(run, F.lit(0))).join(F.broadcast(before), "_part")
    return placed.where(F.col("_all") - F.col("_before") - F.col("_run") > budget).drop("_part", "_run", "_before", "_all")


def pick(df: DataFrame, keys: list[str], member: str, count: int, seed: int = 0, repeat: bool = False) -> DataFrame:
    """SRANDMEMBER, SPOP, HRANDFIELD: ``count`` members of each key in a hashed order, or with ``repeat`` drawn with replacement."""
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(member, F.lit(seed)), member))
    ranked = df.withColumn("_r", order)
    if not repeat:
        return ranked.where(F.col("_r") <= count).drop("_r")
    n = ranked.groupBy(*keys).agg(F.max("_r").alias("_n"))
    draws = n.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(count)))).withColumn("_r", (F.pmod(F.xxhash64(*keys, "_draw", F.lit(seed)), F.col("_n")) + 1).cast("int"))
    return draws.join(ranked, [*keys, "_r"]).drop("_r", "_n", "_draw")


#: Eviction policies as orders of (last_access, uses, expire_at): what goes first.
POLICIES = {
    "allkeys-lru": ("last_access",), "volatile-lru": ("last_access",), "allkeys-lfu": ("uses", "last_access"), "volatile-lfu": ("uses", "last_access"),
    "volatile-ttl": ("expire_at",), "allkeys-random": (), "volatile-random": (),
}


def evict_by(df: DataFrame, policy: str, size: str, budget: int, key: str = "key", seed: int = 0) -> DataFrame:
    """Rows that a policy evicts; volatile ones consider keys with an expiry only, random ones go by a hash. noeviction gives none."""
    if policy == "noeviction":
        return df.limit(0)
    order = [F.col(c) for c in POLICIES[policy]] or [F.xxhash64(key, F.lit(seed))]
    if not policy.startswith("volatile"):
        return evict(df, [*order, F.col(key)], size, budget)
    rest = df.where(F.col("expire_at").isNull()).agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    return evict(df.where(F.col("expire_at").isNotNull()), [*order, F.col(key)], size, budget - rest)


def memory_usage(tables: dict[str, DataFrame], key: str = "key") -> DataFrame:
    """MEMORY USAGE: bytes of the elements of each key (an estimate; the key itself once)."""
    out = None
    for df in tables.values():
        width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns if c != key), F.lit(0))
        one = df.groupBy(key).agg(F.sum(width).alias("bytes"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(key).agg((F.sum("bytes") + F.octet_length(F.first(F.col(key).cast("string")))).cast("bigint").alias("bytes"))
