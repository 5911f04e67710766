"""Hashes, sets and lists in row form: (key, field, value), (key, member), (key, pos, elem).

Rows stay the canonical form, so a hot key never becomes one array in one task
unless a command returns it whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.columns import in_range

# hashes


def hgetall(rows: DataFrame, key: str = "key") -> DataFrame:
    """HGETALL: one map a key; HKEYS, HVALS and HLEN are map_keys, map_values and size of it."""
    return rows.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields"))


def hlen(rows: DataFrame, key: str = "key") -> DataFrame:
    """HLEN, SCARD, ZCARD, LLEN, XLEN without building the collection."""
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def hset_new(table: DataFrame, batch: DataFrame, keys: tuple[str, str] = ("key", "field")) -> DataFrame:
    """HSET, SADD, ZADD reply: how many of the fields of each key are new."""
    new = batch.select(*keys).distinct().join(table.select(*keys).withColumn("_old", F.lit(1)), list(keys), "left")
    return new.groupBy(keys[0]).agg(F.count_if(F.col("_old").isNull()).alias("added"))


# sets


def union(sets: DataFrame, keys: list[str], key: str = "key", member: str = "member") -> DataFrame:
    """SUNION of the named sets; a missing one is empty."""
    return sets.where(F.col(key).isin(keys)).select(member).distinct()


def inter(sets: DataFrame, keys: list[str], key: str = "key", member: str = "member") -> DataFrame:
    """SINTER: members of every named set, by counting; a missing set makes it empty."""
    names = list(dict.fromkeys(keys))
    rows = sets.where(F.col(key).isin(names)).select(key, member).distinct()
    return rows.groupBy(member).agg(F.count("*").alias("_n")).where(F.col("_n") == len(names)).select(member)


def diff(sets: DataFrame, keys: list[str], key: str = "key", member: str = "member") -> DataFrame:
    """SDIFF: members of the first set in none of the others, by one aggregation."""
    first, rest = keys[0], keys[1:]
    rows = sets.where(F.col(key).isin(keys))
    return rows.groupBy(member).agg(F.max((F.col(key) == first).cast("int")).alias("_in"), F.max(F.col(key).isin(rest).cast("int") if rest else F.lit(0)).alias("_out")).where("_in = 1 and _out = 0").select(member)


def is_member(requests: DataFrame, sets: DataFrame, keys: tuple[str, str] = ("key", "member")) -> DataFrame:
    """SISMEMBER, SMISMEMBER: each requested pair with 1 or 0."""
    have = sets.select(*keys).distinct().withColumn("_have", F.lit(1))
    return requests.join(have, list(keys), "left").withColumn("is_member", F.coalesce("_have", F.lit(0)).cast("bigint")).drop("_have")


def move_members(sets: DataFrame, moves: DataFrame, key: str = "key", member: str = "member") -> DataFrame:
    """SMOVE: ``moves`` (src, dst, member); only members that are in src move."""
    real = moves.join(sets.select(F.col(key).alias("src"), member).distinct(), ["src", member], "left_semi")
    left = sets.join(real.select(F.col("src").alias(key), member), [key, member], "left_anti")
    return left.select(key, member).unionByName(real.select(F.col("dst").alias(key), member)).distinct()


# lists


def positioned(rows: DataFrame, key: str = "key", order: str = "pos") -> DataFrame:
    """``index`` from 0 and the length ``n`` of each list."""
    w = Window.partitionBy(key)
    return rows.withColumn("index", F.row_number().over(w.orderBy(order)).cast("bigint") - 1).withColumn("n", F.count("*").over(w))


def push(rows: DataFrame, batch: DataFrame, left: bool, only_existing: bool = False, key: str = "key") -> DataFrame:
    """LPUSH, RPUSH and the X forms: ``batch`` (key, seq, elem) goes before or behind ``rows`` (key, pos, elem)."""
    if only_existing:
        batch = batch.join(rows.select(key).distinct(), key, "left_semi")
    ends = rows.groupBy(key).agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("seq")).cast("bigint")
    placed = batch.withColumn("_n", nth).join(ends, key, "left")
    pos = F.coalesce("_lo", F.lit(0)) - F.col("_n") if left else F.coalesce("_hi", F.lit(-1)) + F.col("_n")
    return rows.select(key, F.col("pos").cast("bigint").alias("pos"), "elem").unionByName(placed.select(key, pos.alias("pos"), "elem"))


def pop(rows: DataFrame, left: bool, key: str = "key", order: str = "pos") -> tuple[DataFrame, DataFrame]:
    """LPOP, RPOP: (what is popped, what stays)."""
    by = F.col(order) if left else F.col(order).desc()
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(by)))
    return ranked.where("_r = 1").drop("_r"), ranked.where("_r > 1").drop("_r")


def lrange(rows: DataFrame, start: int, stop: int, key: str = "key", order: str = "pos") -> DataFrame:
    """LRANGE: the elements of an inclusive range of every list; LINDEX is a range of one, LTRIM keeps it."""
    return positioned(rows, key, order).where(in_range(F.col("index"), F.col("n"), start, stop))


def lindex(rows: DataFrame, i: int, key: str = "key", order: str = "pos") -> DataFrame:
    """LINDEX: no row where the list is too short."""
    return positioned(rows, key, order).where(F.col("index") == (F.lit(i) if i >= 0 else F.col("n") + i))


def lset(rows: DataFrame, i: int, value: str, key: str = "key", order: str = "pos") -> DataFrame:
    """LSET in every list long enough."""
    hit = F.col("index") == (F.lit(i) if i >= 0 else F.col("n") + i)
    return positioned(rows, key, order).withColumn("elem", F.when(hit, F.lit(value)).otherwise(F.col("elem"))).drop("index", "n")


def linsert(rows: DataFrame, pivot: str, value: str, before: bool, key: str = "key", order: str = "pos") -> DataFrame:
    """LINSERT at the first pivot of each list: (key, index, elem)."""
    at = positioned(rows, key, order).withColumn("_p", F.min(F.when(F.col("elem") == pivot, F.col("index"))).over(Window.partitionBy(key)))
    place = F.col("_p") + (0 if before else 1)
    shifted = F.when(F.col("index") >= place, F.col("index") + 1).otherwise(F.col("index"))
    new = F.when(F.col("index") == F.col("_p"), F.array(F.struct(shifted.alias("index"), F.col("elem")), F.struct(place.alias("index"), F.lit(value).alias("elem"))))
    return at.select(key, F.inline(F.coalesce(new, F.array(F.struct(F.coalesce(shifted, F.col("index")).alias("index"), F.col("elem"))))))


def lrem(rows: DataFrame, count: int, value: str, key: str = "key", order: str = "pos") -> DataFrame:
    """LREM: all, the first or (negative) the last equal elements of each list go."""
    by = F.col(order) if count >= 0 else F.col(order).desc()
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key, "elem").orderBy(by)))
    gone = (F.col("elem") == value) & (F.lit(True) if count == 0 else F.col("_r") <= abs(count))
    return ranked.where(~F.coalesce(gone, F.lit(False))).drop("_r")


def lpos(rows: DataFrame, value: str, rank: int = 1, count: int = 1, maxlen: int = 0, key: str = "key", order: str = "pos") -> DataFrame:
    """LPOS: 0-based positions of matches from the ``rank``-th on; ``count`` 0 gives all, ``maxlen`` bounds the comparisons."""
    at = positioned(rows, key, order)
    far = F.col("index") if rank > 0 else F.col("n") - 1 - F.col("index")
    hits = at.where((F.col("elem") == value) & (F.lit(True) if maxlen == 0 else far < maxlen))
    hits = hits.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(far))).where(F.col("_r") >= abs(rank))
    return (hits if count == 0 else hits.where(F.col("_r") < abs(rank) + count)).drop("_r", "n")


def lmove(rows: DataFrame, src: str, dst: str, from_left: bool, to_left: bool, key: str = "key") -> DataFrame:
    """LMOVE: one element from an end of src to an end of dst."""
    popped, _ = pop(rows.where(F.col(key) == src), from_left, key)
    stays = rows.join(popped.select(key, "pos"), [key, "pos"], "left_anti")
    return push(stays, popped.select(F.lit(dst).alias(key), F.lit(0).alias("seq"), "elem"), to_left, key=key)


