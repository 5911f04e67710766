"""Command text over a keyspace: each read command becomes a lazy DataFrame, each write command a new keyspace.

``Keyspace`` holds one table a type: string (key, value), hash (key, field,
value), list (key, pos, elem), set (key, member), zset (key, member, score), geo
(key, member, lon, lat), stream (key, ts_ms, seq, fields), json (key, doc) and
expiry (key, expire_at). For work on many keys call the operators themselves;
this is the single-key front end over the same code.
"""

from __future__ import annotations

import shlex
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.columns import matches, slot
from keyloom.operators import bits, geo, jsondoc, keyspace, sorting, streams, strings, zsets
from keyloom.operators import collections as c

SCHEMAS = {
    "string": "key string, value string", "hash": "key string, field string, value string", "list": "key string, pos long, elem string",
    "set": "key string, member string", "zset": "key string, member string, score double", "geo": "key string, member string, lon double, lat double",
    "stream": "key string, ts_ms long, seq long, fields map<string,string>", "json": "key string, doc string", "expiry": "key string, expire_at timestamp_ntz",
}
KEYS = {"hash": ["key", "field"], "set": ["key", "member"], "zset": ["key", "member"], "geo": ["key", "member"], "string": ["key"], "json": ["key"], "expiry": ["key"]}


class WrongType(ValueError):
    """A key holds a value of another type."""


@dataclass(frozen=True)
class Keyspace:
    spark: SparkSession
    tables: dict[str, DataFrame]

    @classmethod
    def of(cls, spark: SparkSession, **tables: DataFrame) -> Keyspace:
        return cls(spark, {k: tables.get(k, spark.createDataFrame([], s)) for k, s in SCHEMAS.items()})

    def __getitem__(self, kind: str) -> DataFrame:
        return self.tables[kind]

    def put(self, kind: str, rows: DataFrame) -> Keyspace:
        return replace(self, tables={**self.tables, kind: rows})

    def upsert(self, kind: str, rows: DataFrame) -> Keyspace:
        return self.put(kind, keyspace.delete(self[kind], rows, KEYS[kind]).unionByName(rows))

    def without(self, keys: list[str]) -> Keyspace:
        return replace(self, tables={k: df.where(~F.col("key").isin(keys)) for k, df in self.tables.items()})

    def types(self) -> DataFrame:
        return keyspace.catalogue({k: v for k, v in self.tables.items() if k != "expiry"})

    def check(self, key: str, kind: str) -> None:
        """An error if the key is of another type."""
        for other, df in self.tables.items():
            if other not in (kind, "expiry") and not df.where(F.col("key") == key).isEmpty():
                raise WrongType(f"{key} is {other}, not {kind}")

    def read(self, text: str) -> DataFrame:
        name, *args = shlex.split(text)
        if name.upper() not in READS:
            raise ValueError(f"unknown read command {name}")
        return READS[name.upper()](self, *args)

    def write(self, text: str) -> Keyspace:
        name, *args = shlex.split(text)
        if name.upper() not in WRITES:
            raise ValueError(f"unknown write command {name}")
        kind, run = WRITES[name.upper()]
        if kind and args:
            self.check(args[0], kind)
        return run(self, *args)


def _one(ks: Keyspace, kind: str, key: str) -> DataFrame:
    return ks[kind].where(F.col("key") == key)


def _asked(ks: Keyspace, names: tuple[str, ...], column: str) -> DataFrame:
    return ks.spark.createDataFrame(list(enumerate(names)), f"pos int, {column} string")


def _rank(ks: Keyspace, key: str, start: str, stop: str, reverse: bool) -> DataFrame:
    return zsets.zrange(_one(ks, "zset", key), int(start), int(stop), reverse)


def _limit(args: tuple[str, ...]) -> tuple[int, int | None]:
    up = [a.upper() for a in args]
    return (int(args[up.index("LIMIT") + 1]), int(args[up.index("LIMIT") + 2])) if "LIMIT" in up else (0, None)


def _stored(ks: Keyspace, keys: tuple[str, ...], args: tuple[str, ...], inter: bool) -> DataFrame:
    n = int(keys[0]) if keys else 0
    names = list(args[:n])
    rest = [a.upper() for a in args[n:]]
    weights = [float(x) for x in rest[rest.index("WEIGHTS") + 1 : rest.index("WEIGHTS") + 1 + n]] if "WEIGHTS" in rest else None
    how = rest[rest.index("AGGREGATE") + 1] if "AGGREGATE" in rest else "SUM"
    return zsets.zstore(ks["zset"], names, weights, how, inter)


def _geo_radius(ks: Keyspace, key: str, lon: str, lat: str, r: str, unit: str, *args: str) -> DataFrame:
    centre = ks.spark.createDataFrame([(key, "", float(lon), float(lat))], "key string, centre string, clon double, clat double")
    out = geo.radius(_one(ks, "geo", key), centre, float(r), unit.lower()).select("member", "lon", "lat", "dist")
    up = [a.upper() for a in args]
    out = out.orderBy(F.col("dist").desc() if "DESC" in up else F.col("dist"), "member")
    return out.limit(int(args[up.index("COUNT") + 1])) if "COUNT" in up else out


READS: dict[str, Callable[..., DataFrame]] = {
    "GET": lambda ks, k: _one(ks, "string", k).select("value"),
    "MGET": lambda ks, *k: strings.mget(_asked(ks, k, "key"), ks["string"]).orderBy("pos"),
    "STRLEN": lambda ks, k: _one(ks, "string", k).agg(F.coalesce(F.max(strings.strlen(F.col("value"))), F.lit(0)).alias("n")),
    "GETRANGE": lambda ks, k, a, b: _one(ks, "string", k).select(strings.get_range(F.col("value"), int(a), int(b)).cast("string").alias("value")),
    "GETBIT": lambda ks, k, i: _one(ks, "string", k).select(bits.get_bit(F.col("value"), int(i)).alias("bit")),
    "BITCOUNT": lambda ks, k: _one(ks, "string", k).select(bits.byte_bit_count(F.col("value")).alias("n")),
    "EXISTS": lambda ks, *k: keyspace.exists_count(_asked(ks, k, "key"), ks.types()),
    "TYPE": lambda ks, k: ks.types().where(F.col("key") == k).select("type"),
    "KEYS": lambda ks, p: ks.types().where(matches(F.col("key"), p)).select("key"),
    "SCAN": lambda ks, after, count="10", p="*": keyspace.scan_page(ks.types().select("key"), after or None, int(count), p),
    "DBSIZE": lambda ks: ks.types().agg(F.count("*").alias("n")),
    "SLOT": lambda ks, k: ks.spark.range(1).select(slot(F.lit(k)).alias("slot")),
    "TTL": lambda ks, k, now: keyspace.ttl(_one(ks, "expiry", k), F.lit(now).cast("timestamp_ntz")).select("ttl", "pttl"),
    "HGET": lambda ks, k, f: _one(ks, "hash", k).where(F.col("field") == f).select("value"),
    "HMGET": lambda ks, k, *f: strings.mget(_asked(ks, f, "field"), _one(ks, "hash", k), "field").orderBy("pos"),
    "HGETALL": lambda ks, k: _one(ks, "hash", k).select("field", "value"),
    "HKEYS": lambda ks, k: _one(ks, "hash", k).select("field"),
    "HVALS": lambda ks, k: _one(ks, "hash", k).select("value"),
    "HLEN": lambda ks, k: _one(ks, "hash", k).agg(F.count("*").alias("n")),
    "HEXISTS": lambda ks, k, f: _one(ks, "hash", k).agg(F.count_if(F.col("field") == f).alias("n")),
    "HSCAN": lambda ks, k, after, count="10", p="*": keyspace.scan_page(_one(ks, "hash", k), after or None, int(count), p, "field"),
    "SMEMBERS": lambda ks, k: _one(ks, "set", k).select("member"),
    "SCARD": lambda ks, k: _one(ks, "set", k).agg(F.count_distinct("member").alias("n")),
    "SISMEMBER": lambda ks, k, m: _one(ks, "set", k).agg(F.count_if(F.col("member") == m).alias("is_member")),
    "SMISMEMBER": lambda ks, k, *m: c.is_member(_asked(ks, m, "member").withColumn("key", F.lit(k)), ks["set"]).orderBy("pos"),
    "SUNION": lambda ks, *k: c.union(ks["set"], list(k)),
    "SINTER": lambda ks, *k: c.inter(ks["set"], list(k)),
    "SDIFF": lambda ks, *k: c.diff(ks["set"], list(k)),
    "SRANDMEMBER": lambda ks, k, n="1": keyspace.pick(_one(ks, "set", k), ["key"], "member", abs(int(n)), repeat=int(n) < 0).select("member"),
    "HRANDFIELD": lambda ks, k, n="1": keyspace.pick(_one(ks, "hash", k), ["key"], "field", abs(int(n)), repeat=int(n) < 0).select("field", "value"),
    "SSCAN": lambda ks, k, after, count="10", p="*": keyspace.scan_page(_one(ks, "set", k), after or None, int(count), p, "member"),
    "LLEN": lambda ks, k: _one(ks, "list", k).agg(F.count("*").alias("n")),
    "LRANGE": lambda ks, k, a, b: c.lrange(_one(ks, "list", k), int(a), int(b)).orderBy("index").select("elem"),
    "LINDEX": lambda ks, k, i: c.lindex(_one(ks, "list", k), int(i)).select("elem"),
    "LPOS": lambda ks, k, v, rank="1", count="1", maxlen="0": c.lpos(_one(ks, "list", k), v, int(rank), int(count), int(maxlen)).select("index"),
    "ZSCORE": lambda ks, k, m: _one(ks, "zset", k).where(F.col("member") == m).select("score"),
    "ZMSCORE": lambda ks, k, *m: strings.mget(_asked(ks, m, "member"), _one(ks, "zset", k), "member", "score").orderBy("pos"),
    "ZCARD": lambda ks, k: _one(ks, "zset", k).agg(F.count("*").alias("n")),
    "ZRANK": lambda ks, k, m: zsets.ranked(_one(ks, "zset", k)).where(F.col("member") == m).select("rank"),
    "ZREVRANK": lambda ks, k, m: zsets.ranked(_one(ks, "zset", k), True).where(F.col("member") == m).select("rank"),
    "ZRANGE": lambda ks, k, a, b, *_: _rank(ks, k, a, b, False).orderBy("rank").select("member", "score"),
    "ZREVRANGE": lambda ks, k, a, b, *_: _rank(ks, k, a, b, True).orderBy("rank").select("member", "score"),
    "ZRANGEBYSCORE": lambda ks, k, a, b, *args: zsets.zrange_by_score(_one(ks, "zset", k), a, b, False, *_limit(args)).orderBy("score", "member").select("member", "score"),
    "ZRANGEBYLEX": lambda ks, k, a, b, *args: zsets.zrange_by_lex(_one(ks, "zset", k), a, b, *_limit(args)).orderBy("member").select("member"),
    "ZCOUNT": lambda ks, k, a, b: zsets.zcount(_one(ks, "zset", k), a, b).select("n"),
    "ZLEXCOUNT": lambda ks, k, a, b: zsets.zlexcount(_one(ks, "zset", k), a, b).select("n"),
    "ZSCAN": lambda ks, k, after, count="10", p="*": keyspace.scan_page(_one(ks, "zset", k), after or None, int(count), p, "member"),
    "GEOPOS": lambda ks, k, *m: strings.mget(_asked(ks, m, "member"), _one(ks, "geo", k).withColumn("at", geo.position(geo.score(F.col("lon"), F.col("lat")))), "member", "at").orderBy("pos"),
    "GEOHASH": lambda ks, k, *m: strings.mget(_asked(ks, m, "member"), _one(ks, "geo", k).withColumn("hash", geo.geohash(geo.score(F.col("lon"), F.col("lat")))), "member", "hash").orderBy("pos"),
    "GEODIST": lambda ks, k, a, b, unit="m": _one(ks, "geo", k).where(F.col("member") == a).select(F.col("lon").alias("x"), F.col("lat").alias("y")).join(_one(ks, "geo", k).where(F.col("member") == b), F.lit(True)).select(geo.distance(F.col("x"), F.col("y"), F.col("lon"), F.col("lat"), unit).alias("dist")),
    "GEORADIUS": _geo_radius,
    "XLEN": lambda ks, k: _one(ks, "stream", k).agg(F.count("*").alias("n")),
    "XRANGE": lambda ks, k, a, b, *n: streams.xrange(_one(ks, "stream", k), a, b, int(n[1]) if n else None).orderBy("ts_ms", "seq"),
    "XREVRANGE": lambda ks, k, b, a, *n: streams.xrange(_one(ks, "stream", k), a, b, int(n[1]) if n else None, True).orderBy(F.col("ts_ms").desc(), F.col("seq").desc()),
    "XINFO": lambda ks, k: streams.xinfo(_one(ks, "stream", k)),
    "JSON.GET": lambda ks, k, path="$": _one(ks, "json", k).select(jsondoc.get(F.col("doc"), path).alias("value")),
    "JSON.TYPE": lambda ks, k, path="$": _one(ks, "json", k).select(jsondoc.kind(F.col("doc"), path).alias("type")),
    "JSON.ARRLEN": lambda ks, k, path="$": _one(ks, "json", k).select(jsondoc.arr_len(F.col("doc"), path).alias("n")),
    "JSON.OBJLEN": lambda ks, k, path="$": _one(ks, "json", k).select(jsondoc.obj_len(F.col("doc"), path).alias("n")),
    "JSON.OBJKEYS": lambda ks, k, path="$": _one(ks, "json", k).select(F.explode(jsondoc.obj_keys(F.col("doc"), path)).alias("key")),
    "SORT": lambda ks, k, *args: _sort(ks, k, args),
    "PING": lambda ks, text="PONG": ks.spark.range(1).select(F.lit(text).alias("reply")),
    "ECHO": lambda ks, text: ks.spark.range(1).select(F.lit(text).alias("reply")),
    "TIME": lambda ks: ks.spark.range(1).select(F.unix_seconds(F.current_timestamp()).alias("seconds"), (F.unix_micros(F.current_timestamp()) % 1000000).alias("micros")),
    "COMMAND": lambda ks: ks.spark.createDataFrame([(n, "read") for n in sorted(READS)] + [(n, "write") for n in sorted(WRITES)], "name string, kind string"),
}


def _sort(ks: Keyspace, key: str, args: tuple[str, ...]) -> DataFrame:
    elems = _one(ks, "list", key).select("elem").unionByName(_one(ks, "set", key).select(F.col("member").alias("elem")))
    options: dict = {"get": []}
    i = 0
    while i < len(args):
        word = args[i].upper()
        if word in ("ASC", "DESC", "ALPHA"):
            options |= {"desc": word == "DESC"} if word != "ALPHA" else {"alpha": True}
            i += 1
        elif word == "LIMIT":
            options |= {"offset": int(args[i + 1]), "limit": int(args[i + 2])}
            i += 3
        elif word == "BY":
            options["by"] = args[i + 1]
            i += 2
        elif word == "GET":
            options["get"].append(args[i + 1])
            i += 2
        else:
            raise ValueError(f"SORT does not know {args[i]}")
    options["get"] = tuple(options["get"]) or ("#",)
    return sorting.sort(elems, strings=ks["string"], hashes=ks["hash"], **options).orderBy("pos")


def _rows(ks: Keyspace, kind: str, *rows: tuple) -> DataFrame:
    return ks.spark.createDataFrame(list(rows), SCHEMAS[kind])


def _incr(ks: Keyspace, key: str, by: int) -> Keyspace:
    old = _one(ks, "string", key).select(F.col("value").cast("bigint").alias("d"))
    new = old.unionByName(ks.spark.createDataFrame([(by,)], "d long")).agg(F.lit(key).alias("key"), F.sum("d").cast("string").alias("value"))
    return ks.upsert("string", new)


def _push(ks: Keyspace, key: str, values: tuple[str, ...], left: bool, only: bool = False) -> Keyspace:
    batch = ks.spark.createDataFrame([(key, i, v) for i, v in enumerate(values)], "key string, seq int, elem string")
    return ks.put("list", c.push(ks["list"], batch, left, only))


def _pairs(args: tuple[str, ...]) -> list[tuple[str, str]]:
    if not args or len(args) % 2:
        raise ValueError("pairs are needed")
    return list(zip(args[::2], args[1::2], strict=True))


def _zadd(ks: Keyspace, key: str, *args: str) -> Keyspace:
    flags = []
    while args and args[0].upper() in ("NX", "XX", "GT", "LT", "CH"):
        flags.append(args[0].upper())
        args = args[1:]
    mode = next((f for f in flags if f != "CH"), "")
    batch = _rows(ks, "zset", *((key, m, float(s)) for s, m in _pairs(args)))
    return ks.put("zset", zsets.zadd_to(ks["zset"], batch, mode).select("key", "member", "score"))


def _json(change: Callable[..., object]) -> Callable[..., Keyspace]:
    def run(ks: Keyspace, key: str, *args: str) -> Keyspace:
        return ks.put("json", ks["json"].withColumn("doc", F.when(F.col("key") == key, change(*args)(F.col("doc"))).otherwise(F.col("doc"))))

    return run


def _members(kind: str, column: str) -> Callable[..., Keyspace]:
    def run(ks: Keyspace, key: str, *names: str) -> Keyspace:
        return ks.put(kind, ks[kind].where(~((F.col("key") == key) & F.col(column).isin(list(names)))))

    return run


def _keep(ks: Keyspace, kind: str, key: str, kept: DataFrame) -> Keyspace:
    return ks.put(kind, ks[kind].where(F.col("key") != key).unionByName(kept.select(*ks[kind].columns)))


def _rename(ks: Keyspace, src: str, dst: str, only_new: bool = False) -> Keyspace:
    if only_new and not ks.types().where(F.col("key") == dst).isEmpty():
        return ks
    moved = F.when(F.col("key") == src, F.lit(dst)).otherwise(F.col("key"))
    return replace(ks, tables={k: df.where(F.col("key") != dst).withColumn("key", moved) for k, df in ks.tables.items()})


def _xadd(ks: Keyspace, key: str, entry: str, *fields: str) -> Keyspace:
    ms, seq = streams.parse_id(entry)
    top = _one(ks, "stream", key).agg(F.max(F.struct("ts_ms", "seq")).alias("t")).first()["t"]
    if top is not None and (ms, seq) <= (top["ts_ms"], top["seq"]):
        raise ValueError("the id must exceed the last one")
    return ks.put("stream", ks["stream"].unionByName(_rows(ks, "stream", (key, ms, seq, dict(_pairs(fields))))))


WRITES: dict[str, tuple[str | None, Callable[..., Keyspace]]] = {
    "SET": ("string", lambda ks, k, v, *o: ks if o and o[0].upper() in ("NX", "XX") and (o[0].upper() == "NX") != _one(ks, "string", k).isEmpty() else ks.upsert("string", _rows(ks, "string", (k, v)))),
    "MSET": (None, lambda ks, *kv: ks.upsert("string", _rows(ks, "string", *_pairs(kv)))),
    "MSETNX": (None, lambda ks, *kv: ks.put("string", strings.msetnx(ks["string"], _rows(ks, "string", *_pairs(kv))))),
    "APPEND": ("string", lambda ks, k, v: ks.upsert("string", _one(ks, "string", k).select("value").unionByName(ks.spark.createDataFrame([("",)], "value string")).agg(F.lit(k).alias("key"), F.concat(F.max("value"), F.lit(v)).alias("value")))),
    "INCR": ("string", lambda ks, k: _incr(ks, k, 1)), "DECR": ("string", lambda ks, k: _incr(ks, k, -1)),
    "INCRBY": ("string", lambda ks, k, n: _incr(ks, k, int(n))), "DECRBY": ("string", lambda ks, k, n: _incr(ks, k, -int(n))),
    "DEL": (None, lambda ks, *k: ks.without(list(k))), "UNLINK": (None, lambda ks, *k: ks.without(list(k))),
    "FLUSHDB": (None, lambda ks: Keyspace.of(ks.spark)), "FLUSHALL": (None, lambda ks: Keyspace.of(ks.spark)),
    "RENAME": (None, _rename), "RENAMENX": (None, lambda ks, a, b: _rename(ks, a, b, True)),
    "EXPIREAT": (None, lambda ks, k, at: ks.upsert("expiry", ks.spark.range(1).select(F.lit(k).alias("key"), F.lit(at).cast("timestamp_ntz").alias("expire_at")))),
    "PERSIST": (None, lambda ks, k: ks.put("expiry", ks["expiry"].where(F.col("key") != k))),
    "HSET": ("hash", lambda ks, k, *fv: ks.upsert("hash", _rows(ks, "hash", *((k, f, v) for f, v in _pairs(fv))))),
    "HSETNX": ("hash", lambda ks, k, f, v: ks.put("hash", ks["hash"].unionByName(_rows(ks, "hash", (k, f, v)).join(ks["hash"].select("key", "field"), ["key", "field"], "left_anti").select("key", "field", "value")))),
    "HDEL": ("hash", _members("hash", "field")), "SREM": ("set", _members("set", "member")), "ZREM": ("zset", _members("zset", "member")),
    "SADD": ("set", lambda ks, k, *m: ks.upsert("set", _rows(ks, "set", *((k, x) for x in dict.fromkeys(m))))),
    "SMOVE": ("set", lambda ks, a, b, m: ks.put("set", c.move_members(ks["set"], ks.spark.createDataFrame([(a, b, m)], "src string, dst string, member string")))),
    "SUNIONSTORE": (None, lambda ks, d, *k: ks.without([d]).put("set", ks["set"].where(F.col("key") != d).unionByName(c.union(ks["set"], list(k)).select(F.lit(d).alias("key"), "member")))),
    "SINTERSTORE": (None, lambda ks, d, *k: ks.without([d]).put("set", ks["set"].where(F.col("key") != d).unionByName(c.inter(ks["set"], list(k)).select(F.lit(d).alias("key"), "member")))),
    "SDIFFSTORE": (None, lambda ks, d, *k: ks.without([d]).put("set", ks["set"].where(F.col("key") != d).unionByName(c.diff(ks["set"], list(k)).select(F.lit(d).alias("key"), "member")))),
    "LPUSH": ("list", lambda ks, k, *v: _push(ks, k, v, True)), "RPUSH": ("list", lambda ks, k, *v: _push(ks, k, v, False)),
    "LPUSHX": ("list", lambda ks, k, *v: _push(ks, k, v, True, True)), "RPUSHX": ("list", lambda ks, k, *v: _push(ks, k, v, False, True)),
    "LPOP": ("list", lambda ks, k: _keep(ks, "list", k, c.pop(_one(ks, "list", k), True)[1])), "RPOP": ("list", lambda ks, k: _keep(ks, "list", k, c.pop(_one(ks, "list", k), False)[1])),
    "LTRIM": ("list", lambda ks, k, a, b: _keep(ks, "list", k, c.lrange(_one(ks, "list", k), int(a), int(b)))),
    "LREM": ("list", lambda ks, k, n, v: _keep(ks, "list", k, c.lrem(_one(ks, "list", k), int(n), v))),
    "LSET": ("list", lambda ks, k, i, v: _keep(ks, "list", k, c.lset(_one(ks, "list", k), int(i), v))),
    "LINSERT": ("list", lambda ks, k, where, pivot, v: _keep(ks, "list", k, c.linsert(_one(ks, "list", k), pivot, v, where.upper() == "BEFORE").withColumnRenamed("index", "pos"))),
    "LMOVE": ("list", lambda ks, a, b, x, y: ks.put("list", c.lmove(ks["list"], a, b, x.upper() == "LEFT", y.upper() == "LEFT"))),
    "ZADD": ("zset", _zadd),
    "ZINCRBY": ("zset", lambda ks, k, n, m: ks.upsert("zset", _one(ks, "zset", k).where(F.col("member") == m).unionByName(_rows(ks, "zset", (k, m, float(n)))).groupBy("key", "member").agg(F.sum("score").alias("score")))),
    "ZREMRANGEBYRANK": ("zset", lambda ks, k, a, b: _keep(ks, "zset", k, zsets.zremrange(_one(ks, "zset", k), int(a), int(b)))),
    "ZREMRANGEBYSCORE": ("zset", lambda ks, k, a, b: _keep(ks, "zset", k, zsets.zremrange_by_score(_one(ks, "zset", k), a, b))),
    "ZREMRANGEBYLEX": ("zset", lambda ks, k, a, b: _keep(ks, "zset", k, zsets.zremrange_by_lex(_one(ks, "zset", k), a, b))),
    "ZPOPMIN": ("zset", lambda ks, k, n="1": _keep(ks, "zset", k, zsets.zpop(_one(ks, "zset", k), int(n))[1])),
    "ZPOPMAX": ("zset", lambda ks, k, n="1": _keep(ks, "zset", k, zsets.zpop(_one(ks, "zset", k), int(n), True)[1])),
    "ZUNIONSTORE": (None, lambda ks, d, n, *args: ks.without([d]).put("zset", ks["zset"].where(F.col("key") != d).unionByName(_stored(ks, (n,), args, False).select(F.lit(d).alias("key"), "member", "score")))),
    "ZINTERSTORE": (None, lambda ks, d, n, *args: ks.without([d]).put("zset", ks["zset"].where(F.col("key") != d).unionByName(_stored(ks, (n,), args, True).select(F.lit(d).alias("key"), "member", "score")))),
    "GEOADD": ("geo", lambda ks, k, lon, lat, m: ks.upsert("geo", _rows(ks, "geo", (k, m, float(lon), float(lat))))),
    "XADD": ("stream", _xadd),
    "XDEL": ("stream", lambda ks, k, *ids: ks.put("stream", ks["stream"].where(~((F.col("key") == k) & streams.entry_id().isin(["-".join(map(str, streams.parse_id(i))) for i in ids]))))),
    "XTRIM": ("stream", lambda ks, k, how, n: _keep(ks, "stream", k, streams.xtrim_maxlen(_one(ks, "stream", k), int(n)) if how.upper() == "MAXLEN" else streams.xtrim_minid(_one(ks, "stream", k), n))),
    "JSON.SET": ("json", lambda ks, k, path, value, mode="": ks.upsert("json", _rows(ks, "json", (k, value))) if path in ("$", ".") else _json(lambda: jsondoc.set_value(path, _parsed(value), mode.upper()))(ks, k)),
    "JSON.DEL": ("json", _json(lambda path="$": jsondoc.remove(path))), "JSON.TOGGLE": ("json", _json(jsondoc.toggle)), "JSON.CLEAR": ("json", _json(lambda path="$": jsondoc.clear(path))),
    "JSON.NUMINCRBY": ("json", _json(lambda path, n: jsondoc.incr(path, float(n)))), "JSON.NUMMULTBY": ("json", _json(lambda path, n: jsondoc.mult(path, float(n)))),
    "JSON.STRAPPEND": ("json", _json(lambda path, s: jsondoc.str_append(path, _parsed(s)))), "JSON.ARRAPPEND": ("json", _json(lambda path, *v: jsondoc.arr_append(path, *map(_parsed, v)))),
    "JSON.ARRINSERT": ("json", _json(lambda path, i, *v: jsondoc.arr_insert(path, int(i), *map(_parsed, v)))), "JSON.ARRPOP": ("json", _json(lambda path="$", i="-1": jsondoc.arr_pop(path, int(i)))),
    "JSON.ARRTRIM": ("json", _json(lambda path, a, b: jsondoc.arr_trim(path, int(a), int(b)))), "JSON.MERGE": ("json", _json(lambda path, v: jsondoc.merge(path, _parsed(v)))),
}


def _parsed(text: str) -> object:
    import json

    return json.loads(text)


def run_script(ks: Keyspace, lines: list[str]) -> Keyspace:
    """MULTI ... EXEC of write commands: all or, if one fails, none, since a keyspace is never changed in place."""
    for line in lines:
        ks = ks.write(line)
    return ks


