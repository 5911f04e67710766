"""Further commands of every family, each over all keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions import jsonpath
from keyloom.functions.scripts import Scripts
from keyloom.operators import cache, geo, jsondoc, keyspace, pubsub, sketch, streams, strings
from keyloom.operators import collections as c
from keyloom.operators import zsets as z
from keyloom.plans import collection_queries, stream_queries, string_queries, zset_queries
from keyloom.plans.catalogue import Tables, query

SQL_LIST = collection_queries.LIST_SQL


@query("SELECT 'customer:' || c_custkey AS key, c_name AS value, CASE WHEN c_custkey <= 50 THEN 'got' ELSE 'left' END AS part FROM customer")
def str_getdel(t: Tables) -> DataFrame:
    asked = t.customer.where("c_custkey <= 50").select(F.concat(F.lit("customer:"), "c_custkey").alias("key"))
    got, left = strings.getdel(string_queries._customers(t), asked)
    return got.withColumn("part", F.lit("got")).unionByName(left.withColumn("part", F.lit("left")))


@query("SELECT event_id AS key, ts + to_microseconds(CAST(event_id % 7 AS BIGINT) * 1500000) AS expire_at FROM events WHERE event_id % 7 > 0")
def str_setex(t: Tables) -> DataFrame:
    return strings.setex(t.events.select(F.col("event_id").alias("key"), "ts"), F.col("ts"), F.col("key") % 7 * F.lit(1.5)).select("key", "expire_at")


@query("SELECT o_orderkey AS key, o_orderkey % 10 = 0 AS forever FROM orders WHERE o_orderkey % 10 = 0 OR o_orderdate > TIMESTAMP '1998-01-01'")
def key_persist(t: Tables) -> DataFrame:
    rows = keyspace.expire(t.orders, F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")))  # a null expiry is PERSIST
    return keyspace.live(rows, F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")).select(F.col("o_orderkey").alias("key"), F.col("expire_at").isNull().alias("forever"))


@query("""
SELECT key, CAST(sum(b) + strlen(key) AS BIGINT) AS bytes FROM (
SELECT 'c:' || c_custkey AS key, strlen(c_name) AS b FROM customer UNION ALL SELECT 'c:' || o_custkey, strlen(CAST(o_orderkey AS VARCHAR)) + strlen(o_orderstatus) FROM orders) GROUP BY key
""")
def key_memory(t: Tables) -> DataFrame:
    named = t.customer.select(F.concat(F.lit("c:"), "c_custkey").alias("key"), "c_name")
    return keyspace.memory_usage({"string": named, "hash": t.orders.select(F.concat(F.lit("c:"), "o_custkey").alias("key"), "o_orderkey", "o_orderstatus")})


@query("""
WITH r AS (SELECT c_custkey AS key, c_nationkey AS uses, c_custkey % 3 > 0 AS volatile, 100 AS size FROM customer),
o AS (SELECT *, sum(size) OVER (ORDER BY uses, key ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS everything FROM r WHERE volatile)
SELECT key FROM o WHERE everything + (SELECT sum(size) FROM r WHERE NOT volatile) - before > 90000
""")
def key_evict_lfu(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("uses"), F.lit(0).alias("last_access"), F.when(F.col("c_custkey") % 3 > 0, F.lit(1)).alias("expire_at"), F.lit(100).alias("size"))
    return keyspace.evict_by(rows, "volatile-lfu", "size", 90000).select("key")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT c_mktsegment FROM customer UNION SELECT n_name FROM nation)")
def key_dbsize(t: Tables) -> DataFrame:
    return keyspace.catalogue({"set": t.customer.select(F.col("c_mktsegment").alias("key")), "string": t.nation.select(F.col("n_name").alias("key"))}).agg(F.count("*").alias("n"))


@query("""
SELECT key, field FROM (SELECT key, field, row_number() OVER (PARTITION BY key ORDER BY field) AS n
FROM (SELECT DISTINCT user_id AS key, event_type AS field FROM events) WHERE field > 'click' AND field LIKE '%e%') WHERE n <= 2
""")
def hash_hscan(t: Tables) -> DataFrame:
    hashes = t.events.select(F.col("user_id").alias("key"), F.col("event_type").alias("field")).distinct()
    return keyspace.scan_pages(hashes, ["key"], "field", "click", 2, "*e*")


@query("""
SELECT key, member FROM (SELECT key, member, row_number() OVER (PARTITION BY key ORDER BY member) AS n
FROM (SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS key, l_partkey AS member FROM lineitem) WHERE member > 100) WHERE n <= 10
""")
def set_sscan(t: Tables) -> DataFrame:
    sets = t.lineitem.select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("member")).distinct()
    return keyspace.scan_pages(sets, ["key"], "member", 100, 10)


@query(f"WITH {zset_queries.BOARD_SQL} SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) AS n FROM b WHERE member > 50) WHERE n <= 5")
def zset_zscan(t: Tables) -> DataFrame:
    return keyspace.scan_pages(zset_queries._board(t), ["key"], "member", 50, 5).select("key", "member", "score")


_SET_SQL = """
l AS (SELECT user_id AS key, event_id AS seq, event_type AS value, event_type = 'signup' AS nx, event_type = 'click' AS xx, event_type = 'view' AS keepttl,
    CASE WHEN event_type <> 'error' AND event_type <> 'view' THEN ts + INTERVAL 1 DAY END AS expire_at FROM events),
f AS (SELECT key, min(seq) AS born FROM l WHERE NOT xx GROUP BY 1), a AS (SELECT l.*, born FROM l JOIN f USING (key) WHERE seq = born OR (seq > born AND NOT nx))
"""


def _sets(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    lifetime = F.when(~kind.isin("error", "view"), F.col("ts") + F.make_dt_interval(days=F.lit(1)))
    return t.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), kind.alias("value"), (kind == "signup").alias("nx"), (kind == "click").alias("xx"), (kind == "view").alias("keepttl"), lifetime.alias("expire_at"))


@query(f"WITH {_SET_SQL} SELECT key, arg_max(value, seq) AS value, strftime(arg_max(expire_at, seq) FILTER (NOT keepttl AND seq = z), '%Y-%m-%d %H:%M:%S.%f') AS expire_at FROM (SELECT *, max(CASE WHEN NOT keepttl THEN seq END) OVER (PARTITION BY key) AS z FROM a) GROUP BY 1")
def str_set_options(t: Tables) -> DataFrame:
    return strings.set_options(_sets(t), ["key"]).select("key", "value", F.date_format("expire_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("expire_at"))


@query(f"WITH {_SET_SQL}, h AS (SELECT key, seq, value FROM a) SELECT l.key, l.seq, max_by(h.value, h.seq) AS old FROM l LEFT JOIN h ON h.key = l.key AND h.seq < l.seq GROUP BY ALL")
def str_set_get(t: Tables) -> DataFrame:
    return strings.set_returns(_sets(t), ["key"]).select("key", "seq", "old")


@query("""
SELECT o_orderkey AS key, o_orderstatus AS value, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN CAST(o_orderdate + INTERVAL 2 DAY AS VARCHAR) ELSE CAST(o_orderdate + INTERVAL 30 DAY AS VARCHAR) END AS expire_at FROM orders
""")
def str_getex(t: Tables) -> DataFrame:
    table = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"), (F.col("o_orderdate") + F.make_dt_interval(days=F.lit(30))).alias("expire_at"))
    k = F.col("o_orderkey")
    asked = t.orders.where(k % 3 < 2).select(k.alias("key"), (k % 3 == 0).alias("persist"), F.when(k % 3 == 1, F.col("o_orderdate") + F.make_dt_interval(days=F.lit(2))).alias("new_expire_at"))
    return strings.getex(table, asked).select("key", "value", F.date_format("expire_at", "yyyy-MM-dd HH:mm:ss").alias("expire_at"))


@query()
def set_spop(t: Tables) -> DataFrame:
    sets = t.customer.select(F.col("c_mktsegment").alias("key"), F.col("c_nationkey").alias("member")).distinct()
    return sets.join(keyspace.pick(sets, ["key"], "member", 5), ["key", "member"], "left_anti")


@query("SELECT 'all' AS key, n_nationkey AS member FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING') AND n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def set_sinterstore(t: Tables) -> DataFrame:
    sets = t.customer.select(F.col("c_mktsegment").alias("key"), F.col("c_nationkey").alias("member"))
    return c.inter(sets, ["BUILDING", "MACHINERY"]).select(F.lit("all").alias("key"), "member")


@query("SELECT user_id AS key, count(*) AS n FROM events GROUP BY 1")
def list_llen(t: Tables) -> DataFrame:
    return c.hlen(collection_queries._list(t))


@query(f"WITH {SQL_LIST} SELECT key, pos, elem FROM l WHERE index = n - 1")
def list_rpop(t: Tables) -> DataFrame:
    return c.pop(collection_queries._list(t), left=False)[0]


@query(f"WITH {SQL_LIST} SELECT CASE WHEN key = 7 AND index = 0 THEN 8 ELSE key END AS key, CASE WHEN key = 7 AND index = 0 THEN (SELECT max(event_id) + 1 FROM events WHERE user_id = 8) ELSE pos END AS pos, elem FROM l")
def list_lmove(t: Tables) -> DataFrame:
    return c.lmove(collection_queries._list(t), 7, 8, True, False)


@query(f"WITH {zset_queries.BOARD_SQL}, r AS (SELECT n_nationkey AS pos, n_name AS key, n_nationkey * 50 AS member FROM nation) SELECT r.pos, r.key, r.member, b.score FROM r LEFT JOIN b USING (key, member)")
def zset_zmscore(t: Tables) -> DataFrame:
    asked = t.nation.select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("key"), (F.col("n_nationkey") * 50).cast("int").alias("member"))
    return asked.join(zset_queries._board(t), ["key", "member"], "left").select("pos", "key", "member", "score")


@query("SELECT event_type AS key, user_id AS member, round(sum(value), 3) AS score FROM events GROUP BY 1, 2")
def zset_zincrby(t: Tables) -> DataFrame:
    log = t.events.select(F.col("event_type").alias("key"), F.col("user_id").alias("member"), F.col("value").alias("score"), F.col("event_id").alias("seq"))
    return z.zadd(log, "INCR").withColumn("score", F.round("score", 3))


@query(f"WITH {zset_queries.RANKED_SQL} SELECT key, member, rev AS rank FROM r")
def zset_zrevrank(t: Tables) -> DataFrame:
    return z.ranked(zset_queries._board(t), True).select("key", "member", "rank")


@query("SELECT o_custkey AS key, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS hits FROM orders WHERE o_totalprice > 250000 GROUP BY 1")
def json_path(t: Tables) -> DataFrame:
    docs = t.orders.groupBy(F.col("o_custkey").alias("key")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")))).alias("orders"))).alias("doc"))
    hits = docs.select("key", jsonpath.query("$..orders[?(@.price > 250000)].id")(F.col("doc")).alias("hits")).where("hits <> '[]'")
    return hits.select("key", F.regexp_replace("hits", r"[\[\]]", "").alias("hits"))


@query("SELECT r.user_id AS pos, max_by(props ->> '$.k', event_id) AS value FROM (SELECT DISTINCT user_id FROM events) r LEFT JOIN events e ON e.user_id = r.user_id GROUP BY 1")
def json_mget(t: Tables) -> DataFrame:
    last = keyspace.last_write(t.events.select("user_id", "props", "event_id"), ["user_id"], ["props"], "event_id")
    asked = t.events.select("user_id").distinct()
    return asked.join(last, "user_id", "left").select(F.col("user_id").alias("pos"), jsondoc.get(F.col("props"), "$.k").alias("value"))


@query("SELECT c_custkey AS key, 'name,nation' AS keys, CAST(2 AS BIGINT) AS n, CAST(strlen(c_name) AS BIGINT) AS bytes FROM customer")
def json_obj(t: Tables) -> DataFrame:
    d = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")))
    return t.customer.select(F.col("c_custkey").alias("key"), F.array_join(jsondoc.obj_keys(d), ",").alias("keys"), jsondoc.obj_len(d).alias("n"), jsondoc.str_len(d, "$.name").alias("bytes"))


@query("SELECT CAST(20000 AS BIGINT) AS capacity, CAST(ceil(ceil(-20000 * ln(0.01) / pow(ln(2), 2)) / 8) AS BIGINT) AS bytes, CAST(7 AS BIGINT) AS hashes")
def bf_info(t: Tables) -> DataFrame:
    bits, hashes = sketch.bloom_size(20000, 0.01)
    return t.spark.range(1).select(F.lit(20000).cast("bigint").alias("capacity"), F.lit(bits // 8).cast("bigint").alias("bytes"), F.lit(hashes).cast("bigint").alias("hashes"))


@query(f"WITH {zset_queries.POINTS_SQL}, o AS (SELECT -30.0::DOUBLE AS lon, 10.0::DOUBLE AS lat) SELECT key, member FROM p, o WHERE {zset_queries._haversine('o.', 'p.')} <= 3000000")
def geo_radius_point(t: Tables) -> DataFrame:
    p = zset_queries._points(t)
    centres = p.select("key").distinct().select("key", F.lit("x").alias("centre"), F.lit(-30.0).alias("clon"), F.lit(10.0).alias("clat"))
    return geo.radius(p, centres, 3000, "km").select("key", "member")


@query(f"WITH {stream_queries.STREAM_SQL} SELECT key, ts_ms, seq FROM s WHERE event_id % 4 <> 0")
def x_del(t: Tables) -> DataFrame:
    s = stream_queries._stream(t)
    return keyspace.delete(s, s.where("event_id % 4 = 0"), ["key", "ts_ms", "seq"]).select("key", "ts_ms", "seq")


@query(f"WITH {stream_queries.DELIVERED_SQL} SELECT key, arg_max(ts_ms || '-' || seq, (ts_ms, seq)) AS last_delivered, count(*) AS entries_read, count(DISTINCT consumer) AS consumers FROM g GROUP BY 1")
def x_group(t: Tables) -> DataFrame:
    return streams.group_cursor(stream_queries._group(t))


@query(f"WITH {stream_queries.DELIVERED_SQL} SELECT key, ts_ms, seq FROM pel WHERE consumer = 'c1'")
def x_history(t: Tables) -> DataFrame:
    return streams.history(stream_queries._pel(t), "c1").select("key", "ts_ms", "seq")


@query(f"WITH {stream_queries.DELIVERED_SQL} SELECT key, count(*) AS n FROM pel WHERE consumer <> 'c2' GROUP BY 1")
def x_delconsumer(t: Tables) -> DataFrame:
    return c.hlen(streams.del_consumer(stream_queries._pel(t), "c2"))


@query("WITH r AS (SELECT page_id % 20 AS key, page_id AS variant, row_number() OVER (PARTITION BY page_id % 20 ORDER BY page_id DESC) AS n FROM pages) SELECT key, variant FROM r WHERE n <= 3")
def cache_variants(t: Tables) -> DataFrame:
    v = t.pages.select((F.col("page_id") % 20).alias("key"), F.col("page_id").alias("variant"), F.col("page_id").alias("last_access"))
    return cache.keep_variants(v, 3).select("key", "variant")


@query("SELECT page_id, CAST(page_id % 100 AS BIGINT) AS ttl, CAST(CASE WHEN page_id % 2 = 0 THEN 30 ELSE -1 END AS BIGINT) AS swr FROM pages")
def cache_control(t: Tables) -> DataFrame:
    header = F.concat(F.lit("public, max-age="), F.col("page_id") % 100, F.when(F.col("page_id") % 2 == 0, F.lit(", stale-while-revalidate=30")).otherwise(F.lit("")))
    return t.pages.select("page_id", *(F.coalesce(v, F.lit(-1)).cast("bigint").alias(k) for k, v in cache.cache_control(header).items()))


@query("SELECT event_id, event_id % 3 = 0 AS not_modified FROM events")
def cache_conditional(t: Tables) -> DataFrame:
    tag = F.concat(F.lit('"'), F.col("event_id"), F.lit('"'))
    asked = F.when(F.col("event_id") % 3 == 0, tag).otherwise(F.lit('"old"'))
    return t.events.select("event_id", cache.not_modified(tag, F.col("ts"), asked, F.lit(None).cast("timestamp_ntz")).alias("not_modified"))


@query("SELECT DISTINCT event_type AS channel FROM events WHERE event_type LIKE '%i%'")
def pubsub_channels(t: Tables) -> DataFrame:
    from keyloom.functions.columns import matches

    subs = t.events.select(F.col("event_type").alias("channel"), F.col("user_id").alias("subscriber"))
    return pubsub.numsub(subs).where(matches(F.col("channel"), "*i*")).select("channel")


def _discount(price: pd.Series, share: pd.Series) -> pd.Series:
    return price * (1 - share)


@query("SELECT round(sum(l_extendedprice * (1 - l_discount)), 0) AS total FROM lineitem")
def script_eval(t: Tables) -> DataFrame:
    scripts = Scripts()
    sha = scripts.load(_discount, "double")
    return t.lineitem.select(scripts.call(sha, F.col("l_extendedprice"), F.col("l_discount")).alias("v")).agg(F.round(F.sum("v"), 0).alias("total"))


@query("""SELECT l_shipmode_free AS op, count(*) AS n, CAST(quantile_disc(v, 0.5) AS DOUBLE) AS p50, max(v) AS top FROM (SELECT l_returnflag AS l_shipmode_free, l_quantity AS v FROM lineitem) GROUP BY 1""")
def latency_summary(t: Tables) -> DataFrame:
    """LATENCY and SLOWLOG over a sample table: count, median, maximum by operation."""
    rows = t.lineitem.select(F.col("l_returnflag").alias("op"), F.col("l_quantity").alias("v"))
    return rows.groupBy("op").agg(F.count("*").alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)").alias("p50"), F.max("v").alias("top"))
