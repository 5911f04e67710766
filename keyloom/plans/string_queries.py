"""Strings, counters, bits, keys, JSON and sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.columns import matches, slot
from keyloom.operators import bits, jsondoc, keyspace, sketch, strings, transactions
from keyloom.plans.catalogue import Tables, query

NOW = "TIMESTAMP '1998-01-01 00:00:00'"


def _customers(t: Tables) -> DataFrame:
    return t.customer.select(F.concat(F.lit("customer:"), "c_custkey").alias("key"), F.col("c_name").alias("value"))


@query("""
WITH r AS (SELECT n_nationkey AS pos, 'customer:' || (n_nationkey * 100) AS key FROM nation)
SELECT r.pos, r.key, c.c_name AS value FROM r LEFT JOIN customer c ON r.key = 'customer:' || c.c_custkey
""")
def str_mget(t: Tables) -> DataFrame:
    asked = t.nation.select(F.col("n_nationkey").alias("pos"), F.concat(F.lit("customer:"), F.col("n_nationkey") * 100).alias("key"))
    return strings.mget(asked, _customers(t)).select("pos", "key", "value")


@query("SELECT l_suppkey AS key, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value FROM lineitem GROUP BY 1")
def str_incrby(t: Tables) -> DataFrame:
    return strings.incr_by(t.lineitem.withColumn("key", F.col("l_suppkey")), ["key"], "l_quantity")


@query("SELECT event_id, CAST(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS value FROM events")
def str_incr_returns(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", F.floor("value").alias("delta"))
    return strings.incr_returns(rows, ["user_id"], "delta", "event_id").select("event_id", "value")


@query("SELECT user_id, round(sum(value), 2) AS value FROM events GROUP BY 1")
def str_incrbyfloat(t: Tables) -> DataFrame:
    return strings.incr_by_float(t.events.select("user_id", F.col("value").alias("d")), ["user_id"], "d").select("user_id", F.round("value", 2).alias("value"))


@query("SELECT user_id, arg_max(event_type, event_id) AS last, arg_min(event_type, event_id) AS first FROM events GROUP BY 1")
def str_set_last_nx(t: Tables) -> DataFrame:
    log = t.events.select("user_id", "event_type", "event_id")
    last = keyspace.last_write(log, ["user_id"], ["event_type"], "event_id").withColumnRenamed("event_type", "last")
    return last.join(keyspace.first_write(log, ["user_id"], ["event_type"], "event_id").withColumnRenamed("event_type", "first"), "user_id")


@query("""
SELECT c_custkey AS key, coalesce(arg_max(o_orderpriority, (o_orderdate, o_orderkey)), c_mktsegment) AS value
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment
""")
def str_set_xx(t: Tables) -> DataFrame:
    base = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    log = t.orders.select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), F.struct("o_orderdate", "o_orderkey").alias("seq"))
    return keyspace.overwrite(base, keyspace.last_write(log, ["key"], ["value"]), ["key"])


@query("""
WITH batch AS (SELECT 'customer:' || (s_suppkey + 1000000) AS key, s_name AS value FROM supplier)
SELECT key, value FROM batch UNION ALL SELECT 'customer:' || c_custkey, c_name FROM customer
""")
def str_msetnx(t: Tables) -> DataFrame:
    batch = t.supplier.select(F.concat(F.lit("customer:"), F.col("s_suppkey") + 1000000).alias("key"), F.col("s_name").alias("value"))
    clash = t.supplier.select(F.concat(F.lit("customer:"), "s_suppkey").alias("key"), F.col("s_name").alias("value"))  # void: keys exist
    return strings.msetnx(strings.msetnx(_customers(t), batch), clash)


@query("""
SELECT 'customer:' || c_custkey AS key, coalesce(s_name, c_name) AS value FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey
""")
def str_mset(t: Tables) -> DataFrame:
    return strings.mset(_customers(t), t.supplier.select(F.concat(F.lit("customer:"), "s_suppkey").alias("key"), F.col("s_name").alias("value")))


@query("""
SELECT p_partkey AS key, p_name[2:5] AS mid, p_name[-4:] AS tail, CAST(strlen(p_name) AS BIGINT) AS n,
       left(p_name, 2) || 'XYZ' || substr(p_name, 6) AS put
FROM part
""")
def str_ranges(t: Tables) -> DataFrame:
    v = F.col("p_name")
    return t.part.select(
        F.col("p_partkey").alias("key"), strings.get_range(v, 1, 4).cast("string").alias("mid"), strings.get_range(v, -4, -1).cast("string").alias("tail"),
        strings.strlen(v).alias("n"), strings.set_range(v, 2, "XYZ").cast("string").alias("put"),
    )


@query("SELECT user_id AS key, string_agg(event_type, '' ORDER BY event_id) AS value FROM events GROUP BY 1")
def str_append(t: Tables) -> DataFrame:
    return strings.append(t.events.withColumn("key", F.col("user_id")).withColumnRenamed("value", "number"), ["key"], "event_type", "event_id")


@query("SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS old FROM events")
def str_getset(t: Tables) -> DataFrame:
    return strings.getset(t.events, ["user_id"], "event_type", "event_id").select("event_id", "old")


@query("""
SELECT 'customer:' || c_custkey AS key, c_name AS value FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)
""")
def key_del(t: Tables) -> DataFrame:
    gone = t.orders.select(F.concat(F.lit("customer:"), "o_custkey").alias("key"))
    return keyspace.delete(_customers(t), gone, ["key"])


@query("SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def key_exists(t: Tables) -> DataFrame:
    return keyspace.exists_count(t.orders.select(F.col("o_custkey").alias("key")), t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("key")))


@query("""
SELECT n_name AS key, 'string' AS type FROM nation UNION ALL SELECT DISTINCT c_mktsegment, 'set' FROM customer UNION ALL SELECT DISTINCT event_type, 'zset' FROM events
""")
def key_type(t: Tables) -> DataFrame:
    return keyspace.catalogue({"string": t.nation.select(F.col("n_name").alias("key")), "set": t.customer.select(F.col("c_mktsegment").alias("key")), "zset": t.events.select(F.col("event_type").alias("key"))})


@query("SELECT DISTINCT p_name AS key FROM part WHERE regexp_matches(p_name, '^.*[a-d].e.*$', 's')")
def key_keys(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_name").alias("key")).distinct()
    return names.where(matches(F.col("key"), "*[a-d]?e*"))


@query("SELECT DISTINCT p_name AS key FROM part WHERE p_name > 'b' AND p_name LIKE '%a%' ORDER BY key LIMIT 10")
def scan_page(t: Tables) -> DataFrame:
    return keyspace.scan_page(t.part.select(F.col("p_name").alias("key")).distinct(), "b", 10, "*a*")


@query(f"""
WITH e AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderdate + INTERVAL 30 DAY END AS expire_at FROM orders),
l AS (SELECT key, CAST(epoch_ms(expire_at) - epoch_ms({NOW}) AS BIGINT) AS ms, expire_at FROM e)
SELECT key, CASE WHEN expire_at IS NULL THEN -1 WHEN ms <= 0 THEN -2 ELSE CAST(floor(ms / 1000) AS BIGINT) END AS ttl,
       CASE WHEN expire_at IS NULL THEN -1 WHEN ms <= 0 THEN -2 ELSE ms END AS pttl,
       expire_at IS NULL OR expire_at > {NOW} AS live FROM l
""")
def ttl_live(t: Tables) -> DataFrame:
    now = F.expr(f"CAST({NOW} AS TIMESTAMP_NTZ)")
    rows = t.orders.select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("expire_at"))
    alive = keyspace.live(rows, now).select("key", F.lit(True).alias("live"))
    return keyspace.ttl(rows, now).join(alive, "key", "left").select("key", "ttl", "pttl", F.coalesce("live", F.lit(False)).alias("live"))


@query(f"SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderdate + INTERVAL 30 DAY > {NOW}")
def key_live(t: Tables) -> DataFrame:
    rows = keyspace.expire(t.orders, F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return keyspace.live(rows, F.expr(f"CAST({NOW} AS TIMESTAMP_NTZ)")).select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"))


@query("""
SELECT CASE WHEN c_custkey % 50 = 0 THEN 'moved:' || c_custkey ELSE 'customer:' || c_custkey END AS key, c_name AS value FROM customer
""")
def key_rename(t: Tables) -> DataFrame:
    pairs = t.customer.where("c_custkey % 50 = 0").select(F.concat(F.lit("customer:"), "c_custkey").alias("src"), F.concat(F.lit("moved:"), "c_custkey").alias("dst"))
    return keyspace.rename(_customers(t), pairs)


@query("""
SELECT CASE WHEN c_custkey % 50 = 0 AND c_custkey + 1 > (SELECT max(c_custkey) FROM customer) THEN 'customer:' || (c_custkey + 1) ELSE 'customer:' || c_custkey END AS key, c_name AS value FROM customer
""")
def key_renamenx(t: Tables) -> DataFrame:
    pairs = t.customer.where("c_custkey % 50 = 0").select(F.concat(F.lit("customer:"), "c_custkey").alias("src"), F.concat(F.lit("customer:"), F.col("c_custkey") + 1).alias("dst"))
    return keyspace.rename(_customers(t), pairs, only_new=True)


@query("""
WITH r AS (SELECT o_orderkey, sum(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) - o_totalprice AS before, sum(o_totalprice) OVER () AS everything FROM (SELECT o_orderkey, o_orderdate, CAST(o_totalprice AS BIGINT) AS o_totalprice FROM orders))
SELECT o_orderkey AS key FROM r WHERE everything - before > 100000000
""")
def key_evict(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("used"), F.round("o_totalprice").cast("bigint").alias("size"))
    return keyspace.evict(rows, [F.col("used"), F.col("key")], "size", 100000000).select("key")


@query()
def key_randmember(t: Tables) -> DataFrame:
    return keyspace.pick(t.lineitem.select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("member")).distinct(), ["key"], "member", 3)


@query("""
SELECT 'customer:' || c_custkey AS key, CAST(xor(list_reduce(list_prepend(65535, list_transform(string_split('customer:' || c_custkey, ''), lambda c: ascii(c))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda h, i: CASE WHEN h & 1 = 1 THEN xor(h >> 1, 40961) ELSE h >> 1 END)), 65535) % 16384 AS BIGINT) AS slot
FROM customer
""")
def cluster_slot(t: Tables) -> DataFrame:
    return _customers(t).select("key", slot(F.col("key")).cast("bigint").alias("slot"))


@query("""
WITH w AS (SELECT o_orderkey % 1000 AS tx_id, o_custkey AS key, o_orderkey % 3 AS version FROM orders WHERE o_orderkey % 7 = 0),
v AS (SELECT c_custkey AS key, c_custkey % 3 AS version FROM customer WHERE c_custkey % 2 = 0),
b AS (SELECT DISTINCT tx_id FROM w LEFT JOIN v USING (key) WHERE w.version <> coalesce(v.version, 0))
SELECT o_orderkey AS seq, o_custkey AS key FROM orders WHERE o_orderkey % 1000 NOT IN (SELECT tx_id FROM b)
""")
def tx_watch(t: Tables) -> DataFrame:
    log = t.orders.select((F.col("o_orderkey") % 1000).alias("tx_id"), F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"))
    watched = log.where("seq % 7 = 0").select("tx_id", "key", (F.col("seq") % 3).alias("version"))
    versions = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 3).alias("version"))
    return transactions.committed(log, watched, versions).select("seq", "key")


# bits


def _active(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_type").alias("key"), F.col("user_id").alias("bit"))


@query("SELECT event_type AS key, count(DISTINCT user_id) AS n, count(DISTINCT CASE WHEN user_id BETWEEN 8 AND 31 THEN user_id END) AS part, CAST(min(user_id) AS BIGINT) AS pos FROM events GROUP BY 1")
def bit_count(t: Tables) -> DataFrame:
    b = _active(t)
    part = bits.bit_count(b, ["key"], first_byte=1, last_byte=3).withColumnRenamed("n", "part")
    return bits.bit_count(b, ["key"]).join(part, "key", "left").join(bits.bit_pos(b, ["key"]), "key").select("key", "n", F.coalesce("part", F.lit(0)).alias("part"), "pos")


@query("""
WITH d AS (SELECT DISTINCT event_type AS key, user_id AS bit FROM events WHERE user_id <> 37)
SELECT key, (SELECT min(u) FROM generate_series(0, 100000) g(u) WHERE NOT EXISTS (SELECT 1 FROM d x WHERE x.key = d.key AND x.bit = u)) AS pos FROM d GROUP BY key
""")
def bit_pos_zero(t: Tables) -> DataFrame:
    return bits.bit_pos(_active(t).where("bit <> 37"), ["key"], want=0)


def _op(op: str, having: str) -> str:
    return f"SELECT bit FROM (SELECT DISTINCT event_type, user_id * 32 + day(ts) AS bit FROM events WHERE event_type IN ('click', 'error', 'purchase')) GROUP BY 1 HAVING {having}"


def _days(t: Tables) -> DataFrame:
    """A bitmap for each type of event, with a bit for each user and day of the month."""
    return t.events.select(F.col("event_type").alias("key"), (F.col("user_id") * 32 + F.dayofmonth("ts")).alias("bit"))


@query(_op("AND", "count(*) = 3"))
def bit_op_and(t: Tables) -> DataFrame:
    return bits.bit_op(_days(t), "AND", ["click", "error", "purchase"])


@query(_op("OR", "true"))
def bit_op_or(t: Tables) -> DataFrame:
    return bits.bit_op(_days(t), "OR", ["click", "error", "purchase"])


@query(_op("XOR", "count(*) % 2 = 1"))
def bit_op_xor(t: Tables) -> DataFrame:
    return bits.bit_op(_days(t), "XOR", ["click", "error", "purchase"])


@query("""
WITH d AS (SELECT DISTINCT user_id * 32 + day(ts) AS bit FROM events WHERE event_type = 'click')
SELECT u AS bit FROM generate_series(0, (SELECT (max(bit) // 8 + 1) * 8 - 1 FROM d)) g(u) WHERE u NOT IN (SELECT bit FROM d)
""")
def bit_op_not(t: Tables) -> DataFrame:
    return bits.bit_op(_days(t), "NOT", ["click"])


@query("SELECT user_id AS key, user_id % 2 AS bit, count(*) AS n FROM (SELECT user_id, event_type, arg_max(event_id % 2, event_id) AS o FROM events GROUP BY ALL) WHERE o = 1 GROUP BY ALL")
def bit_setbit(t: Tables) -> DataFrame:
    log = t.events.select(F.col("user_id").alias("key"), F.col("event_type").alias("bit"), (F.col("event_id") % 2).alias("on"), F.col("event_id").alias("seq"))
    return bits.set_bits(log, ["key"]).groupBy("key").agg(F.count("*").alias("n")).select("key", (F.col("key") % 2).alias("bit"), "n")


@query("SELECT p_partkey AS key, CAST(list_sum(list_transform(string_split(p_name, ''), lambda c: bit_count(ascii(c)))) AS BIGINT) AS n, CAST((ascii(p_name[1]) >> 5) & 1 AS BIGINT) AS third FROM part")
def bit_bytes(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("key"), bits.byte_bit_count(F.col("p_name")).alias("n"), bits.get_bit(F.col("p_name"), 2).alias("third"))


@query("SELECT p_partkey AS key, ascii(p_name[1]) || ',' || (ascii(p_name[1]) + 300) % 256 || ',' || 255 AS results FROM part")
def bit_field(t: Tables) -> DataFrame:
    program = [("GET", "u8", 0), ("INCRBY", "u8", 0, 300), ("OVERFLOW", "SAT"), ("INCRBY", "u8", 0, 1000)]
    return t.part.select(F.col("p_partkey").alias("key"), bits.bitfield(program, F.col("p_name"))["results"].alias("results"))


# JSON


@query("SELECT event_id, props ->> '$.k' AS k, 'number' AS kind, 'object' AS root, CAST(1 AS BIGINT) AS n FROM events")
def json_get(t: Tables) -> DataFrame:
    p = F.col("props")
    return t.events.select("event_id", jsondoc.get(p, "$.k").alias("k"), jsondoc.kind(p, "$.k").alias("kind"), jsondoc.kind(p).alias("root"), jsondoc.obj_len(p).alias("n"))


@query("SELECT event_id, '{\"k\":' || (CAST(props ->> '$.k' AS BIGINT) + 5) || '}' AS plus, '{\"k\":' || (CAST(props ->> '$.k' AS BIGINT) * 3) || '}' AS times FROM events")
def json_numincrby(t: Tables) -> DataFrame:
    return t.events.select("event_id", jsondoc.incr("$.k", 5)(F.col("props")).alias("plus"), jsondoc.mult("$.k", 3)(F.col("props")).alias("times"))


@query("""
WITH a AS (SELECT o_custkey AS key, list(o_orderkey ORDER BY o_orderkey) AS l FROM orders GROUP BY 1)
SELECT key, CAST(len(l) AS BIGINT) AS n, '[' || array_to_string(list_append(l, 7), ',') || ']' AS appended,
       '[' || array_to_string(list_concat([0], l), ',') || ']' AS inserted, '[' || array_to_string(l[:-2], ',') || ']' AS popped,
       '[' || array_to_string(l[1:2], ',') || ']' AS trimmed, CAST(0 AS BIGINT) AS first_at
FROM a
""")
def json_arr(t: Tables) -> DataFrame:
    a = t.orders.groupBy(F.col("o_custkey").alias("key")).agg(F.to_json(F.sort_array(F.collect_list("o_orderkey"))).alias("doc"), F.min("o_orderkey").alias("low"))
    d = F.col("doc")
    at = F.array_position(F.from_json(d, "array<bigint>"), F.col("low")) - 1
    return a.select("key", jsondoc.arr_len(d).alias("n"), jsondoc.arr_append("$", 7)(d).alias("appended"), jsondoc.arr_insert("$", 0, 0)(d).alias("inserted"), jsondoc.arr_pop("$")(d).alias("popped"), jsondoc.arr_trim("$", 0, 1)(d).alias("trimmed"), at.alias("first_at"))


@query("""
SELECT event_id, '{"k":' || (props ->> '$.k') || ',"seen":true}' AS merged, '{"k":0}' AS cleared, '{}' AS removed, CAST(strlen(event_type) AS BIGINT) AS n,
       '{"t":"' || event_type || '!"}' AS appended
FROM events
""")
def json_merge(t: Tables) -> DataFrame:
    p, named = F.col("props"), F.to_json(F.struct(F.col("event_type").alias("t")))
    return t.events.select(
        "event_id", jsondoc.merge("$", {"seen": True})(p).alias("merged"), jsondoc.clear("$.k")(p).alias("cleared"), jsondoc.remove("$.k")(p).alias("removed"),
        jsondoc.str_len(named, "$.t").alias("n"), jsondoc.str_append("$.t", "!")(named).alias("appended"),
    )


@query("""
SELECT event_id, '{"k":' || (props ->> '$.k') || ',"on":false}' AS toggled, '{"k":"x"}' AS xx, props::JSON::VARCHAR IS NOT NULL AS whole FROM events
""")
def json_set(t: Tables) -> DataFrame:
    p = F.col("props")
    return t.events.select(
        "event_id", jsondoc.toggle("$.on")(jsondoc.set_value("$.on", True, "NX")(p)).alias("toggled"),
        jsondoc.set_value("$.none", 1, "XX")(jsondoc.set_value("$.k", "x", "XX")(p)).alias("xx"), (jsondoc.get(p) == p).isNotNull().alias("whole"),
    )


# sketches


@query()
def pf_count(t: Tables) -> DataFrame:
    return sketch.pfcount(sketch.pfadd(t.events, ["event_type"], "user_id"), ["event_type"])


@query("SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def pf_count_exact(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("n"))


@query("SELECT true AS within, count(*) AS n FROM (SELECT DISTINCT event_type FROM events)")
def pf_merge(t: Tables) -> DataFrame:
    regs = sketch.registers(t.events.withColumn("d", F.to_date("ts")), ["event_type", "d"], "user_id")
    merged = sketch.registers_count(regs, ["event_type"])
    exact = t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    near = F.abs(F.col("n") - F.col("exact")) <= F.greatest(F.lit(2.0), F.col("exact") * 0.03)
    return merged.join(exact, "event_type").agg(F.bool_and(near).alias("within"), F.count("*").alias("n"))


BITS, HASHES = sketch.bloom_size(20000, 0.01)


@query("SELECT count(*) AS found FROM (SELECT DISTINCT l_partkey FROM lineitem)")
def bf_exists(t: Tables) -> DataFrame:
    items = t.lineitem.select(F.lit("f").alias("key"), F.col("l_partkey").alias("item")).distinct()
    f = sketch.bloom_add(items, ["key"], "item", BITS, HASHES)
    return sketch.bloom_exists(items, f, ["key"], "item", BITS, HASHES).agg(F.count_if(F.col("maybe") == 1).alias("found"))


@query()
def bf_card(t: Tables) -> DataFrame:
    return sketch.bloom_card(t.events, ["event_type"], "user_id", "event_id", BITS, HASHES)
