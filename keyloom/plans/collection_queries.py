"""Hashes, sets, lists and SORT."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators import collections as c
from keyloom.operators import keyspace, sorting, strings
from keyloom.plans.catalogue import Tables, query


def _hash(t: Tables) -> DataFrame:
    fields = F.array(*(F.struct(F.lit(n).alias("field"), v.cast("string").alias("value")) for n, v in (("name", F.col("c_name")), ("nation", F.col("c_nationkey")), ("segment", F.col("c_mktsegment")))))
    return t.customer.select(F.concat(F.lit("customer:"), "c_custkey").alias("key"), F.inline(fields))


HASH_SQL = """h AS (
SELECT 'customer:' || c_custkey AS key, 'name' AS field, c_name AS value FROM customer UNION ALL
SELECT 'customer:' || c_custkey, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL
SELECT 'customer:' || c_custkey, 'segment', c_mktsegment FROM customer)"""


@query(f"""WITH {HASH_SQL} SELECT key, string_agg(field, ',' ORDER BY field) AS fields, string_agg(value, ',' ORDER BY field) AS vals, count(*) AS n FROM h GROUP BY key""")
def hash_hgetall(t: Tables) -> DataFrame:
    m = F.col("fields")
    return c.hgetall(_hash(t)).select("key", F.array_join(F.map_keys(m), ",").alias("fields"), F.array_join(F.map_values(m), ",").alias("vals"), F.size(m).cast("bigint").alias("n"))


@query(f"""
WITH {HASH_SQL}, r AS (SELECT 'customer:' || s_suppkey AS key, f AS field FROM supplier, (VALUES ('name'), ('missing'), ('segment')) v(f))
SELECT r.key, r.field, h.value, CAST(coalesce(strlen(h.value), 0) AS BIGINT) AS bytes, h.value IS NOT NULL AS there FROM r LEFT JOIN h USING (key, field)
""")
def hash_hmget(t: Tables) -> DataFrame:
    asked = t.supplier.select(F.concat(F.lit("customer:"), "s_suppkey").alias("key"), F.explode(F.array(*map(F.lit, ("name", "missing", "segment")))).alias("field"))
    v = F.col("value")
    return asked.join(_hash(t), ["key", "field"], "left").select("key", "field", "value", strings.strlen(v).alias("bytes"), v.isNotNull().alias("there"))


@query("SELECT user_id AS key, event_type AS field, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS value, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def hash_hincrby(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("key"), F.col("event_type").alias("field"), F.floor("value").alias("n"), F.col("value").alias("x"))
    return strings.incr_by(rows, ["key", "field"], "n").join(strings.incr_by_float(rows, ["key", "field"], "x").select("key", "field", F.round("value", 2).alias("total")), ["key", "field"])


@query("SELECT user_id AS key, event_type AS field, min(event_id) AS value FROM events WHERE event_type <> 'error' GROUP BY 1, 2")
def hash_hsetnx(t: Tables) -> DataFrame:
    log = t.events.select(F.col("user_id").alias("key"), F.col("event_type").alias("field"), F.col("event_id").alias("v"), F.col("event_id").alias("seq"))
    kept = keyspace.first_write(log, ["key", "field"], ["v"]).withColumnRenamed("v", "value")
    return keyspace.delete(kept, log.where("field = 'error'").select("key", "field"), ["key", "field"])


@query("""
SELECT CAST(l_suppkey AS BIGINT) AS key, count(DISTINCT l_partkey) FILTER (l_partkey NOT IN (SELECT l_partkey FROM lineitem l2 WHERE l2.l_suppkey = lineitem.l_suppkey AND l2.l_returnflag = 'N')) AS added
FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1
""")
def hash_hset_new(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("field"), "l_returnflag")
    return c.hset_new(rows.where("l_returnflag = 'N'").select("key", "field").distinct(), rows.where("l_returnflag = 'R'"))


@query()
def hash_hrandfield(t: Tables) -> DataFrame:
    return keyspace.pick(_hash(t), ["key"], "field", 2, repeat=True)


# sets


def _segments(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_mktsegment").alias("key"), F.col("c_nationkey").alias("member")).unionByName(
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).where("o_totalprice > 300000").select(F.col("o_orderpriority").alias("key"), F.col("c_nationkey").alias("member"))
    ).distinct()


SETS_SQL = """s AS (SELECT DISTINCT c_mktsegment AS key, c_nationkey AS member FROM customer UNION
SELECT o_orderpriority, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000)"""
NAMES = ("AUTOMOBILE", "1-URGENT", "2-HIGH")


@query("SELECT l_suppkey AS key, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
def set_scard(t: Tables) -> DataFrame:
    return c.hlen(t.lineitem.select(F.col("l_suppkey").alias("key"), "l_partkey").distinct())


@query(f"WITH {SETS_SQL} SELECT DISTINCT member FROM s WHERE key IN {NAMES}")
def set_union(t: Tables) -> DataFrame:
    return c.union(_segments(t), list(NAMES))


@query(f"WITH {SETS_SQL} SELECT member FROM s WHERE key IN {NAMES} GROUP BY 1 HAVING count(DISTINCT key) = 3")
def set_inter(t: Tables) -> DataFrame:
    return c.inter(_segments(t), list(NAMES))


@query(f"WITH {SETS_SQL} SELECT member FROM s WHERE key = '{NAMES[0]}' EXCEPT SELECT member FROM s WHERE key IN {NAMES[1:]}")
def set_diff(t: Tables) -> DataFrame:
    return c.diff(_segments(t), list(NAMES))


@query("""
SELECT p_partkey AS member, s_suppkey AS key, CAST(EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_partkey = p_partkey) AS BIGINT) AS is_member
FROM part JOIN supplier ON p_partkey % 100 = s_suppkey % 100
""")
def set_smismember(t: Tables) -> DataFrame:
    asked = t.part.join(t.supplier, F.col("p_partkey") % 100 == F.col("s_suppkey") % 100).select(F.col("s_suppkey").alias("key"), F.col("p_partkey").alias("member"))
    return c.is_member(asked, t.lineitem.select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("member")))


@query("""
WITH s AS (SELECT DISTINCT c_mktsegment AS key, c_nationkey AS member FROM customer)
SELECT DISTINCT CASE WHEN key = 'BUILDING' AND member < 5 THEN 'MACHINERY' ELSE key END AS key, member FROM s
""")
def set_smove(t: Tables) -> DataFrame:
    sets = t.customer.select(F.col("c_mktsegment").alias("key"), F.col("c_nationkey").alias("member")).distinct()
    moves = t.nation.where("n_nationkey < 5").select(F.lit("BUILDING").alias("src"), F.lit("MACHINERY").alias("dst"), F.col("n_nationkey").alias("member"))
    return c.move_members(sets, moves)


@query("SELECT DISTINCT c_mktsegment AS key, c_nationkey AS member FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_nationkey < 12)")
def set_srem(t: Tables) -> DataFrame:
    sets = t.customer.select(F.col("c_mktsegment").alias("key"), F.col("c_nationkey").alias("member")).distinct()
    return keyspace.delete(sets, t.nation.where("n_nationkey < 12").select(F.lit("BUILDING").alias("key"), F.col("n_nationkey").alias("member")), ["key", "member"])


# lists


def _list(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"), F.col("event_type").alias("elem"))


LIST_SQL = "l AS (SELECT user_id AS key, event_id AS pos, event_type AS elem, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS index, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


@query(f"WITH {LIST_SQL} SELECT key, index, elem FROM l WHERE index >= greatest(n - 5, 0) AND index <= n - 2")
def list_lrange(t: Tables) -> DataFrame:
    return c.lrange(_list(t), -5, -2).select("key", "index", "elem")


@query(f"WITH {LIST_SQL} SELECT key, index, elem FROM l WHERE index = n - 3")
def list_lindex(t: Tables) -> DataFrame:
    return c.lindex(_list(t), -3).select("key", "index", "elem")


@query(f"WITH {LIST_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY index DESC) AS r FROM l WHERE elem = 'click') SELECT key, index FROM m WHERE r BETWEEN 2 AND 4")
def list_lpos(t: Tables) -> DataFrame:
    return c.lpos(_list(t), "click", rank=-2, count=3).select("key", "index")


@query(f"WITH {LIST_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY key, elem ORDER BY index DESC) AS r FROM l) SELECT key, pos, elem FROM m WHERE NOT (elem = 'view' AND r <= 2)")
def list_lrem(t: Tables) -> DataFrame:
    return c.lrem(_list(t), -2, "view")


@query(f"WITH {LIST_SQL} SELECT key, pos, elem FROM l WHERE index BETWEEN 1 AND n - 2")
def list_ltrim(t: Tables) -> DataFrame:
    return c.lrange(_list(t), 1, -2).select("key", "pos", "elem")


@query(f"""
WITH {LIST_SQL}, p AS (SELECT *, min(CASE WHEN elem = 'signup' THEN index END) OVER (PARTITION BY key) AS place FROM l)
SELECT key, CASE WHEN index >= place THEN index + 1 ELSE index END AS index, elem FROM p
UNION ALL SELECT key, place AS index, 'NEW' AS elem FROM p WHERE index = place
""")
def list_linsert(t: Tables) -> DataFrame:
    return c.linsert(_list(t), "signup", "NEW", before=True)


@query(f"WITH {LIST_SQL} SELECT key, pos, CASE WHEN index = n - 1 THEN 'SET' ELSE elem END AS elem FROM l")
def list_lset(t: Tables) -> DataFrame:
    return c.lset(_list(t), -1, "SET")


@query(f"WITH {LIST_SQL} SELECT key, pos, elem, 'popped' AS part FROM l WHERE index = 0 UNION ALL SELECT key, pos, elem, 'left' FROM l WHERE index > 0")
def list_pop(t: Tables) -> DataFrame:
    popped, left = c.pop(_list(t), left=True)
    return popped.withColumn("part", F.lit("popped")).unionByName(left.withColumn("part", F.lit("left")))


@query(f"""
WITH {LIST_SQL} SELECT key, pos, elem FROM l UNION ALL
SELECT u.user_id, (SELECT min(event_id) FROM events e WHERE e.user_id = u.user_id) - v.s, v.e FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0) u, (VALUES (1, 'a'), (2, 'b')) v(s, e)
""")
def list_lpushx(t: Tables) -> DataFrame:
    users = t.events.select(F.col("user_id").alias("key")).distinct().where("key % 2 = 0").unionByName(t.nation.select((F.col("n_nationkey") + 10_000_000).cast("bigint").alias("key")))
    batch = users.select("key", F.inline(F.array(F.struct(F.lit(1).alias("seq"), F.lit("a").alias("elem")), F.struct(F.lit(2).alias("seq"), F.lit("b").alias("elem")))))
    return c.push(_list(t), batch, left=True, only_existing=True)


# SORT


@query("""
SELECT row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey DESC) - 1 AS pos, CAST(s_suppkey AS VARCHAR) AS get_1, s_name AS get_2
FROM supplier ORDER BY s_acctbal DESC, s_suppkey DESC LIMIT 20
""")
def sort_by_get(t: Tables) -> DataFrame:
    fields = F.array(F.struct(F.lit("name").alias("field"), F.col("s_name").alias("value")), F.struct(F.lit("acctbal").alias("field"), F.col("s_acctbal").cast("string").alias("value")))
    hashes = t.supplier.select(F.concat(F.lit("supplier:"), "s_suppkey").alias("key"), F.inline(fields))
    return sorting.sort(t.supplier.select(F.col("s_suppkey").alias("elem")), by="supplier:*->acctbal", get=("#", "supplier:*->name"), limit=20, desc=True, hashes=hashes)


@query("SELECT row_number() OVER (ORDER BY p_name) - 6 AS pos, p_name AS get_1 FROM (SELECT DISTINCT p_name FROM part) ORDER BY p_name LIMIT 10 OFFSET 5")
def sort_alpha(t: Tables) -> DataFrame:
    return sorting.sort(t.part.select(F.col("p_name").alias("elem")).distinct(), alpha=True, offset=5, limit=10)
