"""Sorted sets and geospatial members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators import geo
from keyloom.operators import zsets as z
from keyloom.plans.catalogue import Tables, query


def _board(t: Tables) -> DataFrame:
    spent = t.orders.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("score"))
    return spent.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("key"), F.col("c_custkey").alias("member"), "score")


BOARD_SQL = """b AS (SELECT n_name AS key, c_custkey AS member, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS score
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""
RANKED_SQL = BOARD_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rev FROM b)"


@query(f"WITH {RANKED_SQL} SELECT key, member, score, rev AS rank FROM r WHERE rev < 10")
def zset_zrevrange(t: Tables) -> DataFrame:
    return z.zrange(_board(t), 0, 9, reverse=True)


@query(f"WITH {RANKED_SQL} SELECT key, member, score, rank FROM r")
def zset_zrank(t: Tables) -> DataFrame:
    return z.ranked(_board(t))


@query(f"WITH {RANKED_SQL}, n AS (SELECT key, count(*) AS n FROM b GROUP BY 1) SELECT key, member, score, rank FROM r JOIN n USING (key) WHERE rank >= greatest(n - 4, 0) AND rank <= n - 2")
def zset_zrange(t: Tables) -> DataFrame:
    return z.zrange(_board(t), -4, -2)


@query(f"""WITH {BOARD_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM b WHERE score > 100000 AND score <= 2000000)
SELECT key, member, score FROM h WHERE rank >= 2 AND rank < 7""")
def zset_zrangebyscore(t: Tables) -> DataFrame:
    return z.zrange_by_score(_board(t), "(100000", "2000000", offset=2, limit=5)


@query(f"WITH {BOARD_SQL} SELECT key, count(*) FILTER (score >= 500000) AS n FROM b GROUP BY 1")
def zset_zcount(t: Tables) -> DataFrame:
    return z.zcount(_board(t), "500000", "+inf")


def _names(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_brand").alias("key"), F.col("p_name").alias("member"), F.lit(3.0).alias("score")).distinct()


@query("""WITH s AS (SELECT DISTINCT p_brand AS key, p_name AS member FROM part WHERE p_name >= 'b' AND p_name < 'm'),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) AS n FROM s) SELECT key, member, 3.0::DOUBLE AS score FROM r WHERE n <= 4""")
def zset_zrangebylex(t: Tables) -> DataFrame:
    return z.zrange_by_lex(_names(t), "[b", "(m", limit=4)


@query("SELECT p_brand AS key, count(DISTINCT p_name) FILTER (p_name > 'c') AS n FROM part GROUP BY 1")
def zset_zlexcount(t: Tables) -> DataFrame:
    return z.zlexcount(_names(t), "(c", "+")


@query("""SELECT CAST(user_id AS VARCHAR) AS key, event_type AS member, arg_max(value, event_id) AS last, arg_min(value, event_id) AS nx, max(value) AS gt, min(value) AS lt FROM events GROUP BY 1, 2""")
def zset_zadd_flags(t: Tables) -> DataFrame:
    log = t.events.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("member"), F.col("value").alias("score"), F.col("event_id").alias("seq"))
    out = None
    for mode, name in (("", "last"), ("NX", "nx"), ("GT", "gt"), ("LT", "lt")):
        one = z.zadd(log, mode).withColumnRenamed("score", name)
        out = one if out is None else out.join(one, ["key", "member"])
    return out


@query("""
WITH a AS (SELECT event_type AS key, user_id AS member, max(value) AS s FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT event_type AS key, user_id AS member, max(value) AS s FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2)
SELECT key, member, CASE WHEN a.s IS NULL OR b.s > a.s THEN b.s ELSE a.s END AS score, CAST(a.s IS NULL AS INTEGER) AS added, CAST(a.s IS NULL OR coalesce(b.s > a.s, false) AS INTEGER) AS changed
FROM a FULL JOIN b USING (key, member)
""")
def zset_zadd_gt(t: Tables) -> DataFrame:
    side = lambda k: t.events.where(F.col("event_id") % k == 0).groupBy(F.col("event_type").alias("key"), F.col("user_id").alias("member")).agg(F.max("value").alias("score"))
    return z.zadd_to(side(2), side(3), "GT")


def _years(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.date_format("l_shipdate", "yyyy").alias("key"), F.col("l_suppkey").alias("member")).agg(F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("score"))


YEARS_SQL = "y AS (SELECT strftime(l_shipdate, '%Y') AS key, l_suppkey AS member, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS score FROM lineitem GROUP BY 1, 2)"
W = "CASE key WHEN '1994' THEN 1 WHEN '1995' THEN 2 ELSE 3 END"


@query(f"WITH {YEARS_SQL} SELECT member, sum(score * {W}) AS sums, min(score * {W}) AS mins, max(score * {W}) AS maxs FROM y WHERE key IN ('1994', '1995', '1996') GROUP BY 1")
def zset_zunionstore(t: Tables) -> DataFrame:
    y, keys, weights = _years(t), ["1994", "1995", "1996"], [1.0, 2.0, 3.0]
    one = lambda how, name: z.zstore(y, keys, weights, how).withColumnRenamed("score", name)
    return one("SUM", "sums").join(one("MIN", "mins"), "member").join(one("MAX", "maxs"), "member")


@query(f"WITH {YEARS_SQL} SELECT member, sum(score) AS score FROM y WHERE key IN ('1994', '1995') GROUP BY 1 HAVING count(*) = 2")
def zset_zinterstore(t: Tables) -> DataFrame:
    return z.zstore(_years(t), ["1994", "1995"], inter=True)


@query(f"WITH {RANKED_SQL} SELECT key, member, score, CASE WHEN rev < 3 THEN 'popped' ELSE 'left' END AS part FROM r")
def zset_zpop(t: Tables) -> DataFrame:
    popped, left = z.zpop(_board(t), 3, highest=True)
    return popped.drop("rank").withColumn("part", F.lit("popped")).unionByName(left.withColumn("part", F.lit("left")))


@query(f"WITH {RANKED_SQL} SELECT key, member, score FROM r WHERE NOT rank BETWEEN 1 AND 3 AND NOT score BETWEEN 1000000 AND 1500000")
def zset_zremrange(t: Tables) -> DataFrame:
    return z.zremrange_by_score(z.zremrange(_board(t), 1, 3), "1000000", "1500000")


@query("SELECT DISTINCT p_brand AS key, p_name AS member, 3.0::DOUBLE AS score FROM part WHERE NOT (p_name >= 'b' AND p_name < 'm')")
def zset_zremrangebylex(t: Tables) -> DataFrame:
    return z.zremrange_by_lex(_names(t), "[b", "(m")


@query(f"WITH {RANKED_SQL} SELECT 'top' AS key, member, score FROM r WHERE key = (SELECT n_name FROM nation WHERE n_nationkey = 3) AND rev BETWEEN 0 AND 4")
def zset_zrangestore(t: Tables) -> DataFrame:
    named = _board(t).join(t.nation.where("n_nationkey = 3").select(F.col("n_name").alias("key")), "key", "left_semi").withColumn("key", F.lit("src"))
    return z.zrangestore(named, "src", "top", "0", "4", reverse=True)


# geo


def _points(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(F.col("c_nationkey").alias("key"), k.alias("member"), ((k * 37 % 3600) / 10 - 180).cast("double").alias("lon"), ((k * 53 % 1700) / 20 - 42.5).cast("double").alias("lat"))


POINTS_SQL = "p AS (SELECT c_nationkey AS key, c_custkey AS member, (c_custkey * 37 % 3600) / 10.0::DOUBLE - 180 AS lon, (c_custkey * 53 % 1700) / 20.0::DOUBLE - 42.5 AS lat FROM customer)"


def _haversine(a: str, b: str) -> str:
    h = f"(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))"
    return f"2 * {geo.RADIUS_M} * atan2(sqrt({h}), sqrt(1 - {h}))"


@query(f"WITH {POINTS_SQL} SELECT a.member AS a, b.member AS b, round({_haversine('a.', 'b.')} / 1000, 3) AS km FROM p a JOIN p b ON b.member = a.member + 1")
def geo_dist(t: Tables) -> DataFrame:
    p = _points(t)
    b = p.select((F.col("member") - 1).alias("a"), F.col("member").alias("b"), F.col("lon").alias("blon"), F.col("lat").alias("blat"))
    return p.withColumnRenamed("member", "a").join(b, "a").select("a", "b", F.round(geo.distance(F.col("lon"), F.col("lat"), F.col("blon"), F.col("blat"), "km"), 3).alias("km"))


@query(f"""WITH {POINTS_SQL}, c AS (SELECT key, min(member) AS centre FROM p GROUP BY 1)
SELECT p.key, c.centre, p.member, round({_haversine('o.', 'p.')} / 1000, 3) AS dist FROM c JOIN p o ON o.member = c.centre JOIN p ON p.key = c.key WHERE {_haversine('o.', 'p.')} <= 2500000""")
def geo_radius(t: Tables) -> DataFrame:
    p = _points(t)
    centres = p.groupBy("key").agg(F.min("member").alias("centre"))
    return geo.radius_by_member(p, centres, 2500, "km").select("key", "centre", "member", F.round("dist", 3).alias("dist"))


@query(f"""WITH {POINTS_SQL} SELECT member, round((floor((lon + 180) / 360 * 67108864) + 0.5) / 67108864 * 360 - 180, 6) AS lon, round((floor((lat + 90) / 180 * 67108864) + 0.5) / 67108864 * 180 - 90, 6) AS lat FROM p""")
def geo_pos(t: Tables) -> DataFrame:
    at = geo.position(geo.score(F.col("lon"), F.col("lat")))
    return _points(t).select("member", at.alias("p")).select("member", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


@query(f"""
WITH {POINTS_SQL}, c AS (SELECT member, CAST(floor((lon + 180) / 360 * 67108864) AS BIGINT) AS x, CAST(floor((lat + 90) / 180 * 67108864) AS BIGINT) AS y FROM p),
s AS (SELECT member, CAST(list_sum(list_transform(range(26), lambda i: (((x >> CAST(i AS INT)) & 1) << CAST(2 * i + 1 AS INT)) + (((y >> CAST(i AS INT)) & 1) << CAST(2 * i AS INT)))) AS BIGINT) AS z FROM c)
SELECT member, array_to_string(list_transform(range(11), lambda k: '0123456789bcdefghjkmnpqrstuvwxyz'[1 + CASE WHEN k = 10 THEN (z & 3) << 3 ELSE (z >> CAST(47 - 5 * k AS INT)) & 31 END]), '') AS geohash FROM s
""")
def geo_hash(t: Tables) -> DataFrame:
    return _points(t).select("member", geo.geohash(geo.score(F.col("lon"), F.col("lat"))).alias("geohash"))
