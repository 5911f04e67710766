"""Streams, consumer groups, cache, pub/sub."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.columns import epoch_millis
from keyloom.operators import cache, pubsub
from keyloom.operators import streams as x
from keyloom.plans.catalogue import Tables, query


def _stream(t: Tables) -> DataFrame:
    return x.with_auto_seq(t.events.select(F.col("event_type").alias("key"), epoch_millis(F.col("ts")).alias("ts_ms"), "event_id"), "event_id")


STREAM_SQL = """s AS (SELECT event_type AS key, (epoch_us(ts) // 1000) AS ts_ms, event_id, row_number() OVER (PARTITION BY event_type, (epoch_us(ts) // 1000) ORDER BY event_id) - 1 AS seq FROM events)"""


@query(f"WITH {STREAM_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_ms, seq) AS n FROM s) SELECT key, ts_ms, seq, event_id FROM r WHERE n <= 20")
def x_range(t: Tables) -> DataFrame:
    return x.xrange(_stream(t), count=20).select("key", "ts_ms", "seq", "event_id")


@query(f"WITH {STREAM_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_ms DESC, seq DESC) AS n FROM s) SELECT key, ts_ms, seq FROM r WHERE n <= 7")
def x_revrange(t: Tables) -> DataFrame:
    return x.xrange(_stream(t), count=7, reverse=True).select("key", "ts_ms", "seq")


@query("SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1")
def x_len(t: Tables) -> DataFrame:
    return x.xinfo(_stream(t)).select("key", F.col("length").alias("n"))


@query(f"""WITH {STREAM_SQL}, e AS (SELECT DISTINCT key, first_value(ts_ms || '-' || seq) OVER w AS first_id, last_value(ts_ms || '-' || seq) OVER w AS last_id, count(*) OVER (PARTITION BY key) AS length FROM s WINDOW w AS (PARTITION BY key ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT * FROM e""")
def x_info(t: Tables) -> DataFrame:
    return x.xinfo(_stream(t))


@query(f"""WITH {STREAM_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_ms DESC, seq DESC) AS n FROM s)
SELECT key, ts_ms, seq FROM r WHERE n <= 500 AND ts_ms >= 1706400000000""")
def x_trim(t: Tables) -> DataFrame:
    return x.xtrim_minid(x.xtrim_maxlen(_stream(t), 500), "1706400000000-0").select("key", "ts_ms", "seq")


@query(f"""WITH {STREAM_SQL}, l AS (SELECT key, max(CASE WHEN event_id % 11 = 0 THEN ts_ms END) AS last_ms FROM s GROUP BY 1) SELECT s.key, s.ts_ms, s.seq FROM s JOIN l USING (key) WHERE s.ts_ms > l.last_ms OR (s.ts_ms = l.last_ms AND s.seq > 0)""")
def x_read(t: Tables) -> DataFrame:
    s = _stream(t)
    after = s.groupBy("key").agg(F.max(F.when(F.col("event_id") % 11 == 0, F.col("ts_ms"))).alias("last_ms")).withColumn("last_seq", F.lit(0).cast("bigint"))
    return x.xread(s, after).select("key", "ts_ms", "seq")


@query("""
WITH a AS (SELECT user_id AS key, event_id, (epoch_us(ts) // 1000) - (event_id % 5) * 40000000 AS ts_ms FROM events),
t AS (SELECT *, max(ts_ms) OVER (PARTITION BY key ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM a)
SELECT key, event_id, ts_ms FROM t WHERE top IS NULL OR ts_ms > top
""")
def x_add(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("key"), "event_id", (epoch_millis(F.col("ts")) - F.col("event_id") % 5 * 40000000).alias("ts_ms"), F.lit(0).alias("seq"))
    return x.accepted(rows, "event_id").select("key", "event_id", "ts_ms")


DELIVERED_SQL = STREAM_SQL + """, d AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY key ORDER BY ts_ms, seq) - 1) / 10) AS BIGINT) AS batch FROM s),
g AS (SELECT key, ts_ms, seq, event_id, batch, 'c' || (batch % 3) AS consumer FROM d), pel AS (SELECT *, ts_ms + 1000 AS delivered_ms FROM g WHERE event_id % 3 <> 0)"""


def _group(t: Tables) -> DataFrame:
    return x.readgroup(_stream(t), ["c0", "c1", "c2"], 10)


def _pel(t: Tables) -> DataFrame:
    d = _group(t)
    return x.pending(d, d.where("event_id % 3 = 0")).withColumn("delivered_ms", F.col("ts_ms") + 1000)


@query(f"WITH {DELIVERED_SQL} SELECT key, ts_ms, seq, batch, consumer FROM g")
def x_readgroup(t: Tables) -> DataFrame:
    return _group(t).select("key", "ts_ms", "seq", "batch", "consumer")


@query(f"""WITH {DELIVERED_SQL} SELECT key, consumer, count(*) AS n, arg_min(ts_ms || '-' || seq, (ts_ms, seq)) AS min_id, arg_max(ts_ms || '-' || seq, (ts_ms, seq)) AS max_id FROM pel GROUP BY 1, 2""")
def x_pending(t: Tables) -> DataFrame:
    return x.xpending(_pel(t))


NOW_MS = 1_900_000_000_000


@query(f"""WITH {DELIVERED_SQL}, r AS (SELECT *, {NOW_MS} - delivered_ms AS idle_ms, row_number() OVER (PARTITION BY key ORDER BY delivered_ms, ts_ms, seq) AS n FROM pel) SELECT key, ts_ms, seq, consumer, idle_ms FROM r WHERE n <= 25""")
def x_autoclaim(t: Tables) -> DataFrame:
    return x.xautoclaim(_pel(t), NOW_MS, 1000, count=25).select("key", "ts_ms", "seq", "consumer", "idle_ms")


@query(f"""WITH {DELIVERED_SQL} SELECT key, ts_ms, seq, CASE WHEN event_id % 5 = 0 THEN 'c9' ELSE consumer END AS consumer, CAST(CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS delivery_count FROM pel""")
def x_claim(t: Tables) -> DataFrame:
    pel = _pel(t)
    return x.xclaim(pel, "c9", NOW_MS, 1000, pel.where("event_id % 5 = 0")).select("key", "ts_ms", "seq", "consumer", "delivery_count")


# cache


def _entries(t: Tables) -> DataFrame:
    start = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    e = t.pages.select(F.col("page_id").alias("key"), "url", start.alias("stored_at"))
    h = cache.horizons(F.col("stored_at"), F.lit(86400 * 5), F.lit(86400 * 5), F.lit(86400 * 5))
    return e.select("*", *(v.alias(k) for k, v in h.items()))


def _requests(t: Tables) -> DataFrame:
    n = t.pages.agg(F.count("*").alias("n"))
    return t.events.crossJoin(F.broadcast(n)).select(F.col("event_id").alias("request"), F.when(F.col("event_id") % 10 > 0, F.col("user_id") % F.col("n")).alias("key"), F.col("ts").alias("at"))


STATE_SQL = """e AS (SELECT page_id AS key FROM pages), q AS (SELECT event_id AS request, CASE WHEN event_id % 10 > 0 THEN user_id % (SELECT count(*) FROM pages) END AS key, ts AS asked FROM events),
st AS (SELECT request, q.key, asked, CASE WHEN e.key IS NULL OR asked < TIMESTAMP '2024-01-01' THEN 'miss' WHEN asked < TIMESTAMP '2024-01-06' THEN 'fresh' WHEN asked < TIMESTAMP '2024-01-11' THEN 'stale' WHEN asked < TIMESTAMP '2024-01-16' THEN 'grace' ELSE 'miss' END AS state FROM q LEFT JOIN e USING (key))"""


@query(f"WITH {STATE_SQL} SELECT request, state FROM st")
def cache_state(t: Tables) -> DataFrame:
    return cache.lookup(_requests(t), _entries(t)).select("request", "state")


@query(f"""WITH {STATE_SQL} SELECT count(*) FILTER (state <> 'miss') AS hits, count(*) FILTER (state = 'miss') AS misses, count(*) FILTER (state IN ('stale', 'grace')) AS stale_hits,
count(*) FILTER (state = 'stale') AS revalidations, round(count(*) FILTER (state <> 'miss') / count(*), 6) AS hit_ratio FROM st""")
def cache_stats(t: Tables) -> DataFrame:
    return cache.stats(cache.lookup(_requests(t), _entries(t))).withColumn("hit_ratio", F.round("hit_ratio", 6))


@query(f"WITH {STATE_SQL} SELECT key, arg_min(request, (asked, request)) AS request FROM st WHERE state = 'stale' GROUP BY 1")
def cache_revalidate(t: Tables) -> DataFrame:
    return cache.revalidators(cache.lookup(_requests(t), _entries(t)))


POLICIES = [
    {"name": "any", "key_pattern": "http*//*/*", "url_template": "origin/{3}", "priority": 1, "tags": ["host:{2}"]},
    {"name": "org", "key_pattern": "https://*.example.org/*", "url_template": "org/{1}/{2}", "priority": 5, "tags": ["org", "p:{2}"]},
]


@query(r"""
SELECT page_id, CASE WHEN regexp_matches(url, '^https://(.*)\.example\.org/(.*)$') THEN 'org' ELSE 'any' END AS policy,
CASE WHEN regexp_matches(url, '^https://(.*)\.example\.org/(.*)$') THEN 'org/' || regexp_extract(url, '^https://(.*)\.example\.org/(.*)$', 1) || '/' || regexp_extract(url, '^https://(.*)\.example\.org/(.*)$', 2) ELSE 'origin/' || regexp_extract(url, '^http(.*)//(.*)/(.*)$', 3) END AS fetch_url,
CASE WHEN regexp_matches(url, '^https://(.*)\.example\.org/(.*)$') THEN 'org,p:' || regexp_extract(url, '^https://(.*)\.example\.org/(.*)$', 2) ELSE 'host:' || regexp_extract(url, '^http(.*)//(.*)/(.*)$', 2) END AS fetch_tags
FROM pages WHERE regexp_matches(url, '^http(.*)//(.*)/(.*)$')
""")
def cache_policy(t: Tables) -> DataFrame:
    return cache.resolve(t.pages.select("page_id", F.col("url").alias("key")), POLICIES).select("page_id", "policy", "fetch_url", "fetch_tags")


def _tagged(t: Tables) -> DataFrame:
    return _entries(t).withColumn("tags", F.array(F.concat(F.lit("m"), F.col("key") % 7), F.concat(F.lit("b"), F.col("key") % 3)))


@query("SELECT page_id AS key FROM pages WHERE page_id % 7 <> 2 AND page_id % 3 <> 1")
def cache_purgetag(t: Tables) -> DataFrame:
    return cache.purge_tags(_tagged(t), ["m2", "b1"]).select("key")


@query("SELECT page_id AS key FROM pages WHERE url NOT LIKE 'https://m.%'")
def cache_purge(t: Tables) -> DataFrame:
    return cache.purge(t.pages.select(F.col("page_id").alias("id"), F.col("url").alias("key")), ["https://m.*"]).select(F.col("id").alias("key"))


@query("SELECT page_id AS key, page_id % 7 = 2 OR page_id = 5 AS ended FROM pages")
def cache_softpurge(t: Tables) -> DataFrame:
    now = F.expr("TIMESTAMP_NTZ '2024-01-02 00:00:00'")
    return cache.soft_purge(_tagged(t), now, [5], ["m2"]).select("key", (F.col("fresh_until") <= now).alias("ended"))


@query("SELECT page_id AS key, tag FROM (SELECT page_id, 'm' || page_id % 7 AS tag FROM pages UNION ALL SELECT page_id, 'b' || page_id % 3 FROM pages)")
def cache_tags(t: Tables) -> DataFrame:
    return cache.tag_index(_tagged(t))


# pub/sub


@query("""
WITH subs AS (SELECT 's' || n_nationkey AS subscriber, CASE n_nationkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'error' WHEN 3 THEN 'signup' ELSE 'none' END AS channel FROM nation)
SELECT event_id, subscriber, 'channel' AS via FROM events JOIN subs ON channel = event_type UNION ALL
SELECT event_id, 'p1', 'cl*' FROM events WHERE event_type LIKE 'cl%' UNION ALL SELECT event_id, 'p2', '*up' FROM events WHERE event_type LIKE '%up' UNION ALL
SELECT event_id, 'p3', '[ev]*' FROM events WHERE event_type[1] IN ('e', 'v')
""")
def pubsub_route(t: Tables) -> DataFrame:
    subs = t.nation.select(F.concat(F.lit("s"), "n_nationkey").alias("subscriber"), F.element_at(F.array(*map(F.lit, ("click", "view", "error", "signup", "none"))), (F.col("n_nationkey") % 5 + 1).cast("int")).alias("channel"))
    messages = t.events.select("event_id", F.col("event_type").alias("channel"))
    return pubsub.route(messages, subs, [("cl*", "p1"), ("*up", "p2"), ("[ev]*", "p3")]).select("event_id", "subscriber", "via")


@query("SELECT event_type AS channel, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def pubsub_numsub(t: Tables) -> DataFrame:
    return pubsub.numsub(t.events.select(F.col("event_type").alias("channel"), F.col("user_id").alias("subscriber")))
