"""HTTP cache entries: freshness at request time, variants, policies, tags, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.columns import capturing_glob, matches


def horizons(stored_at: Column, ttl: Column, swr: Column, grace: Column) -> dict[str, Column]:
    """CACHE.SET: until when an entry is fresh, served while it is revalidated, served in grace (seconds)."""
    after = lambda s: stored_at + F.make_dt_interval(secs=s)
    zero = F.lit(0)
    t, s, g = (F.coalesce(c, zero) for c in (ttl, swr, grace))
    return {"fresh_until": after(t), "swr_until": after(t + s), "grace_until": after(t + s + g)}


def state(at: Column) -> Column:
    """CACHE.GET: fresh, stale, grace or miss at a time; an absent entry is a miss."""
    return F.when(at < F.col("fresh_until"), "fresh").when(at < F.col("swr_until"), "stale").when(at < F.col("grace_until"), "grace").otherwise("miss")


def lookup(requests: DataFrame, entries: DataFrame, at: str = "at", key: str = "key") -> DataFrame:
    """Each request with the state of the entry stored last at or before it. ``requests`` needs a unique ``request``."""
    joined = requests.join(entries, key, "left").where(F.col("stored_at").isNull() | (F.col("stored_at") <= F.col(at)))
    newest = joined.groupBy("request").agg(F.max_by(F.struct("stored_at", state(F.col(at)).alias("state")), F.coalesce("stored_at", F.timestamp_seconds(F.lit(0)))).alias("_e"))
    return requests.join(newest, "request", "left").withColumn("state", F.coalesce("_e.state", F.lit("miss"))).drop("_e")


def not_modified(etag: Column, last_modified: Column, if_none_match: Column, if_modified_since: Column) -> Column:
    """Conditional requests: equal ETag, or without one an equal Last-Modified."""
    return F.coalesce(F.when(if_none_match.isNotNull(), etag == if_none_match).otherwise(last_modified == if_modified_since), F.lit(False))


def stats(states: DataFrame, *by: str) -> DataFrame:
    """CACHE.STATS: hits (fresh, stale, grace), misses, stale hits, revalidations, hit ratio."""
    hit = F.col("state") != "miss"
    a = states.groupBy(*by).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.count_if(F.col("state").isin("stale", "grace")).alias("stale_hits"), F.count_if(F.col("state") == "stale").alias("revalidations"))
    return a.withColumn("hit_ratio", F.col("hits") / F.greatest(F.col("hits") + F.col("misses"), F.lit(1)))


def revalidators(states: DataFrame, key: str = "key", at: str = "at") -> DataFrame:
    """Single flight: of the stale requests of a key the first one revalidates."""
    return states.where(F.col("state") == "stale").groupBy(key).agg(F.min(F.struct(at, "request")).alias("_f")).select(key, F.col("_f.request").alias("request"))


def keep_variants(variants: DataFrame, most: int, key: str = "key", used: str = "last_access") -> DataFrame:
    """At most ``most`` variants a key, the least recently used ones go."""
    w = Window.partitionBy(key).orderBy(F.col(used).desc(), "variant")
    return variants.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def resolve(keys: DataFrame, policies: list[dict], key: str = "key") -> DataFrame:
    """CACHE.PROXY: the matching policy of highest priority for each key, with url and tags made from its templates.

    ``policies`` (name, key_pattern, url_template, priority, tags) is a bounded
    list; ties go to the first. ``{1}`` stands for what the first star caught.
    Keys without a policy are left out.
    """
    hit, url, tags = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for p in sorted(policies, key=lambda p: p["priority"]):
        regex = capturing_glob(p["key_pattern"])

        def fill(template: str, regex: str = regex, stars: int = p["key_pattern"].count("*")) -> Column:
            out = F.lit(template)
            for k in range(1, stars + 1):
                out = F.replace(out, F.lit("{%d}" % k), F.regexp_extract(F.col(key), regex, k))
            return out

        on = F.col(key).rlike(regex)
        hit = F.when(on, F.lit(p["name"])).otherwise(hit)
        url = F.when(on, fill(p["url_template"])).otherwise(url)
        tags = F.when(on, F.concat_ws(",", *(fill(t) for t in p.get("tags", [])))).otherwise(tags)
    return keys.withColumn("policy", hit).where("policy is not null").withColumn("fetch_url", url).withColumn("fetch_tags", tags)


def purge(entries: DataFrame, patterns: list[str], key: str = "key") -> DataFrame:
    """CACHE.PURGE: entries whose key matches none of the globs."""
    for p in patterns:
        entries = entries.where(~matches(F.col(key), p))
    return entries


def tag_index(entries: DataFrame, key: str = "key") -> DataFrame:
    return entries.select(key, F.explode("tags").alias("tag")).distinct()


def purge_tags(entries: DataFrame, tags: list[str]) -> DataFrame:
    """CACHE.PURGETAG."""
    return entries.where(~F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, tags))), F.lit(False)))


def soft_purge(entries: DataFrame, now: Column, keys: list[str] | None = None, tags: list[str] | None = None, key: str = "key") -> DataFrame:
    """CACHE.SOFTPURGE and SOFTPURGETAG: freshness ends now, the later horizons stay."""
    on = F.col(key).isin(keys or [])
    if tags:
        on = on | F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, tags))), F.lit(False))
    return entries.withColumn("fresh_until", F.when(on, F.least("fresh_until", now)).otherwise(F.col("fresh_until")))


def cache_control(header: Column) -> dict[str, Column]:
    """max-age (s-maxage first) and stale-while-revalidate of a Cache-Control header, in seconds."""
    m = F.str_to_map(F.regexp_replace(F.lower(header), r"\s+", ""), F.lit(","), F.lit("="))
    number = lambda k: F.try_element_at(m, F.lit(k)).try_cast("bigint")
    return {"ttl": F.coalesce(number("s-maxage"), number("max-age")), "swr": number("stale-while-revalidate")}


def variant_hash(vary: list[str], headers: Column) -> Column:
    """A hash of the headers named by Vary, normalised: languages without weights, encodings in order."""
    parts = []
    for name in sorted(v.lower() for v in vary):
        v = F.lower(F.coalesce(F.try_element_at(headers, F.lit(name)), F.lit("")))
        items = F.transform(F.split(v, ","), lambda x: F.trim(F.split_part(x, F.lit(";"), F.lit(1))))
        parts += [F.lit(name), F.array_join(F.array_sort(items) if name == "accept-encoding" else items, ",")]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("bigint")
