"""Golden cases, edge cases and small models of the keyspace operators."""

import datetime
import os

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.functions import columns
from keyloom.operators import bits, cache, geo, jsondoc, keyspace, sketch, sorting, strings, zsets
from keyloom.operators import collections as c
from keyloom.sources import oplog
from keyloom.streaming import groups

RELAXED = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("pattern", "yes", "no"), [
    ("h?llo", "hello", "hllo"), ("h*o", "ho", "hoe"), ("h[ae]llo", "hallo", "hillo"), ("h[^e]llo", "hallo", "hello"),
    ("a\\*b", "a*b", "axb"), ("[a-c]*", "beta", "delta"), ("x[y", "x[y", "xy"), ("*", "a\nb", None), ("a.c", "a.c", "abc"),
])
def test_glob(spark, pattern, yes, no):
    assert one(spark, columns.matches(F.lit(yes), pattern))
    if no is not None:
        assert not one(spark, columns.matches(F.lit(no), pattern))


def test_slot_uses_the_tag(spark):
    slot = lambda k: one(spark, columns.slot(F.lit(k)))
    assert slot("{user1}.a") == slot("{user1}.b") == slot("user1")
    assert slot("") == 0

    def crc(data):  # CRC-16/USB bit by bit
        r = 0xFFFF
        for b in data:
            r ^= b
            for _ in range(8):
                r = r >> 1 ^ 0xA001 if r & 1 else r >> 1
        return r ^ 0xFFFF

    assert crc(b"123456789") == 0xB4C8
    assert slot("123456789") == 0xB4C8 % 16384


@pytest.mark.parametrize(("start", "end", "want"), [(0, 3, "This"), (-3, -1, "ing"), (0, -1, "This is a string"), (10, 100, "string"), (5, 2, ""), (99, 100, "")])
def test_getrange(spark, start, end, want):
    assert bytes(one(spark, strings.get_range(F.lit("This is a string"), start, end))).decode() == want


def test_setrange_pads(spark):
    assert bytes(one(spark, strings.set_range(F.lit("ab"), 4, "X"))) == b"ab\0\0X"
    assert bytes(one(spark, strings.set_range(F.lit("hello world"), 6, "there"))) == b"hello there"
    assert bytes(one(spark, strings.set_range(F.lit("ab"), 5, ""))) == b"ab"


def test_counter_overflow_is_an_error(spark):
    df = spark.createDataFrame([("k", 2**63 - 1), ("k", 1)], "key string, d long")
    with pytest.raises(Exception, match="(?i)overflow"):
        strings.incr_by(df, ["key"], "d").collect()


def test_mset_msetnx(spark):
    t = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    new = spark.createDataFrame([("b", "9"), ("c", "3")], "key string, value string")
    assert sorted(map(tuple, strings.mset(t, new).collect())) == [("a", "1"), ("b", "9"), ("c", "3")]
    assert strings.msetnx(t, new).count() == 2
    assert strings.msetnx(t, new.where("key = 'c'")).count() == 3


def test_ttl_codes(spark):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    df = spark.createDataFrame([("a", None), ("b", at(1)), ("c", at(30))], "key string, expire_at timestamp_ntz")
    now = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:10'")
    assert {r["key"]: (r["ttl"], r["pttl"]) for r in keyspace.ttl(df, now).collect()} == {"a": (-1, -1), "b": (-2, -2), "c": (20, 20000)}
    assert {r["key"] for r in keyspace.live(df, now).collect()} == {"a", "c"}


def test_rename_overwrites(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "key string, v int")
    pairs = spark.createDataFrame([("a", "b"), ("none", "a")], "src string, dst string")
    assert [tuple(r) for r in keyspace.rename(df, pairs).collect()] == [("b", 1)]
    assert keyspace.rename(df, pairs, only_new=True).count() == 3


def test_evict_keeps_the_budget(spark):
    df = spark.createDataFrame([(i, i * 7 % 50, 10) for i in range(50)], "key int, used int, size int")
    gone = keyspace.evict(df, [F.col("used"), F.col("key")], "size", 200).collect()
    assert len(gone) == 30 and max(r["used"] for r in gone) == 29


def test_pick_sizes(spark):
    df = spark.createDataFrame([("k", i) for i in range(5)] + [("j", 1)], "key string, member int")
    assert keyspace.pick(df, ["key"], "member", 3).count() == 4
    assert keyspace.pick(df, ["key"], "member", 7, repeat=True).count() == 14


def test_bitfield_modes(spark):
    df = spark.createDataFrame([(bytearray(b"\xff"),), (None,)], "v binary")
    got = df.select(bits.bitfield([("INCRBY", "u8", 0, 1), ("OVERFLOW", "SAT"), ("INCRBY", "u8", 0, 300), ("OVERFLOW", "FAIL"), ("INCRBY", "u8", 0, 1), ("GET", "i8", 0)], F.col("v")).alias("r")).select("r.*").collect()
    assert [(bytes(r["value"]), r["results"]) for r in got] == [(b"\xff", "0,255,,-1"), (b"\xff", "1,255,,-1")]


def test_bitmap_bytes(spark):
    df = spark.createDataFrame([("k", 0), ("k", 9), ("k", 17)], "key string, bit long")
    value = bytes(bits.to_bytes(df, ["key"]).first()["value"])
    assert value == b"\x80\x40\x40"
    assert one(spark, bits.byte_bit_count(F.lit(bytearray(value)))) == 3
    assert one(spark, bits.get_bit(F.lit(bytearray(value)), 9)) == 1
    assert one(spark, bits.get_bit(F.lit(bytearray(value)), 900)) == 0


@RELAXED
@given(values=st.lists(st.sampled_from("abc"), min_size=1, max_size=12), start=st.integers(-14, 14), stop=st.integers(-14, 14))
def test_lrange_is_a_slice(spark, values, start, stop):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "key string, pos long, elem string")
    n = len(values)
    lo, hi = max(start if start >= 0 else n + start, 0), (stop if stop >= 0 else n + stop)
    got = [r["elem"] for r in c.lrange(df, start, stop).orderBy("index").collect()]
    assert got == (values[lo : hi + 1] if hi >= lo else [])


@RELAXED
@given(ops=st.lists(st.tuples(st.sampled_from(["add", "rem"]), st.integers(0, 4)), min_size=1, max_size=20))
def test_set_log_fold(spark, ops):
    model = set()
    for op, m in ops:
        model.add(m) if op == "add" else model.discard(m)
    df = spark.createDataFrame([("k", m, op == "rem", i) for i, (op, m) in enumerate(ops)], "key string, member int, deleted boolean, seq int")
    assert {r["member"] for r in oplog.compact(df, ["key", "member"], [], "seq").collect()} == model


def test_lists(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate("abcab")], "key string, pos long, elem string")
    elems = lambda d, by="pos": "".join(r["elem"] for r in d.orderBy(by).collect())
    assert elems(c.lrem(df, 1, "a")) == "bcab"
    assert elems(c.lrem(df, -1, "a")) == "abcb"
    assert elems(c.lrem(df, 0, "a")) == "bcb"
    assert elems(c.linsert(df, "b", "X", before=False), "index") == "abXcab"
    assert elems(c.linsert(df, "zz", "X", before=False), "index") == "abcab"
    assert elems(c.lset(df, -1, "Z")) == "abcaZ"
    assert [r["index"] for r in c.lpos(df, "b", rank=-1, count=0).orderBy("index").collect()] == [1, 4]
    assert c.lpos(df, "b", rank=1, count=0, maxlen=2).count() == 1
    more = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y"), ("new", 1, "n")], "key string, seq int, elem string")
    assert elems(c.push(df, more, left=True).where("key = 'k'")) == "yxabcab"
    assert c.push(df, more, left=False, only_existing=True).where("key = 'new'").count() == 0
    moved = c.lmove(df, "k", "d", True, False)
    assert elems(moved.where("key = 'd'")) == "a" and elems(moved.where("key = 'k'")) == "bcab"
    assert c.lmove(df, "none", "d", True, False).count() == 5


def test_zset_order_and_bounds(spark):
    df = spark.createDataFrame([("k", m, s) for m, s in (("b", 1.0), ("a", 1.0), ("c", 2.0), ("n", float("nan")))], "key string, member string, score double")
    assert [r["member"] for r in zsets.ranked(df.where("member <> 'n'")).orderBy("rank").collect()] == ["a", "b", "c"]
    assert [r["member"] for r in zsets.ranked(df.where("member <> 'n'"), True).orderBy("rank").collect()] == ["c", "b", "a"]
    assert zsets.zcount(df, "(1", "+inf").first()["n"] == 1
    assert zsets.zcount(df, "+inf", "5").first()["n"] == 0
    assert zsets.zrange_by_lex(df.where("member <> 'c'"), "-", "+").count() == 0  # scores differ
    assert zsets.zrange_by_lex(df.where("score = 1"), "[a", "(b").count() == 1
    assert {r["member"]: r["added"] for r in zsets.zadd_to(df.where("score < 2"), df.where("score = 2"), "XX").collect()} == {"a": 0, "b": 0}
    assert one(spark, columns.number_text(F.lit(2.0))) == "2" and one(spark, columns.number_text(F.lit(2.5))) == "2.5"


def test_geo_round_trip_and_known_distance(spark):
    lon, lat = F.lit(2.2945), F.lit(48.8582)
    p = one(spark, geo.position(geo.score(lon, lat)))
    assert abs(p["lon"] - 2.2945) < 1e-4 and abs(p["lat"] - 48.8582) < 1e-4
    assert one(spark, geo.geohash(geo.score(F.lit(-5.6), F.lit(42.6)))).startswith("ezs42")
    d = one(spark, geo.distance(F.lit(13.361389), F.lit(38.115556), F.lit(15.087269), F.lit(37.502669), "km"))
    assert abs(d - 166.274) < 0.01
    assert not one(spark, geo.valid(F.lit(200.0), F.lit(0.0))) and not one(spark, geo.valid(F.lit(0.0), F.lit(90.0)))


@pytest.mark.parametrize("km", [1, 50, 900, 6000, 20100])
def test_geo_radius_is_exact(spark, km):
    rng = np.random.default_rng(1)
    pts = [("k", i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-180, 180, 300), rng.uniform(-85, 85, 300), strict=True))]
    df = spark.createDataFrame(pts, "key string, member int, lon double, lat double")
    for clon, clat in ((179.9, 10.0), (0.0, 84.9), (-30.0, -50.0)):
        centres = spark.createDataFrame([("k", 0, clon, clat)], "key string, centre int, clon double, clat double")
        got = sorted(r["member"] for r in geo.radius(df, centres, km, "km").collect())
        want = df.where(geo.distance(F.lit(clon), F.lit(clat), F.col("lon"), F.col("lat"), "km") <= km)
        assert got == sorted(r["member"] for r in want.collect())


def test_json_paths(spark):
    df = spark.createDataFrame([('{"a":{"b":[1,2,3]},"s":"x","t":true,"n":null}',), ("not json",), (None,)], "d string")
    run = lambda f: [r["x"] for r in df.select(f(F.col("d")).alias("x")).collect()]
    assert run(jsondoc.arr_append("$.a.b", 4))[0] == '{"a":{"b":[1,2,3,4]},"s":"x","t":true,"n":null}'
    assert run(jsondoc.arr_insert("$.a.b", -1, 9))[0].startswith('{"a":{"b":[1,2,9,3]}')
    assert run(jsondoc.arr_trim("$.a.b", 1, -1))[0].startswith('{"a":{"b":[2,3]}')
    assert run(jsondoc.arr_pop("$.a.b", 0))[0].startswith('{"a":{"b":[2,3]}')
    assert run(jsondoc.remove("$.a.b[1]"))[0].startswith('{"a":{"b":[1,3]}')
    assert run(jsondoc.remove("$"))[0] == "null"
    assert run(jsondoc.toggle("$.t"))[0].endswith('"t":false,"n":null}')
    assert run(jsondoc.set_value("$.a.none.deep", 1))[0] == run(lambda d: d)[0]  # no container
    assert run(jsondoc.set_value("$.z", 1))[1:] == ["not json", None]
    assert [run(lambda d, p=p: jsondoc.kind(d, p))[0] for p in ("$", "$.a.b", "$.s", "$.t", "$.a.b[0]", "$.n", "$.zz")] == ["object", "array", "string", "boolean", "number", "null", None]
    assert run(lambda d: jsondoc.arr_index(d, "$.a.b", "3"))[0] == 2
    assert run(lambda d: jsondoc.obj_len(d))[0] == 4


def test_hll_and_bloom(spark):
    df = spark.range(20000).select(F.lit("k").alias("key"), F.concat(F.lit("user:"), "id").alias("e"))
    exact = 20000
    assert abs(sketch.pfcount(sketch.pfadd(df, ["key"], "e"), ["key"]).first()["n"] - exact) < 3 * 0.0081 * exact
    assert abs(sketch.registers_count(sketch.registers(df, ["key"], "e"), ["key"]).first()["n"] - exact) < 4 * 0.0081 * exact
    b, k = sketch.bloom_size(20000, 0.01)
    f = sketch.bloom_add(df, ["key"], "e", b, k)
    assert sketch.bloom_exists(df, f, ["key"], "e", b, k).where("maybe = 0").count() == 0
    others = spark.range(20000, 40000).select(F.lit("k").alias("key"), F.concat(F.lit("user:"), "id").alias("e"))
    assert sketch.bloom_exists(others, f, ["key"], "e", b, k).where("maybe = 1").count() < 20000 * 0.015
    assert sketch.murmur3_x64_128(b"") == (0, 0)


def test_sort_store_free_weights(spark):
    elems = spark.createDataFrame([("3",), ("10",), ("x",), ("1",)], "elem string")
    assert [r["get_1"] for r in sorting.sort(elems).orderBy("pos").collect()] == ["x", "1", "3", "10"]
    assert [r["get_1"] for r in sorting.sort(elems, desc=True, offset=1, limit=2).orderBy("pos").collect()] == ["3", "1"]
    weights = spark.createDataFrame([("w_3", "1"), ("w_10", "0")], "key string, value string")
    assert [r["get_2"] for r in sorting.sort(elems, by="w_*", get=("#", "w_*"), limit=4, desc=True, strings=weights).orderBy("pos").collect()][0] == "1"


def test_cache_control(spark):
    cc = cache.cache_control(F.lit("Public, max-age=60, S-MaxAge=30 , stale-while-revalidate=5"))
    assert (one(spark, cc["ttl"]), one(spark, cc["swr"])) == (30, 5)
    h = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    a = one(spark, cache.variant_hash(["Accept-Encoding"], h({"accept-encoding": "gzip, br;q=0.5"})))
    assert a == one(spark, cache.variant_hash(["accept-encoding"], h({"accept-encoding": "BR,GZIP"})))


def test_resp_log(spark, tmp_path):
    commands = [["SET", "a", "é\r\nx"], ["MULTI"], ["INCR", "b"], ["EXEC"], ["MULTI"], ["INCR", "c"]]
    data = "".join(map(oplog.encode, commands)).encode()
    assert list(oplog.decode(data + b"*2\r\n$3\r\nGE")) == commands  # torn tail
    with pytest.raises(ValueError):
        list(oplog.decode(b"hello\r\n"))
    df = spark.createDataFrame([(c,) for c in commands], "args array<string>").coalesce(1)
    oplog.write_aof(df, str(tmp_path / "log"))
    rows = oplog.read_aof(spark, str(tmp_path / "log")).orderBy("seq").collect()
    assert [r["args"] for r in rows] == [commands[0], commands[2]] and rows[0]["tx_id"] is None and rows[1]["tx_id"]
    snap = str(tmp_path / "snap")
    oplog.save_snapshot(df, snap)
    assert oplog.load_snapshot(spark, snap).count() == len(commands)


def run_stream(spark, df, schema, tmp_path, apply, name):
    src = str(tmp_path / "in")
    df.write.parquet(src)
    q = apply(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streaming_group_equals_batch(spark, tmp_path):
    from keyloom.operators import streams

    df = spark.createDataFrame([(k, i, 0) for k in ("a", "b") for i in range(7)], "key string, ts_ms long, seq long").coalesce(1)
    got = run_stream(spark, df, df.schema, tmp_path, lambda s: groups.deliver(s, ["c0", "c1"], 2), "delivered")
    batch = streams.readgroup(df, ["c0", "c1"], 2).select("key", "ts_ms", "seq", "batch", "consumer").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))


def test_streaming_pop(spark, tmp_path):
    df = spark.createDataFrame([("k", 1, "pop", "w1"), ("k", 2, "push", "a"), ("k", 3, "push", "b"), ("k", 4, "pop", "w2"), ("k", 5, "pop", "w3")], "key string, at long, kind string, value string").coalesce(1)
    got = run_stream(spark, df, df.schema, tmp_path, groups.blocking_pop, "popped")
    assert sorted(map(tuple, got)) == [("k", "w1", "a"), ("k", "w2", "b")]


@pytest.mark.parametrize(
    "end, want",
    [
        ("left", [("k", "w1", "c"), ("k", "w3", "a")]),
        ("right", [("k", "w1", "b"), ("k", "w3", "a")]),
        ("min", [("k", "w1", "a"), ("k", "w3", "b")]),
        ("max", [("k", "w1", "c"), ("k", "w3", "b")]),
    ],
)
def test_streaming_pop_ends(spark, tmp_path, end, want):
    schema = "key string, at long, kind string, value string, score double, until long"
    rows = [("k", 1, "pop", "w1", None, None), ("k", 2, "push", "a", 1.0, None), ("k", 2, "push", "b", 2.0, None), ("k", 2, "lpush", "c", 3.0, None)]
    rows += [("k", 4, "pop", "w3", None, None)]
    late = [("j", 1, "pop", "w2", None, 5), ("j", 9, "push", "z", 1.0, None)]
    df = spark.createDataFrame(rows + late, schema).coalesce(1)
    got = run_stream(spark, df, df.schema, tmp_path, lambda a: groups.blocking_pop(a, end), "popped_" + end)
    assert sorted(tuple(r) for r in got if r["key"] == "k") == want
    assert [tuple(r) for r in got if r["key"] == "j"] == [("j", "w2", None)]


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).count() > 0


def test_jsonpath():
    from keyloom.functions.jsonpath import find, parse

    doc = {"a": [{"b": 1, "c": "x"}, {"b": 5}, {"c": [1, 2, 3]}], "b": 9}
    q = lambda p: find(doc, parse(p))
    assert q("$..b") == [9, 1, 5] and q("$.a[*].b") == [1, 5] and q("$.a[-1].c[0:2]") == [1, 2]
    assert q("$.a[?(@.b > 2)].b") == [5] and q("$.a[?(@.c)].b") == [1] and q("$['b','none']") == [9] and q("$") == [doc]
    assert q("$.a[?(@.c == 'x')].b") == [1] and q("$.none.b") == []


def test_scripts(spark):
    from keyloom.functions.scripts import Scripts

    def shout(values):
        return values.str.upper() + "!"

    def first_of_key(rows):
        return rows.groupby("key", as_index=False).agg(n=("v", "count"))

    s = Scripts()
    sha = s.load(shout, "string")
    assert s.exists(sha, "none") == [True, False]
    assert one(spark, s.call(sha, F.lit("a"))) == "A!"
    by_key = s.load(first_of_key, "key string, n long")
    rows = spark.createDataFrame([("k", 1), ("k", 2), ("j", 3)], "key string, v long")
    assert sorted(map(tuple, s.call_by_key(by_key, rows, "key").collect())) == [("j", 1), ("k", 2)]
    s.flush()
    assert s.exists(sha) == [False]


def test_evict_policies(spark):
    df = spark.createDataFrame([(i, i, i % 3, None if i % 2 else i, 10) for i in range(20)], "key int, last_access int, uses int, expire_at int, size int")
    assert keyspace.evict_by(df, "noeviction", "size", 0).count() == 0
    assert {r["key"] for r in keyspace.evict_by(df, "volatile-ttl", "size", 170).collect()} == {0, 2, 4}
    assert {r["key"] for r in keyspace.evict_by(df, "allkeys-lfu", "size", 170).collect()} == {0, 3, 6}
    assert keyspace.evict_by(df, "allkeys-random", "size", 150).count() == 5
