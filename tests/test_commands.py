"""The command front end."""

import pytest

from keyloom.plans.commands import Keyspace, WrongType, run_script


def values(df):
    return [tuple(r)[0] if len(r) == 1 else tuple(r) for r in df.collect()]


def test_session(spark):
    ks = run_script(Keyspace.of(spark), [
        "SET a 1", "INCRBY a 41", "MSET b x c y", "APPEND b z", "HSET h f 1 g 2", "HSETNX h f 9", "HDEL h g", "SADD s m n o", "SREM s o",
        "RPUSH l a b c a", "LPUSH l z", "LREM l 1 a", "ZADD z 1 p 2 q 3 r", "ZADD z GT 0 q 9 r", "ZINCRBY z 5 p",
    ])
    assert values(ks.read("GET a")) == ["42"] and values(ks.read("GET b")) == ["xz"]
    assert values(ks.read("MGET a none c")) == [(("none", 1, None)) if k == "none" else (k, p, v) for p, (k, v) in enumerate((("a", "42"), ("none", None), ("c", "y")))]
    assert values(ks.read("HGETALL h")) == [("f", "1")]
    assert sorted(values(ks.read("SMEMBERS s"))) == ["m", "n"]
    assert values(ks.read("LRANGE l 0 -1")) == ["z", "b", "c", "a"]
    assert values(ks.read("ZREVRANGE z 0 -1 WITHSCORES")) == [("r", 9.0), ("p", 6.0), ("q", 2.0)]
    assert sorted(values(ks.read("KEYS ?"))) == ["a", "b", "c", "h", "l", "s", "z"]
    assert values(ks.read("EXISTS a a none")) == [2]
    assert values(ks.write("RENAME a moved").read("GET moved")) == ["42"]
    assert values(ks.write("DEL a b").read("DBSIZE")) == [5]
    with pytest.raises(WrongType):
        ks.write("SET h 1")
    with pytest.raises(ValueError, match="unknown"):
        ks.read("NOPE x")


def test_json_stream_geo_sort(spark):
    ks = run_script(Keyspace.of(spark), [
        "JSON.SET j $ '{\"n\":1,\"l\":[1]}'", "JSON.NUMINCRBY j $.n 2", "JSON.ARRAPPEND j $.l 5", "XADD st 5-1 k v", "XADD st 6-0 k w",
        "GEOADD g 13.361389 38.115556 Palermo", "GEOADD g 15.087269 37.502669 Catania", "RPUSH l 2 10 1", "SET w_2 0",
    ])
    assert values(ks.read("JSON.GET j")) == ['{"n":3,"l":[1,5]}'] and values(ks.read("JSON.ARRLEN j $.l")) == [2]
    assert [r[1:3] for r in values(ks.read("XRANGE st 5-1 +"))] == [(5, 1), (6, 0)]
    with pytest.raises(ValueError, match="exceed"):
        ks.write("XADD st 6-0 k w")
    assert round(values(ks.read("GEODIST g Palermo Catania km"))[0], 1) == 166.3
    assert [r[0] for r in values(ks.read("GEORADIUS g 15 37 200 km"))] == ["Catania", "Palermo"]
    assert values(ks.read("SORT l DESC LIMIT 0 2")) == [(0, "10"), (1, "2")]
