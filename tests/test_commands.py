"""Key/value commands beyond the registered queries: keys held as plans, touched keys written into the tables, odd uses."""

import pytest

from lodestone.operators import commands, keyvalue
from lodestone.operators.commands import CommandError, Keyspace


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(commands, "SMALL", 2)
    monkeypatch.setattr(commands, "TOUCHED", 3)


def test_large_keys_stay_plans_and_touched_keys_are_folded(spark, small):
    k = Keyspace(spark)
    assert k.execute("SADD", "s", *range(6)) == 6
    assert k.execute("SADD", "s", 5, 6, 7) == 2 and k.execute("SCARD", "s") == 8
    for i in range(6):
        k.execute("SET", f"k{i}", i)
    assert len(k.db.touched) <= 3
    assert k.execute("DBSIZE") == 7 and k.execute("GET", "k0") == "0" and k.execute("SCARD", "s") == 8
    k.execute("DEL", "k0", "s")
    for i in range(6, 12):
        k.execute("SET", f"k{i}", i)
    assert k.execute("EXISTS", "k0") == k.execute("EXISTS", "s") == 0 and k.execute("DBSIZE") == 11
    assert sorted(r.key for r in k.execute("KEYS", "k1*").collect()) == ["k1", "k10", "k11"]


def test_expiry_by_the_clock(spark, monkeypatch):
    k, now = Keyspace(spark), [1000.0]
    monkeypatch.setattr(commands.time, "time", lambda: now[0])
    k.execute("SET", "a", 1)
    k.execute("RPUSH", "l", "x")
    assert k.execute("EXPIRE", "a", 10) == k.execute("EXPIRE", "l", 20) == 1
    now[0] = 1009.0
    assert k.execute("TTL", "a") == 1 and k.execute("INCR", "a") == 2 and k.execute("TTL", "a") == 1
    assert k.execute("RENAME", "l", "m") == "OK" and k.execute("TTL", "m") == 11
    now[0] = 1010.0
    assert k.execute("GET", "a") is None and k.execute("DBSIZE") == 1 and k.execute("TTL", "a") == -1
    now[0] = 1030.0
    assert k.execute("DBSIZE") == 0 and k.execute("LLEN", "m") == 0


def test_stored_results_may_replace_their_sources(spark):
    k = Keyspace(spark)
    k.execute("SADD", "a", "x", "y", "z")
    k.execute("SADD", "b", "y", "z", "w")
    assert k.execute("SINTERSTORE", "a", "a", "b") == 2
    assert sorted(r.member for r in k.execute("SMEMBERS", "a").collect()) == ["y", "z"]
    k.execute("LPUSH", "l", 1, 2)
    assert k.execute("RPOPLPUSH", "l", "l") == "1" and [r.value for r in k.execute("LRANGE", "l", 0, -1).collect()] == ["1", "2"]
    assert k.execute("SMOVE", "a", "a", "y") == 1 and k.execute("SCARD", "a") == 2
    k.execute("ZADD", "z", 1, "m")
    assert k.execute("ZUNIONSTORE", "z", 2, "z", "a", "WEIGHTS", 10, 1) == 3 and k.execute("ZSCORE", "z", "m") == 10
    with pytest.raises(CommandError):
        k.execute("SADD", "l", "x")
    with pytest.raises(CommandError):
        k.execute("SORT", "none", "WIDTH", 3)


def test_functions_on_tables_keep_one_row_a_key(spark):
    table = spark.createDataFrame([("a", "1", None)], "key string, value string, expire_at timestamp")
    new = spark.createDataFrame([("b", "1"), ("b", "2"), ("a", "9")], "key string, value string").coalesce(1)
    assert sorted(map(tuple, keyvalue.put(table, new).select("key", "value").collect())) == [("a", "9"), ("b", "2")]
    z = spark.createDataFrame([("z", "m", 1.0), ("z", "m", 3.0)], "key string, member string, score double").coalesce(1)
    assert [r.score for r in keyvalue.zadd(z.limit(0), z).collect()] == [3.0]
    with pytest.raises(ValueError):
        keyvalue.rename(table, "none", "a")
    with pytest.raises(ValueError):
        keyvalue.rename(table, "a", "a")
    wrap = spark.createDataFrame([("h", {"n": str(2**63 - 1)})], "key string, fields map<string,string>")
    assert keyvalue.hincrby(wrap, "h", "n", 1).first().fields["n"] == str(-(2**63))
