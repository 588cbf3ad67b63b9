"""Streams of several micro-batches."""

import os
import random

import pytest

from lodestone.streaming import feeds


def _told(batches, seconds, late):
    """Key after key; a batch goes without what the watermark had passed when the one before began, and what it writes doesn't end with it."""
    held, out, mark, before = {}, [], 0, 0
    for batch in [*batches, []]:
        fresh: dict = {}
        for key, value, ts in batch:
            if ts // 1000 > before:
                fresh.setdefault(key, []).append((ts, value))
        for key, rows in fresh.items():
            for ts, value in sorted(rows):
                if key in held:
                    last, old, _ = held[key]
                    out.append((key, old, last, last + seconds * 1_000_000 if last + seconds * 1_000_000 <= ts else None))
                held[key] = (ts, value, max(ts // 1000 + seconds * 1000, mark + 1))
        for key in [k for k, (_, _, due) in held.items() if due < mark]:
            ts, value, _ = held.pop(key)
            out.append((key, value, ts, ts + seconds * 1_000_000))
        before, mark = mark, max([mark, *(ts // 1000 - late * 1000 for _, _, ts in batch)])
    return out


@pytest.mark.parametrize("late", [0, 30])
def test_expiring_keys_share_groups_over_batches(spark, tmp_path, monkeypatch, late):
    monkeypatch.setattr(feeds, "GROUPS", 3, raising=False)
    rng, batches, start = random.Random(late), [], 1_700_000_000_000_000
    for b in range(4):
        batches.append([(rng.choice(["a", "b", None, *map(str, range(60))]), rng.choice("xyz"), start + b * 40_000_000 + rng.randrange(60) * 1_000_000) for _ in range(120)])
    (tmp_path / "in").mkdir()
    schema = "key string, value string, at long"
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/{b}")
        (part,) = (tmp_path / str(b)).glob("*.parquet")
        os.utime(part, (1_000_000 + b, 1_000_000 + b))
        part.rename(tmp_path / "in" / f"{b}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in").selectExpr("key", "value", "timestamp_micros(at) AS ts")
    told = feeds.expiring(stream, 20, f"{late} seconds")
    run = told.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/mark").trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.read.schema(told.schema).parquet(f"file://{tmp_path}/out").selectExpr("key", "value", "unix_micros(at)", "unix_micros(gone)").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, _told(batches, 20, late)))
    # The cost is by group: no more of them are held than there are, however many keys.
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]) <= 3


def test_expiring_keys_in_another_time_zone(spark, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        rows = "VALUES ('a', 'x', 1700000000000000), ('a', 'y', 1700000007000000), ('b', 'z', 1700000090000000), ('b', 'none', NULL) AS t(key, value, at)"
        spark.sql(f"SELECT * FROM {rows}").coalesce(1).write.parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema("key string, value string, at long").parquet(f"file://{tmp_path}/in").selectExpr("key", "value", "timestamp_micros(at) AS ts")
        told = feeds.expiring(stream, 10)
        told.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/mark").trigger(availableNow=True).start().awaitTermination()
        got = spark.read.schema(told.schema).parquet(f"file://{tmp_path}/out").selectExpr("value", "unix_micros(at)", "unix_micros(gone)").collect()
        assert sorted(map(tuple, got), key=str) == [("x", 1700000000000000, None), ("y", 1700000007000000, 1700000017000000)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
