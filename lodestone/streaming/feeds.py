"""Structured Streaming adapters: channels, row triggers and expiring keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.keyvalue import glob_regex


def subscribe(messages: DataFrame, channels: list[str] | None = None, patterns: list[str] | None = None) -> DataFrame:
    """Messages (channel, ...) of the channels named, or of those a glob pattern fits. Works on streams and on tables."""
    hit = F.lit(False)
    if channels:
        hit = hit | F.col("channel").isin(channels)
    for p in patterns or []:
        hit = hit | F.col("channel").rlike(glob_regex(p))
    return messages.where(hit)


def on_rows(stream: DataFrame, f: Callable[[DataFrame], None], checkpoint: str):
    """Calls ``f`` for the rows of each micro-batch; a failure is not swallowed, so the batch is tried again."""
    return stream.writeStream.foreachBatch(lambda rows, _: f(rows)).option("checkpointLocation", checkpoint).start()


def recency(access: DataFrame, ts: str = "ts", key: str = "key", bucket: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Accesses of each key in time buckets; on a stream, rows later than ``late`` are left out."""
    if access.isStreaming:
        access = access.withWatermark(ts, late)
    return access.groupBy(F.window(ts, bucket), key).agg(F.count("*").alias("hits"), F.max(ts).alias("last"))


#: Groups that keys are dealt to; fixed, as the state of a running stream is kept by them.
GROUPS = 2048


def expiring(writes: DataFrame, seconds: int, late: str = "0 seconds") -> DataFrame:
    """(key, value, at, gone) of a stream of writes (key, value, ts): each value with the time of its write, and the time at which
    it expired, ``seconds`` after it, unless a later write of the key came before. A write without a time is left out.

    A value is told when it is overwritten or when the watermark passes its end. State is one value a key and goes with it.
    Keys are dealt to ``GROUPS`` by hash and a group is worked on as a whole, as Python's cost is by call and not by row; a task holds
    one group's writes of a micro-batch, whose size is the source's to limit.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def work(group, frames, state):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        parts = [pa.ipc.open_stream(state.get[0]).read_pandas().assign(fresh=False)] if state.exists else []
        if not state.hasTimedOut:
            parts += [f[["key", "value", "written"]].assign(due=0, fresh=True) for f in frames]
        rows = pd.concat(parts, ignore_index=True)
        rows["who"] = pd.factorize(rows["key"], use_na_sentinel=False)[0]
        rows = rows.sort_values(["who", "fresh", "written", "value"], kind="stable", ignore_index=True)
        who, at = rows["who"].to_numpy(), rows["written"].to_numpy()
        last = np.append(who[1:] != who[:-1], True)
        # A new value that the watermark has passed already ends with a later batch, as the next may overwrite it yet.
        mark, fresh = state.getCurrentWatermarkMs(), rows["fresh"].to_numpy(dtype=bool)
        due = np.where(fresh, np.maximum(at // 1000 + seconds * 1000, mark + 1), rows["due"].to_numpy())
        over = last & (due < mark)
        told = rows[["key", "value", "written"]].assign(ended=over | ~last & (at + seconds * 1_000_000 <= np.append(at[1:], 0)))
        held = last & ~over
        if held.any():
            kept = pa.RecordBatch.from_pandas(rows.assign(due=due)[held], pa.schema([("key", pa.string()), ("value", pa.string()), ("written", pa.int64()), ("due", pa.int64())]), preserve_index=False)
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, kept.schema) as stream:
                stream.write_batch(kept)
            state.update((out.getvalue().to_pybytes(),))
            state.setTimeoutTimestamp(int(due[held].min()))
        elif state.exists:
            state.remove()
        yield told[~held]

    keyed = writes.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.col("ts").cast("timestamp").alias("ts")).where("ts is not null").withWatermark("ts", late)
    dealt = keyed.withColumns({"written": F.unix_micros("ts"), "group": F.pmod(F.xxhash64("key"), F.lit(GROUPS))})
    told = dealt.groupBy("group").applyInPandasWithState(work, "key string, value string, written long, ended boolean", "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    at = F.timestamp_micros("written")
    return told.select("key", "value", at.alias("at"), F.when(F.col("ended"), at + F.expr(f"interval {seconds} seconds")).alias("gone"))
