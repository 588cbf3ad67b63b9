"""Shared helpers of the training-data operators: tables, scratch space, byte-level text hashing."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as the contracts define words by it.
SPACES = "\x20\x09-\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bounds the Arrow batches that workers get by their bytes: 10,000 long texts at once would take some 100 MB in each worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64m", "64MB"):  # the default; another setting is the user's
        spark.conf.set(key, str(most))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session (tests) may lack the setting; it then gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and readable after any executor is lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables made by :func:`written` that no later plan reads."""
    for df in tables:
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def pieces(df: DataFrame, target: int = 64 << 20, estimate: int | None = None) -> int:
    """Partitions that hold about ``target`` bytes each, and no fewer than the session's shuffle has."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = plan_bytes(df) if estimate is None else estimate
    if size >= 1 << 60:  # Catalyst does not know: measured
        size = df.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    return max(least, math.ceil(size / target))


def broadcast_if_small(df: DataFrame, rows: int, bound: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within ``bound``; else Spark shuffles it."""
    return F.broadcast(df) if rows <= bound else df


def ascii_lower(col):
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- words and shingles of a batch of texts, on their bytes -------------------------------------------------

_R = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _R.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_UPPER = np.arange(65, 91)
_BYTE[_UPPER] = _BYTE[_UPPER + 32]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)


_POWERS: list[np.ndarray] = []


def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``2 ** bits`` powers of the base and of its inverse; the largest arrays asked for are kept."""
    n = 1 << bits
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for base in (_BASE, _BASE_INV):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            with np.errstate(over="ignore"):
                _POWERS.append(np.cumprod(x, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


_OWNER: list[str] = []
_CACHES: list = [_POWERS]


def claim(owner: str) -> None:
    """Called in a worker by the operator that starts to use it: what another one has kept there is given back."""
    if _OWNER != [owner]:
        if _OWNER:
            for cache in _CACHES:
                cache.clear()
            gc.collect()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not glibc
                pass
        _OWNER[:] = [owner]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes and length of each range of ``data`` (uint8); ``table``: a random odd number for each byte."""
    up, down = _powers(max(12, int(len(data)).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], dtype=np.uint64, out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each maximal run of non-space bytes; A-Z count as a-z. ``data``: uint8."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    space = _SPACE[data]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return starts, range_hashes(data, starts, ends, _BYTE)


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles.

    A text of fewer than k words has its whole word sequence as one shingle; one without words has none.
    """
    raw = [t or b"" for t in texts]
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    starts, words = word_hashes(data)
    bounds = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in raw], out=bounds[1:])
    first = np.searchsorted(starts, bounds)
    mult = _R2[:k]
    with np.errstate(over="ignore"):
        n = len(words) - k + 1
        grams = np.zeros(max(n, 0), np.uint64)
        for j in range(k):
            if n > 0:
                grams += words[j : j + n] * mult[j]
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                out.append(np.array([mix64(np.sum(words[a:b] * mult[: b - a], dtype=np.uint64) + np.uint64(int(b - a)))], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_R2 = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def utf8(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string array, without decoding."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def text_batches(column, limit: int = 4 << 20):
    """(start, end) ranges of ``column`` (a list of bytes) of about ``limit`` bytes each."""
    start = total = 0
    for i, t in enumerate(column):
        total += len(t or b"") + 1
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(column):
        yield start, len(column)


class HashIndex:
    """Numbers for 64-bit hashes: open addressing in two arrays, whole arrays of hashes at a time. 0 is no hash."""

    def __init__(self, most: int):
        self.slots = 1 << max(12, (2 * most).bit_length())
        self.clear()

    def clear(self) -> None:
        self.keys, self.place = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each known hash, -1 for others."""
        out, mask = np.full(len(h), -1, np.int32), np.uint64(self.slots - 1)
        todo, slot = np.arange(len(h)), h & mask
        while len(todo):
            key = self.keys[slot]
            hit = key == h[todo]
            out[todo[hit]] = self.place[slot[hit]]
            on = ~hit & (key != 0)
            todo, slot = todo[on], slot[on] + np.uint64(1) & mask
        return out

    def learn(self, h: np.ndarray, first: int) -> None:
        """Numbers from ``first`` on for distinct new hashes."""
        mask = np.uint64(self.slots - 1)
        todo, slot = np.arange(len(h)), h & mask
        while len(todo):
            free = self.keys[slot] == 0
            _, one = np.unique(slot[free], return_index=True)
            some = np.flatnonzero(free)[one]
            self.keys[slot[some]], self.place[slot[some]] = h[todo[some]], first + todo[some]
            on = np.ones(len(todo), bool)
            on[some] = False
            todo, slot = todo[on], slot[on]
            # Whoever lost a free slot looks at it again, and finds it taken.
            slot = np.where(self.keys[slot] != 0, slot + np.uint64(1) & mask, slot)


# --- connected components -----------------------------------------------------------------------------------


def _union_find(batches):
    """Edges (u, v) in one task to (id, component)."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            u, v = root(parent.setdefault(u, u)), root(parent.setdefault(v, v))
            parent[max(u, v)] = min(u, v)
    ids = list(parent)
    for at in range(0, len(ids), 50_000):
        some = ids[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], names=["id", "component"])


def components(edges: DataFrame, max_rounds: int = 60, one_task: int = 400_000) -> DataFrame:
    """(id, component): for each end of ``edges`` (a, b) the least id reachable from it.

    Up to ``one_task`` distinct edges, counted first, one task joins them (a few MB). More of them go through stars:
    alternates large-star and small-star steps (Kiveris et al. 2014) until the set of edges stays the same.
    Every step aggregates before it shuffles and ends in a table in the shared folder; the number of steps is
    logarithmic in the longest path. Null ends and loops count for nothing.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e, mark = _kept(e, "edges")
    if mark[0] <= one_task:
        return e.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(_union_find, "id long, component long")
    for _ in range(max_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new, now = _kept(small, "edges")
        discard(spark, e)
        e = new
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    star = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    roots = e.select(F.col("v").alias("id")).distinct().join(star.select("id"), "id", "left_anti").withColumn("component", F.col("id"))
    return star.unionByName(roots)


def _kept(e: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    e = written(e, name)
    row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return e, tuple(row)


LONG, STR, DBL = T.LongType(), T.StringType(), T.DoubleType()
