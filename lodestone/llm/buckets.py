"""Components of items that share buckets, without emitting the pairs of a bucket.

Buckets with equal members count as one. A bucket's items come together in blocks of bounded rows and weight, each with
what it takes to verify a link, and only a spanning forest of a block's links leaves the task: the rows that are
shuffled are the items of the buckets, once each for a bucket of one block. A bucket of more than ``big`` items first
has every item compared with a few centres, in some turns; items of one component need no comparison with each other,
so afterwards only the items outside the bucket's main component are compared with all of it, block by block. No
bucket is capped, and no two items of different components that share a bucket stay unverified.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def distinct_buckets(keyed: DataFrame) -> DataFrame:
    """(rep, n, key, m, w) of a written table (rep, n, key): of buckets with the same members one; m members, w the sum of n.

    Buckets of one item go, which are most. Members are compared by count, sum and exclusive or of two 64-bit hashes.
    """
    shared = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    keyed = common.written(keyed.join(shared, "key"), "buckets-shared")
    marks = (F.count("*").alias("m"), F.sum("n").alias("w"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x"))
    keys = keyed.groupBy("key").agg(*marks).groupBy("m", "w", "s", "x").agg(F.min("key").alias("key"))
    return common.written(keyed.join(keys.select("key", "m", "w"), "key").select("rep", "n", "key", "m", "w"), "buckets-distinct")


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Which of the links (a, b) make a spanning forest."""
    parent: dict[int, int] = {}
    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        while (p := parent.setdefault(y, y)) != y:
            parent[y] = y = parent.setdefault(p, p)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(k)
    return keep


def _verified(rows: DataFrame, verify: Callable, limit: int = 4 << 20) -> DataFrame:
    """(a, b): links in each block. rows: sorted by key, i, j: (key, i, j, role, rep, component, payload)."""

    def work(batches):
        import pyarrow as pa

        common.claim("buckets")

        held: list[tuple] = []
        size, last = 0, None

        def out():
            found = [(np.zeros(0, np.int64),) * 2]
            ends = [0, *(k for k in range(1, len(held)) if held[k][0] != held[k - 1][0]), len(held)]
            groups = [held[s:e] for s, e in zip(ends, ends[1:]) if e - s > 1]
            for g, (p, q) in zip(groups, verify([([r[1] & 1 > 0 for r in g], [r[1] & 2 > 0 for r in g], [r[4] for r in g]) for g in groups])):
                ids, parts = np.array([r[2] for r in g], np.int64), np.array([r[3] for r in g], np.int64)
                some = parts[p] != parts[q]
                p, q = p[some], q[some]
                keep = _forest(parts[p], parts[q])
                found.append((ids[p[keep]], ids[q[keep]]))
            a, b = (np.concatenate(x) for x in zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            roles, reps, comps = (batch.column(c).to_pylist() for c in (3, 4, 5))
            loads = batch.column(6).to_pylist()
            for row in zip(keys, roles, reps, comps, loads):
                if size > limit and row[0] != last:
                    yield out()
                    held, size = [], 0
                held.append(row)
                last = row[0]
                size += len(row[4] or b"")
        if held:
            yield out()

    return rows.mapInArrow(work, "a long, b long")


def components_of(keyed: DataFrame, payload: DataFrame, verify: Callable, bytes_of_n: int = 8, big: int = 4096, block: int = 1024, weight: int = 1 << 20, rounds: int = 4) -> DataFrame | None:
    """(id, component) of linked items; None if no two are linked.

    keyed: a written table as :func:`distinct_buckets` gives it. payload: (rep, payload binary), one row an item.
    verify: for a list of blocks (left flags, right flags, payloads) the links between left and right items of each, as two
    arrays of places. block, weight: the most items and about the most weight of a block's side. bytes_of_n: payload
    bytes of one unit of weight, about.
    """
    n_keyed, most = keyed.agg(F.count("*"), F.max("m")).first()
    links = comp = None
    rows = keyed
    for turn in range(rounds + 1 if n_keyed else 0):
        if comp is not None:
            rows = rows.join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        else:
            rows = rows.withColumn("component", F.col("rep"))
        if turn or most > big:
            # A bucket's main component: the one with most items. Buckets of one component leave the search.
            parts = rows.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("cw"))
            parts = parts.groupBy("key").agg(F.max(F.struct("c", "component", "cw")).alias("x"), F.count("*").alias("parts")).where("parts > 1")
            parts = parts.select("key", F.col("x.component").alias("main"), F.col("x.c").alias("in_main"), F.col("x.cw").alias("main_w"))
            rows = common.written(rows.join(parts, "key"), "buckets-open")
            if rows.isEmpty():
                break
        else:
            rows = rows.withColumn("main", F.lit(None).cast("long")).withColumn("in_main", F.lit(0).cast("long")).withColumn("main_w", F.lit(0).cast("long"))
        last = turn == rounds
        whole = F.lit(True) if last else F.col("m") <= big
        if turn or most > big:
            # Centres of each big bucket: the least ids under other hashes in each turn.
            heads = [F.min(F.struct(F.xxhash64("rep", F.lit(3 * turn + i)), "rep")) for i in range(3)]
            centres = rows.where(~whole).groupBy("key").agg(F.array(*heads).alias("h")).select("key", F.explode(F.array_distinct(F.transform("h", lambda h: h.rep))).alias("rep")).withColumn("centre", F.lit(True))
            rows = rows.join(centres, ["key", "rep"], "left")
        else:
            rows = rows.withColumn("centre", F.lit(None).cast("boolean"))
        is_left = F.when(whole, F.col("main").isNull() | (F.col("component") != F.col("main"))).otherwise(F.coalesce("centre", F.lit(False)))
        pieces = lambda count, w: F.ceil(F.greatest(count / block, w / weight, F.lit(1.0))).cast("int")
        rights = pieces(F.col("m"), F.col("w"))
        lefts = F.when(whole, pieces(F.col("m") - F.col("in_main"), F.col("w") - F.col("main_w"))).otherwise(1)
        own = lambda of, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), of).cast("int")
        cell = lambda i, j, role: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), role.cast("int").alias("role"))
        right = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: cell(i, own(F.col("rights"), 11), F.lit(2)))
        left = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda j: cell(own(F.col("lefts"), 12), j, F.lit(1)))
        one = F.array(cell(F.lit(0), F.lit(0), F.when(F.col("is_left"), 3).otherwise(2)))
        cells = F.when((F.col("lefts") == 1) & (F.col("rights") == 1), one).when(F.col("is_left"), F.concat(right, left)).otherwise(right)
        dealt = rows.withColumn("is_left", is_left).withColumn("lefts", lefts).withColumn("rights", rights).select("key", "rep", "n", "component", F.explode(cells).alias("cell")).select("key", "cell.i", "cell.j", "cell.role", "rep", "n", "component")
        dealt = common.written(dealt, "buckets-dealt")
        total, items = dealt.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_distinct("rep")).first()
        ids = common.broadcast_if_small(dealt.select("rep").distinct(), items, 1_000_000)
        loads = payload.join(ids, "rep", "left_semi")
        n_parts = common.pieces(dealt, 32 << 20, int(total) * bytes_of_n)
        blocks = dealt.drop("n").join(loads, "rep").repartition(n_parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "rep").select("key", "i", "j", "role", "rep", "component", "payload")
        found = _verified(blocks, verify)
        links = common.written(found if links is None else links.unionByName(found), "buckets-links")
        if not links.isEmpty():
            comp = common.written(common.components(links), "buckets-components")
        if last or most <= big:
            break
        rows = keyed.where(F.col("m") > big)
    return comp

