"""MinHash near-duplicates with min-max signatures.

For each of ``perms`` permutations of the shingles' hashes both the least and the greatest value are kept (min-max
hashing, Ji et al. 2013): two nearly independent unbiased estimates from one evaluation. ``bands`` bands of ``rows``
values make the buckets. At similarity 0.8 the defaults (32 bands of 6 values, 96 permutations) miss a pair with
probability (1 - 0.8^6)^32 = 6e-5.

Documents with equal sets become one class first, by a plain aggregate. Classes that share a bucket are compared in
blocks (:mod:`.buckets`): a block's texts come together in one task, which builds their full sets again, counts the
intersections of all of them at once and gives back a spanning forest of the links. So each link is confirmed on full
sets, the texts of documents without a partner never move, and no bucket is capped.

Nulls: a text that is null or has no words has an empty set and links with nothing. Null ids are left out of
classes and come back as their own component (null). Repeated ids with equal texts share a class. Ties: the least
doc_id is kept. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import buckets, common

PERMS, ROWS = 96, 6


def _multipliers(perms: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(977))
    return r.integers(1, 2**63, perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, perms, dtype=np.uint64)


def signature_rows(sets: list[np.ndarray], perms: int = PERMS) -> np.ndarray:
    """For each non-empty set 2 * perms values: minima, then maxima, under the permutations x -> (x ^ r) * m of 64-bit words."""
    mult, flip = _multipliers(perms)
    out = np.empty((len(sets), 2 * perms), np.uint64)
    at = np.zeros(len(sets), np.int64)
    np.cumsum([len(g) for g in sets[:-1]], out=at[1:])
    x = np.concatenate(sets)
    h = np.empty_like(x)
    with np.errstate(over="ignore"):
        for j in range(perms):
            np.bitwise_xor(x, flip[j], out=h)
            np.multiply(h, mult[j], out=h)
            out[:, j] = np.minimum.reduceat(h, at)
            out[:, perms + j] = np.maximum.reduceat(h, at)
    return out


def band_keys(sigs: np.ndarray, rows: int) -> np.ndarray:
    """For each signature one 64-bit key a band; the minimum and maximum of a permutation are in different bands."""
    bands = sigs.shape[1] // rows
    x = sigs[:, : bands * rows].reshape(len(sigs), bands, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), x.shape[:2])
        for j in range(rows):
            key = common.mix64(key * np.uint64(31) + x[:, :, j])
    return key.view(np.int64)


def signatures(docs: DataFrame, k: int, perms: int = PERMS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (128-bit fingerprint of the set), bands. Narrow: no shuffle."""

    def work(batches):
        import pyarrow as pa
        import xxhash

        common.claim("neardup")
        for batch in batches:
            ids, texts = batch.column(0), common.utf8(batch.column(1))
            for a, b in common.text_batches(texts, 512 << 10):
                sets = common.shingle_sets(texts[a:b], k)
                some = [g for g in sets if len(g)]
                keys = iter(band_keys(signature_rows(some, perms), rows) if some else ())
                marks = [xxhash.xxh3_128_intdigest(g.tobytes()) for g in sets]
                low, high = ([(m >> s & 0xFFFFFFFFFFFFFFFF) - 2**63 for m in marks] for s in (0, 64))
                lists = pa.array([next(keys) if len(g) else [] for g in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array([len(g) for g in sets], pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), lists], names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows_in.mapInArrow(work, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Sizes of the intersections of every left set with every right set, as the product of their incidence matrices."""
    out = np.zeros((len(left), len(right)), np.float32)
    sizes = [len(s) for s in (*left, *right)]
    row = np.repeat(np.arange(len(sizes)), sizes)
    value, column, times = np.unique(np.concatenate((*left, *right)), return_inverse=True, return_counts=True)
    # A shingle of one set alone is in no intersection.
    some = times[column] > 1
    row, column = row[some], np.cumsum(times > 1)[column[some]] - 1
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        s, e = np.searchsorted(column, (first, first + columns))
        m = np.zeros((len(sizes), min(columns, int(column[-1]) + 1 - first)), np.float32)
        m[row[s:e], column[s:e] - first] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def linked(k: int, percent: int):
    """Verifies blocks of texts: places of left and right items whose sets have 100 * intersection >= percent * union."""

    def verify(blocks):
        texts = list(dict.fromkeys(t for _, _, ts in blocks for t in ts))
        sets: dict[bytes, np.ndarray] = {}
        for a, b in common.text_batches(texts, 512 << 10):
            sets.update(zip(texts[a:b], common.shingle_sets(texts[a:b], k)))
        for is_left, is_right, ts in blocks:
            p, q = np.flatnonzero(is_left), np.flatnonzero(is_right)
            if not len(p) or not len(q):
                yield p[:0], q[:0]
                continue
            x, y = [sets[ts[i]] for i in p], [sets[ts[i]] for i in q]
            both = overlaps(x, y)
            nx, ny = np.array([len(s) for s in x])[:, None], np.array([len(s) for s in y])[None]
            i, j = np.nonzero((100 * both >= percent * (nx + ny - both)) & (both > 0) & (p[:, None] != q[None]))
            yield p[i], q[j]

    return verify


def classes(docs: DataFrame, k: int, percent: int = 80, perms: int = PERMS, rows: int = ROWS, **options) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    sig = common.written(signatures(docs, k, perms, rows), "neardup-signatures")
    same = ["n_shingles", "set_a", "set_b"]
    reps = sig.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep"))
    # The bands of the class's least document, found again by its id, so that the aggregate carries none.
    reps = common.written(reps, "neardup-classes")
    banded = reps.select("rep", *same).join(sig.select(F.col("doc_id").alias("rep"), *same, "bands"), ["rep", *same])
    keyed = banded.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    keyed = buckets.distinct_buckets(common.written(keyed, "neardup-keys"))
    payload = docs.select(F.col("doc_id").cast("long").alias("rep"), F.encode(F.col("text").cast("string"), "utf-8").alias("payload"))
    comp = buckets.components_of(keyed, payload, linked(k, percent), **options)
    members = sig.join(reps, same, "left")
    if comp is not None:
        members = members.join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    else:
        members = members.withColumn("component", F.col("rep"))
    return members.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80, **options) -> DataFrame:
    """``docs`` without near-duplicates: of each component the least doc_id stays, once; columns unchanged. Rows without an id stay."""
    found = common.written(classes(docs, k, percent, **options), "neardup-result").where("doc_id is not null")
    # Ids that go are few against the rows; texts are not shuffled as long as these ids are within the bound.
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("neardup_id")).distinct()
    gone = common.broadcast_if_small(gone, found.where("doc_id <> component_id").count(), 2_000_000)
    rows = docs.select(F.struct("*").alias("neardup_row"), F.col("doc_id").cast("long").alias("neardup_doc"))
    one = rows.join(gone, F.col("neardup_doc") == F.col("neardup_id"), "left_anti")
    twice = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("neardup_id")).agg(F.count("*").alias("n")).where("n > 1").select("neardup_id")
    twice = common.written(twice, "neardup-twice")
    if not twice.isEmpty():  # of rows with one id one stays
        again = one.join(twice, F.col("neardup_doc") == F.col("neardup_id"), "left_semi")
        nth = Window.partitionBy("neardup_doc").orderBy(F.xxhash64("neardup_row.text"))
        again = again.withColumn("nth", F.row_number().over(nth)).where("nth = 1").drop("nth")
        one = one.join(twice, F.col("neardup_doc") == F.col("neardup_id"), "left_anti").unionByName(again)
    return one.select("neardup_row.*")


def op9_minmax_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(docs, 4).withColumn("kept", F.col("doc_id") == F.col("component_id"))
