"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut in two halves; each half has a codebook of its own, and a pair of codewords is a cell of the
product grid (Babenko and Lempitsky 2012). Each vector lies in one cell and visits cells in the order of the summed
squared distances of its halves to the codewords (multi-sequence order), as many as the target recall needs;
candidates are verified by the cosine in double precision. The number of visits is calibrated: for a sample of
vectors, partners at exactly the least cosine are drawn at random directions, and the visits are the rank below which
``recall`` of them lie. Either end of a pair may find it, so the pairs' recall is higher. Codebooks and calibration use a bounded, documented sample (``sample`` vectors, those of the
least hashes of their ids); every vector is indexed and every vector is a query.

Copies (equal label and components) become one class first and count by their number. A cell is cut into blocks of
``block`` members and a block's queries come in slices, so neither a common cell nor a common vector makes a large
task; only counts and a spanning forest of each slice's links leave it, never all pairs. A pair found from either side
counts for both ends, once.

Nulls: vectors that are null, empty, zero or have null or non-finite components, and rows with a null label,
link with nothing. Vectors of each length have an index of their own. Ties: the least id is kept. Rows with a null vec_id link with
nothing and are not kept. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def kmeans(x: np.ndarray, k: int, steps: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's algorithm from k rows drawn at random; empty clusters keep their centres."""
    if not x.shape[1]:  # the first half of vectors of one component
        return x[:1].copy()
    rng = np.random.Generator(np.random.PCG64(seed))
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        near = _squares(x, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


class Grid:
    """Two codebooks and the number of cells to visit."""

    def __init__(self, sample: np.ndarray, k: int, least: float, recall: float, seed: int = 5):
        self.half = sample.shape[1] // 2
        self.books = (kmeans(sample[:, : self.half], k, seed=seed), kmeans(sample[:, self.half :], k, seed=seed + 1))
        self.cells = len(self.books[0]) * len(self.books[1])
        self.visits = self.cells
        rng = np.random.Generator(np.random.PCG64(seed + 2))
        x = sample[:2000]
        r = rng.standard_normal(x.shape)
        r -= (r * x).sum(1, keepdims=True) * x
        r /= np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-300)
        y = least * x + math.sqrt(1 - least * least) * r
        cost = self.costs(x)
        own = np.take_along_axis(cost, self.cell(y)[:, None], 1)
        rank = (cost < own).sum(1) + 1
        self.visits = int(min(self.cells, max(1, np.quantile(rank, recall, method="higher"))))

    def costs(self, x: np.ndarray) -> np.ndarray:
        a, b = _squares(x[:, : self.half], self.books[0]), _squares(x[:, self.half :], self.books[1])
        return (a[:, :, None] + b[:, None, :]).reshape(len(x), -1)

    def cell(self, x: np.ndarray) -> np.ndarray:
        a, b = _squares(x[:, : self.half], self.books[0]).argmin(1), _squares(x[:, self.half :], self.books[1]).argmin(1)
        return a * len(self.books[1]) + b

    def visit(self, x: np.ndarray) -> np.ndarray:
        """The numbers of the nearest cells of each row: the first ``visits`` of the multi-sequence."""
        cost = self.costs(x)
        if self.visits >= self.cells:
            return np.broadcast_to(np.arange(self.cells), cost.shape)
        return np.argpartition(cost, self.visits - 1, axis=1)[:, : self.visits]


def unit(vectors: DataFrame) -> DataFrame:
    """Classes of usable vectors: label, x, rep (least id), copies, wire (the components as they came)."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    use = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(True)))
    # -0.0 and 0.0 are one value. Components travel in the type that they came in; workers scale them in double precision.
    kind = dict(vectors.dtypes)["embedding"]
    use = use.where(F.array_max(F.transform("x", F.abs)) > 0).select("vec_id", "label", F.transform("x", lambda v: v + F.lit(0.0)).alias("x"))
    rep = use.groupBy("label", "x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    return rep.select("label", "x", "rep", "copies", F.col("x").cast("array<float>" if kind == "array<float>" else "array<double>").alias("wire"))


def _units(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column) -> np.ndarray:
    import pyarrow as pa

    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)


def _forest(hit: np.ndarray) -> np.ndarray:
    """For each row of a boolean (queries x members) matrix the column that stands for its component in the matrix."""
    rows, cols = np.nonzero(hit)
    n = hit.shape[0]
    mark = np.full(n + hit.shape[1], n + hit.shape[1], np.int64)
    mark[n:] = np.arange(hit.shape[1])
    while True:
        before = mark.copy()
        np.minimum.at(mark, rows, mark[n + cols])
        np.minimum.at(mark, n + cols, mark[rows])
        if (before == mark).all():
            return mark


def links(vectors: DataFrame, least: float = 0.93, recall: float = 0.97, sample: int = 20_000, block: int = 512, slice_rows: int = 4096) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, counts, edges): classes as :func:`unit`; counts (id, n) of links to other classes' vectors; edges (a, b)."""
    spark = vectors.sparkSession
    classes = common.written(unit(vectors), "multiindex-classes")
    lengths = [r.n for r in classes.groupBy(F.size("x").alias("n")).count().orderBy("n").collect()]
    counts, edges = spark.createDataFrame([], "id long, n long"), spark.createDataFrame([], "a long, b long")
    for length in lengths:
        c, e = _links(classes.where(F.size("x") == length), least, recall, sample, block, slice_rows)
        counts, edges = counts.unionByName(c), edges.unionByName(e)
    return classes, counts, edges


def _links(usable: DataFrame, least: float, recall: float, sample: int, block: int, slice_rows: int) -> tuple[DataFrame, DataFrame]:
    """counts and edges of the classes of one length."""
    spark = usable.sparkSession
    n = usable.count()
    some = _units(np.array([r.wire for r in usable.orderBy(F.xxhash64("rep")).limit(sample).select("wire").toLocalIterator()]))
    k = int(min(256, max(2, 2 ** round(math.log2(max(4, math.sqrt(n / 100)))))))
    grid = Grid(some, k, least, recall)
    # Codebooks and visits: at most 2 * 256 * dimension numbers, whatever the input.
    shared = spark.sparkContext.broadcast(grid)

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _units(_matrix(part.column(3)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.cell(x).astype(np.int32)), pa.array(list(np.sort(shared.value.visit(x), 1).astype(np.int32)), pa.list_(pa.int32()))], names=["label", "rep", "copies", "wire", "cell", "visits"])

    placed = usable.select("label", "rep", "copies", "wire").mapInArrow(assign, f"label string, rep long, copies long, wire {dict(usable.dtypes)['wire']}, cell int, visits array<int>")
    placed = common.written(placed, "multiindex-placed")
    sizes = placed.groupBy("label", "cell").count().withColumn("blocks", F.ceil(F.col("count") / block).cast("int")).drop("count")
    # Joined by a broadcast while they are few (cells are, labels need not be), so that a common cell is not dealt to one task.
    sizes = common.written(sizes, "multiindex-sizes")
    sizes = common.broadcast_if_small(sizes, sizes.count())
    members = placed.join(sizes, ["label", "cell"]).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int"))
    # A query goes to each block of each visited cell. Blocks hold about ``block`` members; their queries are dealt to slices.
    asks = placed.select("label", "rep", "copies", "wire", F.col("cell").alias("home"), F.explode("visits").alias("cell")).join(sizes, ["label", "cell"])
    load = asks.groupBy("label", "cell").count().withColumn("slices", F.ceil(F.col("count") / slice_rows).cast("int")).drop("count")
    load = common.written(load, "multiindex-load")
    load = common.broadcast_if_small(load, load.count())
    asks = asks.join(load, ["label", "cell"]).withColumn("slice", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("slices")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # The members of a block are repeated for each slice.
    members = members.join(load, ["label", "cell"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    key = ["label", "cell", "block", "slice"]
    left = asks.select(*key, "rep", "copies", "wire", "home")
    right = members.select(*key, "rep", "copies", "wire").toDF(*key, "rep", "copies", "wire")

    def verify(q, m):
        import pandas as pd

        out = {"kind": [], "a": [], "b": []}

        def put(kind, a, b):
            if len(a):
                out["kind"].append(np.full(len(a), kind, np.int32))
                out["a"].append(np.asarray(a, np.int64))
                out["b"].append(np.asarray(b, np.int64))

        if len(q) and len(m):
            mx, mid, mw = _units(np.stack(m["wire"].to_numpy())), m["rep"].to_numpy(), m["copies"].to_numpy()
            for at in range(0, len(q), 1024):
                part = q.iloc[at : at + 1024]
                qid, qw = part["rep"].to_numpy(), part["copies"].to_numpy()
                hit = _units(np.stack(part["wire"].to_numpy())) @ mx.T >= least
                hit &= qid[:, None] != mid[None, :]
                if not hit.any():
                    continue
                put(0, qid, hit @ mw)
                # A member whose own visits leave out the query's cell does not find this link: it is counted here for both ends.
                linked = np.flatnonzero(hit.any(0))
                seen = np.zeros((len(linked), shared.value.cells), bool)
                np.put_along_axis(seen, shared.value.visit(mx[linked]), True, 1)
                blind = hit[:, linked] & ~seen[:, part["home"].to_numpy()].T
                if blind.any():
                    put(0, mid[linked], qw @ blind)
                mark = _forest(hit)
                ids = np.concatenate((qid, mid))
                use = np.flatnonzero(mark < len(ids))
                root = mid[mark[use]]
                some = ids[use] != root
                put(1, ids[use][some], root[some])
        return pd.DataFrame({k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()})

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(verify, "kind int, a long, b long")
    found = common.written(found.where("kind = 1 or b > 0"), "multiindex-found")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("n"))
    return counts, found.where("kind = 1").select("a", "b").distinct()


def near_duplicates(vectors: DataFrame, least: float = 0.93, **options) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``vectors`` (vec_id, embedding, label)."""
    classes, counts, edges = links(vectors, least, **options)
    comp = common.written(common.components(edges), "multiindex-components")
    rep = classes.select("label", "x", "rep", "copies").join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    rep = rep.select("label", "x", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: v + F.lit(0.0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.when(F.col("vec_id").isNotNull(), x).alias("x"))
    out = rows.join(rep, ["label", "x"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
