"""Mixing sources to target weights by systematic sampling.

Each source gets a target: its share, by weight, of ``total`` times all words, but no more than ``most`` times its
own words; what the limit leaves over is shared again by weight. Every document of a source expects
target / source_size copies. Prefix sums of these expectations, in order of size within the source, plus one random
offset for each source, cross integers; a document is taken once for each integer it crosses. In size order
the taken words miss the target by no more than about one longest document.

The prefix sum of a constant is a rank, and the rank comes from counts: documents of smaller sizes in the source,
then of lower buckets of the same size, then the rank in the bucket. So one source, or one size, may hold any share
of the rows. Nulls: a null text has size 0; a null source is a source of its own, the last. Ties and repeated rows
are ranked by doc_id. Extra columns pass through :func:`mix`. Same input and seed give the same mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size). One row for each source.

    The final sharing is a water level: sources in order of limit / weight reach their limits first, so one running
    sum finds the level at which the rest share what is left.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    s = s.withColumn("level", F.col("limit") / F.col("weight"))
    order = Window.orderBy("level", "source_size", F.col("source").asc_nulls_last())
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("want", F.sum("source_size").over(all_rows) * F.lit(float(total)))
    s = s.withColumn("left", F.col("want") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The first source in this order whose limit is above its share of what is left sets the level for it and all after.
    s = s.withColumn("share", F.when(F.col("level") >= F.col("left") / F.col("open"), F.col("left") / F.col("open")))
    first = F.min(F.when(F.col("share").isNotNull(), F.struct("level", "source_size", F.col("source").isNull().alias("none"), "source", "share"))).over(all_rows)
    return s.withColumn("water", first["share"]).select("source", "source_size", F.when(F.col("water").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("water") * F.col("weight"))).alias("target"))


def copies(sizes: DataFrame, seed: int = 20_240, weights: tuple[float, ...] = (5, 2, 1), total: float = 1.5, most: float = 2.0, bucket_rows: int = 5_000) -> DataFrame:
    """Adds source_size, target and copies to (doc_id, source, size, ...). ``sizes`` should be a written table."""
    buckets = max(1, -(-sizes.count() // bucket_rows))
    keyed = sizes.withColumn("none", F.col("source").isNull()).withColumn("key", F.coalesce("source", F.lit(""))).withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(buckets)))
    by = ["none", "key"]
    cells = keyed.groupBy(*by, "size", "bucket").count()
    by_size = cells.groupBy(*by, "size").agg(F.sum("count").alias("n"))
    # Distinct sizes of a source: bounded by the longest document, not by the rows.
    by_size = by_size.withColumn("smaller", F.sum("n").over(Window.partitionBy(*by).orderBy("size")) - F.col("n")).drop("n")
    cells = cells.withColumn("lower", F.sum("count").over(Window.partitionBy(*by, "size").orderBy("bucket")) - F.col("count")).drop("count")
    totals = keyed.groupBy(*by).agg(F.sum("size").alias("source_size"))
    goal = targets(totals.select(F.when(~F.col("none"), F.col("key")).alias("source"), "source_size"), weights, total, most)
    goal = goal.select(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("key"), "source_size", "target")
    before = cells.join(by_size, [*by, "size"]).select(*by, "size", "bucket", (F.col("smaller") + F.col("lower")).alias("before"))
    before = before.join(goal, by)
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "size", "bucket").orderBy("doc_id")))
    out = ranked.join(before, [*by, "size", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64("key", "none", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    crossed = lambda r: F.floor(offset + rate * r)
    return out.withColumn("copies", (crossed(F.col("rank")) - crossed(F.col("rank") - 1)).cast("long")).drop("none", "key", "bucket", "rank", "before")


def mix(docs: DataFrame, seed: int = 20_240, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, columns unchanged.

    Decisions are made on (doc_id, source, size) and joined back. Rows that share a doc_id are told apart by a hash
    of their text, so each keeps its own decision; rows equal in both are taken alike and the rank spreads over them.
    """
    key = [F.col("doc_id").cast("long").alias("mix_id"), F.xxhash64("text", "source").alias("mix_hash")]
    sizes = docs.select(*key, F.col("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = common.written(sizes.withColumnRenamed("mix_id", "doc_id"), "mixing-sizes")
    dealt = copies(sizes, seed, **options).where("copies > 0").select(F.col("doc_id").alias("mix_id"), "mix_hash", F.col("copies").alias("mix_copies"))
    rows = docs.select(F.struct("*").alias("mix_row"), *key)
    same = F.col("l.mix_id").eqNullSafe(F.col("r.mix_id")) & (F.col("l.mix_hash") == F.col("r.mix_hash"))
    if not sizes.groupBy("doc_id", "mix_hash").count().where("count > 1").isEmpty():
        # Repeated rows: the n-th of them in the table takes the n-th number of copies.
        by = Window.partitionBy("mix_id", "mix_hash")
        rows = rows.withColumn("mix_nth", F.row_number().over(by.orderBy("mix_hash")))
        dealt = dealt.withColumn("mix_nth", F.row_number().over(by.orderBy("mix_copies")))
        same = same & (F.col("l.mix_nth") == F.col("r.mix_nth"))
    joined = rows.alias("l").join(dealt.alias("r"), same).select("l.mix_row", "r.mix_copies")
    return joined.select("mix_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))).select("mix_row.*")


def op7_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    sizes = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    out = copies(common.written(sizes, "mixing-sizes"))
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), (F.col("copies") * F.col("size")).alias("taken"))
