"""Ranks over whole tables without bringing a table to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import session


def with_rank(df: DataFrame, order: list, name: str, first: int = 1) -> DataFrame:
    """``df`` with each row's place in ``order``, counted from ``first``.

    Rows are dealt by ranges and sorted within them into a table in the shared folder; the count of each range (one row a
    partition) then gives every range its first place. Equal rows of the order get places next to each other.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The alias of a joined or filtered row is lost in a table: columns keep their places, not their names.
    plain = df.select(*order, F.struct("*").alias("ranked_row")).toDF(*[f"ranked_{i}" for i in range(len(order))], "ranked_row")
    keys = [f"ranked_{i}" for i in range(len(order))]
    path = session.scratch(spark, "ranks")
    plain.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("ranked_row", F.monotonically_increasing_id().alias("ranked_at")).write.parquet(path)
    rows = spark.read.parquet(path)
    part = F.shiftright("ranked_at", 33)
    counts = sorted((r.part, r["count"]) for r in rows.groupBy(part.alias("part")).count().collect())
    before, starts = first, {}
    for p, n in counts:
        starts[p] = before
        before += n
    start = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in starts.items() for x in kv]), part) if starts else F.lit(0)
    return rows.select("ranked_row.*", (start + F.col("ranked_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))
