"""Harmonic packing: pieces of documents in sequences of a fixed capacity.

A piece of length l is of class k = capacity // l, so k pieces of the class always fit one sequence. Documents are
cut where that leaves little padding: whole capacities first, then reciprocals capacity // k of it, until the
rest fills its class to 98 % or is short. Classes fill their sequences with exactly k pieces each: a piece's rank
within its class comes from counts of (class, bucket) and its rank in the bucket, so workers fill sequences
independently and any class may hold any share of the rows. The fewer than k pieces that remain of each class are
placed first-fit by decreasing length; their number is bounded by the capacity, not by the input.

Nulls: a null text is the empty text (only the end id). Repeated rows are packed each. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 2048


def cuts(length: int, capacity: int = CAPACITY, fill: float = 0.98, short: int = 64) -> list[int]:
    """Piece lengths, in order, that a document of ``length`` ids is cut into."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if rest >= fill * (capacity // k) or rest <= short:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int, drops_space: bool, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens[, ids]: the pieces of every document, encoded where it is read."""
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids

    def work(batches):
        import pyarrow as pa

        common.claim("tokens")
        enc = tokens.encoder(tokenizer, end_id, drops_space)
        names = [f.split()[0] for f in fields.split(", ")]
        for part, every, bounds in tokens.encoded(batches, enc):
            rows: list[list] = [[] for _ in names]
            every = every.astype("<u4")
            for doc_id, s, e in zip(part.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                raw, at = memoryview(every[s:e]).cast("B"), 0
                for n in cuts(e - s, capacity):
                    piece = raw[4 * at : 4 * (at + n)]
                    for to, x in zip(rows, (doc_id, at, n, zlib.crc32(piece), e - s, bytes(piece) if with_ids else None)):
                        to.append(x)
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, rows)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, fields)


def place(parts: DataFrame, capacity: int = CAPACITY, bucket_rows: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ids_crc32, ...). ``parts`` should be a written table."""
    n = parts.count()
    buckets = max(1, -(-n // bucket_rows))
    parts = parts.withColumn("class", F.expr(f"cast({capacity} div length as int)")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = parts.groupBy("class", "bucket").count()
    # (class, bucket) pairs: about n / bucket_rows of each of at most 2 * sqrt(capacity) classes, well below the rows.
    prior = counts.withColumn("prior", F.sum("count").over(Window.partitionBy("class").orderBy("bucket")) - F.col("count")).drop("count")
    totals = counts.groupBy("class").agg(F.sum("count").alias("in_class"))
    totals = totals.withColumn("full", F.expr("in_class div class"))
    # One row for each class, at most ``capacity`` of them, in one window.
    totals = totals.withColumn("base", F.sum("full").over(Window.orderBy("class")) - F.col("full"))
    known = prior.join(F.broadcast(totals), "class")
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1)
    ranked = ranked.join(known, ["class", "bucket"]).withColumn("rank", F.col("rank") + F.col("prior"))
    ranked = common.written(ranked.withColumn("sequence_id", F.when(F.col("rank") < F.col("full") * F.col("class"), F.col("base") + F.expr("rank div class"))).drop("prior", "in_class", "base", "bucket"), "packing-ranked")
    whole = ranked.where("sequence_id is not null")
    rest = ranked.where("sequence_id is null").drop("sequence_id")
    base = totals.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]
    # At most (class - 1) pieces of each class: bounded by the capacity at any size of input.
    fitted = rest.select("class", "rank", "length").groupBy().applyInPandas(lambda df: _first_fit(df, capacity), "class int, rank long, bin long")
    rest = rest.join(F.broadcast(fitted), ["class", "rank"]).withColumn("sequence_id", F.lit(base) + F.col("bin")).drop("bin")
    every = whole.unionByName(rest)
    inside = Window.partitionBy("sequence_id").orderBy("class", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return every.withColumn("offset", F.sum("length").over(inside) - F.col("length")).drop("class", "rank", "full")


def _first_fit(df, capacity: int):
    """Places each length, longest first, in the first bin with room; a tree of the bins' room finds it."""
    df = df.sort_values(["length", "class", "rank"], ascending=[False, True, True])
    size = 1
    while size < max(1, len(df)):
        size *= 2
    room = [capacity] * (2 * size)
    bins = []
    for n in df["length"]:
        i = 1
        while i < size:
            i *= 2
            if room[i] < n:
                i += 1
        room[i] -= n
        bins.append(i - size)
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
    return df.assign(bin=bins)[["class", "rank", "bin"]]


def pack(docs: DataFrame, tokenizer: str, end_id: int, drops_space: bool, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all ``docs`` with their places. With ``with_ids``, also each piece's ids as little-endian u32 bytes."""
    return place(common.written(pieces(docs, tokenizer, end_id, drops_space, capacity, with_ids), "packing-pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids: the packed sequences themselves, from pieces that hold ids. A group holds at most ``capacity`` ids."""
    in_order = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_join(F.transform(in_order, lambda x: F.hex(x.ids)), "").alias("h")).select("sequence_id", "length", F.unhex("h").alias("ids"))


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = pack(docs, tokens.tokenizer_path("word_bpe_49k.json"), 1, True)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
