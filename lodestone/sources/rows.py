"""Rows as text, as protocol replies or to a callback; lines of comma-separated values as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_text(df: DataFrame) -> DataFrame:
    """One ``value`` a row: cells joined by commas, texts in single quotes with quotes inside doubled, nothing for null."""
    cells = [F.coalesce(F.concat(F.lit("'"), F.replace(F.col(f"`{c}`"), F.lit("'"), F.lit("''")), F.lit("'")) if k == "string" else F.col(f"`{c}`").cast("string"), F.lit("")) for c, k in df.dtypes]
    return df.select(F.concat_ws(",", *cells).alias("value"))


def header(df: DataFrame) -> str | None:
    """The line of column names, which only a result with rows has."""
    return None if df.isEmpty() else ",".join(df.columns)


def as_replies(df: DataFrame) -> DataFrame:
    """One ``value`` a row in the key/value protocol: whole numbers as ``:n``, other cells by length and text, null as ``$-1``."""
    end = F.lit("\r\n")

    def cell(c: str, kind: str):
        x = F.col(f"`{c}`")
        text = x.cast("string")
        whole = kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal") and kind.endswith(",0)")
        said = F.concat(F.lit(":"), text, end) if whole else F.concat(F.lit("$"), F.octet_length(text).cast("string"), end, text, end)
        return F.when(x.isNull(), F.concat(F.lit("$-1"), end)).otherwise(said)

    return df.select(F.concat(F.lit(f"*{len(df.columns)}"), end, *[cell(c, k) for c, k in df.dtypes]).alias("value"))


def each(df: DataFrame, f: Callable, most: int | None = None) -> int:
    """Calls ``f`` with each row, in order, a partition at a time on the driver; returns the number of calls."""
    n = 0
    for row in (df if most is None else df.limit(most)).toLocalIterator(prefetchPartitions=True):
        f(*row)
        n += 1
    return n


def csv_fields(lines: DataFrame, n: int, column: str = "value") -> DataFrame:
    """``n`` text fields c0, c1, .. of each line; quoted fields may hold commas and doubled quotes, missing ones are null."""
    schema = ", ".join(f"c{i} string" for i in range(n))
    return lines.select(F.from_csv(F.col(column), F.lit(schema), {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}).alias("r")).select("r.*")
