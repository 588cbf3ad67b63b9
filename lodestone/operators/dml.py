"""Data changes as plans: each takes and gives DataFrames, so a change is whole or not made."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import to_sql


class ConstraintError(ValueError):
    pass


def literal_rows(spark: SparkSession, rows: list[list[str]], columns: list[str], types: dict[str, str], pk: str, df: DataFrame, documents: set[str], calls=None) -> DataFrame:
    """Parsed VALUES rows with the table's types; an empty primary key counts on from the largest one. calls: gives the value of
    a function call among them."""
    parsed, top, given = [], None, 0
    for r in rows:
        row = dict.fromkeys(types)
        for c, v in zip(columns, r):
            v = v.strip()
            if v == "":
                continue
            if calls and re.match(r"[A-Za-z_]\w*\(.*\)$", v, re.S):
                v = calls(v)
                row[c] = None if v is None else Decimal(v) if types[c].startswith("decimal") else int(v) if types[c] in ("int", "bigint") else float(v) if types[c] in ("float", "double") else str(v)
            elif v.startswith("{"):
                row[c] = v.replace("'", '"')
            elif v.startswith("'") and types[c] == "string":
                row[c] = v[1:-1].replace("''", "'")
            elif v.startswith("'") and not (v := v[1:-1].strip()):
                continue  # an empty text is no number
            elif types[c].startswith("struct"):
                hi, _, lo = v.rpartition("|")
                row[c] = (Decimal(hi or 0), Decimal(lo))
            elif types[c] != "string" and not re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", v):
                raise ConstraintError(f"{v} is no value for {c}")
            elif types[c] in ("int", "bigint"):
                row[c] = int(float(v)) if re.search(r"[.eE]", v) else int(v)
                if not 0 <= row[c] < 2**32:
                    raise ConstraintError(f"{c} is out of range")
            elif types[c].startswith("decimal"):
                row[c] = Decimal(v)
                if not 0 <= row[c] < 2**64:
                    raise ConstraintError(f"{c} is out of range")
            else:
                row[c] = float(v) if types[c] in ("float", "double") else v
        if row[pk] is None:
            if top is None:
                top = df.agg(F.max(pk)).first()[0] or 0
            top = max(top, given) + 1
            row[pk] = top
        elif isinstance(row[pk], (int, Decimal)):
            given = max(given, row[pk])
        parsed.append(tuple(row[c] for c in types))
    return spark.createDataFrame(parsed, ", ".join(f"`{c}` {k}" for c, k in types.items()))


def check_unique(df: DataFrame, index) -> None:
    twice = df.groupBy(*index.columns).count().where("count > 1")
    for c in index.columns:
        twice = twice.where(F.col(c).isNotNull())
    if not twice.isEmpty():
        raise ConstraintError(f"{index.name} is unique")


def insert(df: DataFrame, new: DataFrame, pk: str) -> DataFrame:
    if not new.groupBy(pk).count().where("count > 1").isEmpty() or not new.join(df.select(pk), pk, "left_semi").isEmpty():
        raise ConstraintError("the primary key exists")
    return df.unionByName(new, allowMissingColumns=True)


def replace(df: DataFrame, new: DataFrame, pk: str) -> DataFrame:
    """Whole rows of ``new`` instead of those with their keys."""
    return df.join(new.select(pk), pk, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(df: DataFrame, new: DataFrame, pk: str, sets: dict[str, str]) -> DataFrame:
    """New keys are added; rows whose key exists get ``sets``. One pass over each side."""
    keys = new.select(pk).distinct().withColumn("dml_hit", F.lit(True))
    changed = df.join(keys, pk, "left").select(*[F.when(F.col("dml_hit"), F.expr(sets[c])).otherwise(F.col(c)).cast(k).alias(c) if c in sets else F.col(c) for c, k in df.dtypes])
    return changed.unionByName(new.join(df.select(pk), pk, "left_anti"), allowMissingColumns=True)


def update(df: DataFrame, hit: DataFrame, pk: str, sets: dict[str, str]) -> tuple[DataFrame, int]:
    keys = hit.select(F.col(pk).alias("dml_key")).distinct()
    n = keys.count()
    marked = df.join(keys, F.col(pk) == F.col("dml_key"), "left")
    return marked.select(*[F.when(F.col("dml_key").isNotNull(), F.expr(sets[c])).otherwise(F.col(c)).cast(k).alias(c) if c in sets else F.col(c) for c, k in df.dtypes]), n


def update_where(df: DataFrame, condition, sets: dict[str, str]) -> DataFrame:
    """As :func:`update` for rows that a condition without nulls picks: no join and no shuffle."""
    return df.select(*[F.when(condition, F.expr(sets[c])).otherwise(F.col(c)).cast(k).alias(c) if c in sets else F.col(c) for c, k in df.dtypes])


def delete(df: DataFrame, hit: DataFrame, pk: str) -> DataFrame:
    return df.join(hit.select(pk), pk, "left_anti")


def first_of(df: DataFrame, order: list, n: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(n)


def guarded(column: str, text: str, kind: str, docs: dict[str, str], macros: dict | None = None) -> str:
    """SET c = e as SQL. ``c = c OP number`` on unsigned integers truncates and fails below zero or above the type."""
    m = re.fullmatch(rf"{column}\s*([-+*/%^])\s*([\d.]+)", text)
    whole = kind == "bigint" or kind.startswith("decimal")
    if not m or not whole:
        return to_sql(text, docs, None, macros)
    op, value = m[1], m[2]
    if op in "+-":
        value = str(int(float(value)))
    e = {"^": f"power({column}, {value})", "%": f"pmod({column}, {value})", "/": f"floor({column} / {value})"}.get(op, f"{column} {op} {value}")
    top = 2**32 - 1 if kind == "bigint" else 2**64 - 1
    e = f"cast(floor({e}) as decimal(38,0))"
    return f"case when {e} < 0 or {e} >= {top} then raise_error('{column}: out of range') else {e} end"


def json_set(column: str, path: str, value: str) -> str:
    """SQL that sets ``path`` in a JSON text: objects on the way are rebuilt from their entries."""
    head, _, rest = path.partition(".")
    old = f"coalesce(from_json({column}, 'map<string,string>'), map())"
    inner = json_set(f"coalesce(get_json_object({column}, '$.{head}'), '{{}}')", rest, value) if rest else f"to_json(struct({value} as v))"
    # Every value is kept as JSON text: strings are quoted, numbers, objects and lists are not.
    raw = inner if rest else f"regexp_extract({inner}, '^.\"v\":(.*).$', 1)"
    entries = f"transform(map_entries(map_filter({old}, (k, v) -> k != '{head}')), e -> concat('\"', e.key, '\":', case when try_cast(e.value as double) is not null or left(e.value, 1) in ('{{', '[') or e.value in ('true', 'false') then e.value else concat('\"', e.value, '\"') end))"
    return f"concat('{{', array_join(array_append({entries}, concat('\"{head}\":', {raw})), ','), '}}')"


def latest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of each key the row with the greatest ``order``: an upsert log made a table."""
    return df.withColumn("dml_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("dml_n = 1").drop("dml_n")
