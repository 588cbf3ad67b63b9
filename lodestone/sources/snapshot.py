"""Snapshots, dumps and statement logs of an engine's tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F


def save(engine, path: str) -> None:
    """All tables as Parquet with one line of definitions for each; a later save of the same path replaces it."""
    meta = []
    for t in engine.tables.values():
        t.df.write.mode("overwrite").parquet(f"{path}/{t.name}")
        meta.append((json.dumps({"name": t.name, "types": t.types, "documents": sorted(t.documents), "dynamic": t.dynamic, "hidden": sorted(t.hidden), "indexes": [[i.name, list(i.columns), i.unique, i.order_by] for i in t.indexes.values()]}),))
    engine.spark.createDataFrame(meta, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_definitions")


def load(engine, path: str) -> None:
    from ..plans.engine import Index, Table

    for r in engine.spark.read.text(f"{path}/_definitions").collect():
        m = json.loads(r.value)
        df = engine.spark.read.parquet(f"{path}/{m['name']}")
        t = Table(m["name"], m["types"], df, documents=set(m["documents"]), dynamic=m["dynamic"], hidden=set(m["hidden"]))
        t.indexes = {n: Index(n, tuple(c), u, o) for n, c, u, o in m["indexes"]}
        engine.tables[m["name"].lower()] = t


def script(table, name: str):
    """INSERT statements, one a row, as a DataFrame of text; write it with ``.write.text``."""
    cells = [F.when(F.col(c).isNull(), F.lit("NULL")).otherwise(F.concat(F.lit("'"), F.replace(F.col(c), F.lit("'"), F.lit("''")), F.lit("'")) if k == "string" else F.col(c).cast("string")) for c, k in table.df.dtypes if c in table.columns]
    return table.df.select(F.concat(F.lit(f"INSERT INTO `{name}` VALUES ("), F.concat_ws(",", *cells), F.lit(");")).alias("value"))


def replay(engine, statements: list[str]) -> None:
    """Runs a statement log again."""
    for s in statements:
        engine.sql(s)


def definitions(engine) -> list[str]:
    """The statements that make the tables and indexes again, empty."""
    kinds = {"bigint": "INT", "int": "INT", "decimal(20,0)": "LONG", "float": "FLOAT", "double": "FLOAT", "string": "TEXT"}
    out = []
    for t in engine.tables.values():
        parts = [f"{c} {'LUATABLE' if c in t.documents else 'U128' if t.types[c].startswith('struct') else kinds.get(t.types[c], 'TEXT')}" for c in t.columns]
        out.append(f"CREATE TABLE {t.name} ({', '.join(parts)})")
        out += [f"CREATE {'UNIQUE ' * i.unique}INDEX {i.name} ON {t.name} ({', '.join(i.columns)}){f' ORDER BY {i.order_by}' if i.order_by else ''}" for i in t.indexes.values() if not set(i.columns) & t.hidden]
    return out


def rewrite_log(engine, path: str) -> None:
    """The least log that makes the present tables: definitions, then one INSERT a row, as text below ``path``.

    Rows stay in Spark; only the definitions, one for each table and index, come from the driver. The engine's own log starts anew.
    """
    spark = engine.spark
    heads = definitions(engine)
    spark.createDataFrame([(i, s) for i, s in enumerate(heads)], "n long, value string").orderBy("n").select("value").coalesce(1).write.mode("overwrite").text(f"{path}/definitions")
    for t in engine.tables.values():
        script(t, t.name).write.mode("overwrite").text(f"{path}/rows/{t.name}")
    engine.log.clear()


def read_rewritten(engine, path: str) -> None:
    """Runs a rewritten log: definitions on the driver, rows as one plan for each table."""
    replay(engine, [r.value for r in engine.spark.read.text(f"{path}/definitions").collect()])
    for t in engine.tables.values():
        rows = engine.spark.read.text(f"{path}/rows/{t.name}", wholetext=False)
        inner = F.regexp_extract("value", r"(?s)VALUES \((.*)\);$", 1)
        # Cells: quoted texts with doubled quotes, or bare numbers and NULL.
        cells = F.regexp_extract_all(inner, F.lit(r"('(?:[^']|'')*'|[^,]+)"), F.lit(1))
        cell = lambda i: F.get(cells, F.lit(i))  # noqa: E731, B023
        plain = [F.when(cell(i) == "NULL", None).when(cell(i).startswith("'"), F.replace(F.substring(cell(i), F.lit(2), F.length(cell(i)) - 2), F.lit("''"), F.lit("'"))).otherwise(cell(i)).cast(t.types[c]).alias(c) for i, c in enumerate(t.columns)]
        t.df = rows.select(*plain)


def append_log(engine, path: str) -> int:
    """Moves the engine's statements to the log below ``path``, after those there; returns how many."""
    spark = engine.spark
    before = 0 if not _exists(spark, path) else spark.read.parquet(path).count()
    rows = [(before + i, s) for i, s in enumerate(engine.log)]
    if rows:
        spark.createDataFrame(rows, "n long, statement string").coalesce(1).write.mode("append").parquet(path)
    engine.log.clear()
    return len(rows)


def read_log(spark, path: str) -> list[str]:
    return [r.statement for r in spark.read.parquet(path).orderBy("n").toLocalIterator()]


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
