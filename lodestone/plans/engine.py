"""The SQL dialect: statements are parsed on the driver and become DataFrame plans.

Deliberate departures from loose behaviour: TEXT compares in full; LIMIT 0 gives no row; ordered DELETE removes the first
rows of the order; ties are ordered by the primary key; null never matches; ORDER BY takes any type.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import columns_of, read_functions, split
from ..functions.expressions import to_sql as _to_sql
from ..operators import dml, ordering

#: Type names match by prefix. INT is unsigned 32 bits, LONG unsigned 64 bits, all floats are 4 bytes.
_TYPES = (("INT", "bigint"), ("BIGINT", "decimal(20,0)"), ("LONG", "decimal(20,0)"), ("U128", "struct<hi:decimal(20,0),lo:decimal(20,0)>"), ("FLOAT", "float"), ("REAL", "float"), ("DOUBLE", "float"), ("CHAR", "string"), ("TEXT", "string"), ("BLOB", "string"), ("BYTE", "string"), ("BINARY", "string"), ("LUATABLE", "string"), ("DOCUMENT", "string"))
_NAME = r"[A-Za-z_][\w]*"
_SUBQUERY = re.compile(r"(.+?)\s+IN\s*\(\s*((?:SELECT|SCAN)\b.*)\)\s*$", re.I | re.S)


class DialectError(ValueError):
    pass


@dataclass
class Index:
    name: str
    columns: tuple[str, ...]
    unique: bool = False
    order_by: str | None = None


@dataclass
class Table:
    name: str
    types: dict[str, str]  # column -> declared type; the first is the primary key
    df: DataFrame
    indexes: dict[str, Index] = field(default_factory=dict)
    documents: set[str] = field(default_factory=set)
    triggers: dict[str, tuple[str, Callable]] = field(default_factory=dict)
    dynamic: bool = False
    hidden: set[str] = field(default_factory=set)
    dirty: bool = False

    @property
    def pk(self) -> str:
        return next(iter(self.types))

    @property
    def columns(self) -> list[str]:
        return [c for c in self.types if c not in self.hidden]


class Engine:
    """Tables, prepared statements, cursors and functions of one session. ``strict`` asks for an indexed condition."""

    def __init__(self, spark: SparkSession, strict: bool = False, checkpoint_every: int = 50):
        self.spark, self.strict, self.every = spark, strict, checkpoint_every
        self.tables: dict[str, Table] = {}
        self.prepared: dict[str, str] = {}
        self.cursors: dict[str, int] = {}
        self.functions: dict[str, Callable] = {}
        self.macros: dict[str, tuple[list[str], str]] = {}
        self.function_indexes: dict[str, tuple[str, DataFrame]] = {}  # name -> table, rows (value, pk)
        self.log: list[str] = []
        self.changes = 0

    # -- catalogue ------------------------------------------------------------------------------------------

    def register(self, name: str, df: DataFrame, documents: tuple[str, ...] = (), indexes: tuple[tuple[str, ...], ...] = ()) -> Table:
        """An existing DataFrame as a table; its first column is the primary key."""
        t = Table(name, dict(df.dtypes), df, documents=set(documents))
        for i, cols in enumerate(indexes):
            t.indexes[f"{name}_{i}"] = Index(f"{name}_{i}", tuple(cols))
        self.tables[name.lower()] = t
        return t

    def table(self, name: str) -> Table:
        try:
            return self.tables[name.lower()]
        except KeyError:
            raise DialectError(f"no table {name}") from None

    def function(self, name: str, f: Callable, returns: str = "double") -> None:
        """Registers a Python function (a pandas UDF's body or a plain one) for use in any expression."""
        self.functions[name] = f
        self.spark.udf.register(name, f if hasattr(f, "evalType") else F.udf(f, returns))

    def call(self, name: str, *args):
        return self.functions[name](*args)

    def _expr(self, text: str, docs: dict[str, str] | None = None, bare: dict[str, str] | None = None) -> str:
        return _to_sql(text, docs, bare, self.macros)

    def _interpret(self, text: str) -> list[str]:
        """INTERPRET LUA 'function f(a) return .. end' or INTERPRET LUAFILE path: functions as expressions, without Python."""
        m = re.match(r"INTERPRET\s+(LUA|LUAFILE)\s+(.*)$", text, re.I | re.S)
        if not m:
            raise DialectError("INTERPRET LUA source or LUAFILE path")
        source = m[2].strip()
        if m[1].upper() == "LUAFILE":
            source = "\n".join(r.value for r in self.spark.read.option("wholetext", True).text(source.strip("'")).collect())
        elif source[0] in "'\"":
            source = source[1:-1].replace("''", "'") if source[0] == "'" else source[1:-1]
        new = read_functions(source)
        self.macros |= new
        return list(new)

    def _luafunc(self, text: str):
        """LUAFUNC f a b: one call. Digits are numbers, quoted or other words texts; a Python function may give rows (a list)."""
        _, name, *args = re.findall(r"'(?:[^'\\]|\\.|'')*'|\S+", text)
        if name in self.macros:
            args = [a if a[0] == "'" or re.fullmatch(r"-?\d+(\.\d+)?", a) else f"'{a}'" for a in args]
            return self._value(f"{name}({', '.join(args)})")
        if name not in self.functions:
            raise DialectError(f"no function {name}")
        return self.functions[name](*(_argument(a) for a in args))

    def _value(self, text: str):
        """The value of an expression without columns."""
        m = re.match(rf"({_NAME})\((.*)\)$", text, re.S)
        if m and m[1] in self.functions and m[1] not in self.macros:
            return self.functions[m[1]](*(_argument(a) for a in split(m[2]) if a))
        return self.spark.range(1).select(F.expr(self._expr(text))).first()[0]

    def _message(self, text: str) -> None:
        """MESSAGE statement: runs it and gives no reply."""
        self.sql(text.split(None, 1)[1])

    def function_index(self, name: str, table: str, rows: DataFrame) -> None:
        """An index kept by code: rows (value, pk) that ``name() = value`` in a condition on ``table`` finds."""
        self.table(table)
        self.function_indexes[name] = (table.lower(), rows.select("value", "pk"))

    def set_index(self, name: str, value, pk) -> None:
        t, rows = self.function_indexes[name]
        new = self.spark.createDataFrame([(value, pk)], rows.schema)
        self.function_indexes[name] = (t, self._unset(rows, value, pk).unionByName(new))

    def delete_index(self, name: str, value, pk) -> None:
        t, rows = self.function_indexes[name]
        self.function_indexes[name] = (t, self._unset(rows, value, pk))

    def update_index(self, name: str, old, new, pk) -> None:
        self.delete_index(name, old, pk)
        self.set_index(name, new, pk)

    @staticmethod
    def _unset(rows: DataFrame, value, pk) -> DataFrame:
        return rows.where(~((F.col("value") == value) & (F.col("pk") == pk)))

    def extremes(self, table: str, column: str | None = None) -> DataFrame:
        """Least and greatest key of a table, or value of a column."""
        t = self.table(table)
        c = column or t.pk
        return t.df.agg(F.min(c).alias("least"), F.max(c).alias("greatest"))

    # -- statements -----------------------------------------------------------------------------------------

    def sql(self, text: str):
        # White space between words counts as one blank; in literals it stays.
        text = re.sub(r"('(?:[^'\\]|\\.|'')*')|\s+", lambda m: m[1] or " ", text.strip()).rstrip("; ").strip()
        verb = text.split(None, 1)[0].upper()
        run = getattr(self, "_" + verb.lower(), None)
        if run is None or verb not in _VERBS:
            raise DialectError(f"unknown statement {verb}")
        if verb in _LOGGED:
            self.log.append(text)
        return run(text)

    def _select(self, text: str, scan: bool = False) -> DataFrame:
        q = _parse_select(text)
        if not scan and not q.where:
            raise DialectError("SELECT needs WHERE; SCAN does not")
        froms = [_from(x) for x in split(q.tables)]
        counted = q.columns.replace(" ", "").upper() == "COUNT(*)"
        if q.order and counted:
            raise DialectError("COUNT(*) takes no ORDER BY")
        bare: dict[str, str] = {}
        if len(froms) == 1:
            t = self.table(froms[0][0])
            docs = {c: c for c in t.documents} | {f"{a}.{c}": c for a in froms[0] for c in t.documents}
            df = self._filtered(t, t.df.alias(froms[0][1]), q.where, docs, scan)
            names = t.columns
            items = [(c, F.col(c)) for c in names] if q.columns.strip() == "*" else None
            key: list = [F.col(t.pk)]
        else:
            df, docs, key, bare = self._joined(froms, q.where, scan)
            every = [(a, c) for n, a in froms for c in self.table(n).columns]
            items = None
            if q.columns.strip() == "*":
                items = [(self._joined_name(froms, a, c), F.col(f"{a}.{c}")) for a, c in every]
        if counted:
            offset = self._cursor(q.offset, q.limit)
            df = df.offset(offset) if offset else df
            df = df.limit(q.limit) if q.limit is not None else df
            return df.agg(F.count("*").alias("count"))
        if items is None:
            items = []
            for x in split(q.columns):
                if m := re.fullmatch(rf"({_NAME})\.pos\(\)", x):
                    df = ordering.with_rank(df, [self._index(m[1]).columns[0], *key], f"{m[1]}_pos")
                    items.append((f"{m[1]}_pos", F.col(f"{m[1]}_pos").cast("int")))
                elif m := re.fullmatch(rf"({_NAME})\.\*", x):
                    n = next(n for n, a in froms if m[1] in (a, n))
                    items += [(self._joined_name(froms, m[1], c), F.col(f"{m[1]}.{c}")) for c in self.table(n).columns]
                else:
                    simple = re.fullmatch(rf"(?:({_NAME})\.)?({_NAME})", x)
                    name = self._joined_name(froms, simple[1], simple[2]) if simple and simple[1] and len(froms) > 1 else simple[2] if simple and (not simple[1] or simple[1] not in docs) else x.replace(" ", "")
                    items.append((name, F.expr(self._expr(x, docs, bare))))
        order = [F.expr(self._expr(x, docs, bare)).desc() if d else F.expr(self._expr(x, docs, bare)).asc() for x, d in q.order]
        if order:
            df = df.orderBy(*order, *key)
        elif q.limit is not None and len(froms) == 1:
            df = df.orderBy(*key)
        offset = self._cursor(q.offset, q.limit)
        if offset:
            df = df.offset(offset)
        if q.limit is not None:
            df = df.limit(q.limit)
            if q.offset and not q.offset.isdigit() and df.count() < q.limit:
                self.cursors.pop(q.offset, None)  # the end: the next statement starts anew
        return df.select(*[c.alias(n) for n, c in items])

    def _joined_name(self, froms, alias, column) -> str:
        same = sum(column in self.table(n).columns for n, _ in froms)
        return f"{alias}_{column}" if same > 1 else column

    def _scan(self, text: str) -> DataFrame:
        return self._select("SELECT" + text[4:], scan=True)

    def count_true(self, text: str) -> int:
        """A SELECT whose items are all boolean: the number of rows in which they hold."""
        df = self.sql(text)
        cond = F.lit(True)
        for c in df.columns:
            cond = cond & F.col(f"`{c}`")
        return df.where(cond).count()

    def _cursor(self, offset: str | None, limit: int | None) -> int:
        if offset is None:
            return 0
        if offset.isdigit():
            return int(offset)
        at = self.cursors.get(offset, 0)
        self.cursors[offset] = at + (limit or 0)
        return at

    def _index(self, name: str) -> Index:
        for t in self.tables.values():
            if name in t.indexes:
                return t.indexes[name]
        raise DialectError(f"no index {name}")

    def _indexed(self, t: Table, cond: str) -> bool:
        m = re.match(rf"(?:{_NAME}\.)?({_NAME})\s*(=|BETWEEN\b|IN\b)", cond, re.I)
        return bool(m) and (m[1] == t.pk or any(m[1] == i.columns[0] for i in t.indexes.values()))

    def _filtered(self, t: Table, df: DataFrame, where: str, docs: dict[str, str], scan: bool) -> DataFrame:
        conds = conjuncts(where)
        if self.strict and not scan and conds and not any(self._indexed(t, c) for c in conds):
            raise DialectError("no condition on an index; use SCAN")
        for c in conds:
            df = self._condition(df, c, docs)
        return df

    def _condition(self, df: DataFrame, c: str, docs: dict[str, str], bare: dict[str, str] | None = None) -> DataFrame:
        if m := re.match(rf"({_NAME})\.pos\(\)\s*(=|BETWEEN)\s*(\d+)(?:\s+AND\s+(\d+))?$", c, re.I):
            by = self._index(m[1]).columns[0]
            low, n = int(m[3]), 1 if m[2] == "=" else int(m[4]) - int(m[3])
            return df.orderBy(by).offset(low).limit(max(n, 0))
        if (m := re.match(rf"({_NAME})\(\)\s*={{1,2}}\s*(.+)$", c)) and m[1] in self.function_indexes:
            name, rows = self.function_indexes[m[1]]
            hit = rows.where(F.col("value") == F.expr(self._expr(m[2]))).select(F.col("pk").alias("in_value")).distinct()
            return df.join(hit, F.col(self.table(name).pk) == F.col("in_value"), "left_semi")
        if m := _SUBQUERY.match(c):
            sub = self.sql(m[2])
            sub = sub.select(F.col(f"`{sub.columns[0]}`").alias("in_value")).distinct()
            return df.join(sub, F.expr(self._expr(m[1], docs, bare)) == F.col("in_value"), "left_semi")
        return df.where(self._predicate(c, docs, bare, dict(df.dtypes)))

    def _predicate(self, c: str, docs: dict[str, str], bare: dict[str, str] | None, types: dict[str, str]) -> Column:
        if (m := re.match(rf"({_NAME})\s*(=|!=)\s*(-?\d*\.\d+)$", c)) and types.get(m[1]) == "float":
            return F.expr(f"{m[1]} {m[2]} cast({m[3]} as float)")
        done = F.expr(self._expr(c, docs, bare))
        # A function as condition: numbers count as true unless they are 0.
        return done if re.search(r"[=<>]|\b(and|or|not|like|is|in|between)\b", re.sub(r"'[^']*'", "", c), re.I) else done.cast("boolean")

    def _where(self, t: Table, where: str) -> Column | None:
        """The whole condition as a column, if it needs no other table and no rank."""
        docs = {c: c for c in t.documents}
        out = F.lit(True)
        for c in conjuncts(where):
            if _SUBQUERY.match(c) or ".pos()" in c or any(f"{n}()" in c for n in self.function_indexes):
                return None
            out = out & self._predicate(c, docs, None, dict(t.df.dtypes))
        return F.coalesce(out, F.lit(False))

    def _joined(self, froms: list[tuple[str, str]], where: str, scan: bool) -> tuple[DataFrame, dict, list, dict]:
        """(joined rows, documents, keys, bare column names with their alias): every condition is a join key, a filter of one
        table before the join, or a filter of the joined rows."""
        owner = {a: n for n, a in froms}
        if len(owner) < len(froms):
            raise DialectError("each table of a join needs its own alias")
        homes: dict[str, list[str]] = {}
        for a, n in owner.items():
            for c in self.table(n).columns:
                homes.setdefault(c, []).append(a)
        bare = {c: f"{a[0]}.{c}" for c, a in homes.items() if len(a) == 1}
        docs = {f"{a}.{c}": f"{a}.{c}" for n, a in froms for c in self.table(n).documents}
        docs |= {c: x for c, x in bare.items() if x in docs}

        def home(name: str) -> str:
            head, _, rest = name.partition(".")
            if head in owner and rest:
                if rest.split(".")[0] not in self.table(owner[head]).types:
                    raise DialectError(f"no column {name}")
                return head
            if len(homes.get(head, ())) > 1:
                raise DialectError(f"{head} is a column of {' and '.join(homes[head])}")
            if head not in homes:
                raise DialectError(f"no column {name}")
            return homes[head][0]

        equal, alone, rest = [], {a: [] for a in owner}, []
        for c in conjuncts(where):
            sub = _SUBQUERY.match(c)
            used = {home(x) for x in columns_of(sub[1] if sub else c) if x.split(".")[-1] != "pos"}
            m = re.match(rf"({_NAME}(?:\.{_NAME})?)\s*={{1,2}}\s*({_NAME}(?:\.{_NAME})?)$", c)
            if m and len(used) == 2 and not any(x in docs for x in (m[1], m[2])):
                equal.append([(home(x), self._expr(x, docs, bare)) for x in (m[1], m[2])])
            elif len(used) == 1:
                alone[used.pop()].append(c)
            else:
                rest.append(c)
        # Conditions on one table go to it before the join; Catalyst picks order and physical join.
        frames = {}
        for a, n in owner.items():
            df = self.table(n).df.alias(a)
            for c in alone[a]:
                df = self._condition(df, c, docs, bare)
            frames[a] = df.alias(a)
        done, todo = [froms[0][1]], [a for _, a in froms[1:]]
        df = frames[done[0]]
        while todo:
            for a in todo:
                on = [F.expr(x) == F.expr(y) for (p, x), (q, y) in equal if (p == a and q in done) or (q == a and p in done)]
                if on:
                    df = df.join(frames[a], on)
                    done.append(a)
                    todo.remove(a)
                    break
            else:
                raise DialectError("tables do not form one chain of equalities; there is no cross join")
        for c in rest:
            df = self._condition(df, c, docs, bare)
        return df, docs, [F.col(f"{a}.{self.table(n).pk}") for n, a in froms], bare

    # -- rows -----------------------------------------------------------------------------------------------

    def _store(self, t: Table, df: DataFrame) -> None:
        self.changes += 1
        t.df = df.checkpoint() if self.changes % self.every == 0 and self.spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df

    def _fire(self, t: Table, kind: str, rows: DataFrame) -> None:
        for name, (when, f) in t.triggers.items():
            if when == kind:
                try:
                    f(rows)
                except Exception as e:  # a trigger's failure is noted and never ends the statement
                    self.log.append(f"trigger {name}: {e}")

    def _insert(self, text: str, replace: bool = False) -> int:
        m = re.match(rf"(?:INSERT|REPLACE)\s+INTO\s+({_NAME})\s*(?:\(([^()]*)\))?\s*VALUES\s*(.*)$", text, re.I | re.S)
        if not m:
            raise DialectError("INSERT INTO t [(columns)] VALUES (..) ..")
        t = self.table(m[1])
        body = re.sub(r"\s+RETURN\s+SIZE\s*$", "", m[3], flags=re.I)
        body, _, update = re.split(r"\s+ON\s+DUPLICATE\s+KEY\s+UPDATE\s+", body, maxsplit=1, flags=re.I)[0], None, (re.split(r"\s+ON\s+DUPLICATE\s+KEY\s+UPDATE\s+", body, maxsplit=1, flags=re.I) + [""])[1].strip().strip('"')
        rows = [split(r) for r in _rows(body)]
        columns = [c.strip() for c in m[2].split(",")] if m[2] else t.columns[: max(map(len, rows))]
        for c in columns:
            if c not in t.types:
                if not t.dynamic:
                    raise DialectError(f"no column {c}")
                v = rows[0][columns.index(c)]
                t.types[c] = "string" if v.startswith("'") else "float" if "." in v else "decimal(20,0)"
                t.df = t.df.withColumn(c, F.lit(None).cast(t.types[c]))
        new = dml.literal_rows(self.spark, rows, columns, t.types, t.pk, t.df, t.documents, self._value)
        n = len(rows)
        for i in t.indexes.values():
            if i.unique:
                dml.check_unique(t.df.join(new, t.pk, "left_anti").unionByName(new), i)
        if replace:
            df = dml.replace(t.df, new, t.pk)
        elif update:
            df = dml.upsert(t.df, new, t.pk, self._sets(t, update))
        else:
            df = dml.insert(t.df, new, t.pk)
        self._fire(t, "INSERT", new)
        self._store(t, df)
        return n

    def _replace(self, text: str) -> int:
        return self._insert(text, replace=True)

    def _sets(self, t: Table, text: str) -> dict[str, str]:
        out = {}
        for part in split(text):
            c, _, e = part.partition("=")
            c, e = c.strip(), e.strip()
            docs = {d: d for d in t.documents}
            if "." in c and c.split(".")[0] in t.documents:
                head, path = c.split(".", 1)
                out[head] = dml.json_set(head, path, self._expr(e, docs))
            elif c not in t.types:
                raise DialectError(f"no column {c}")
            else:
                out[c] = dml.guarded(c, e, t.types[c], docs, self.macros)
        return out

    def _update(self, text: str) -> int:
        m = re.match(rf"UPDATE\s+({_NAME})\s+SET\s+(.*?)\s+WHERE\s+(.*)$", text, re.I | re.S)
        if not m:
            raise DialectError("UPDATE t SET .. WHERE ..")
        t, q = self.table(m[1]), _tail(m[3])
        hit, sets = self._hit(t, q), self._sets(t, m[2])
        if t.pk in sets and hit.limit(2).count() > 1:
            raise DialectError("a primary key changes for one row at a time")
        unique = [i for i in t.indexes.values() if i.unique and set(i.columns) & sets.keys()]
        if unique and hit.limit(2).count() > 1:
            raise DialectError("a column of a unique index changes for one row at a time")
        self._fire(t, "PREUPDATE", hit)
        plain = self._where(t, q.where) if not q.order and q.limit is None else None
        if plain is not None:  # no join: the condition picks the rows in one narrow pass
            n = hit.count()
            df = dml.update_where(t.df, plain, sets)
        else:
            df, n = dml.update(t.df, hit, t.pk, sets)
        for i in [*unique, *([Index("primary key", (t.pk,))] if t.pk in sets else [])]:
            dml.check_unique(df, i)
        if any(when == "POSTUPDATE" for when, _ in t.triggers.values()):
            self._fire(t, "POSTUPDATE", df.join(hit.select(t.pk), t.pk, "left_semi"))
        self._store(t, df)
        return n

    def _delete(self, text: str) -> int:
        m = re.match(rf"DELETE\s+FROM\s+({_NAME})\s+WHERE\s+(.*)$", text, re.I | re.S)
        if not m:
            raise DialectError("DELETE FROM t WHERE ..")
        t, q = self.table(m[1]), _tail(m[2])
        hit = self._hit(t, q)
        n = hit.count()
        self._fire(t, "DELETE", hit)
        plain = self._where(t, q.where) if not q.order and q.limit is None else None
        self._store(t, t.df.where(~plain) if plain is not None else dml.delete(t.df, hit, t.pk))
        return n

    def _hit(self, t: Table, q: Query) -> DataFrame:
        docs = {c: c for c in t.documents}
        df = self._filtered(t, t.df, q.where, docs, False)
        if q.order or q.limit is not None:
            df = df.orderBy(*[F.expr(self._expr(x, docs)).desc() if d else F.expr(self._expr(x, docs)).asc() for x, d in q.order], t.pk)
            offset = self._cursor(q.offset, q.limit)
            df = df.offset(offset) if offset else df
            df = df.limit(q.limit) if q.limit is not None else df
        return df

    def _evict(self, text: str) -> int:
        _, name, *keys = text.split()
        t = self.table(name)
        if not t.dirty:
            raise DialectError("EVICT is for dirty tables: ALTER TABLE t SET DIRTY")
        self._store(t, t.df.where(~F.col(t.pk).cast("string").isin([k.strip("',") for k in keys])))
        return len(keys)

    # -- definitions ----------------------------------------------------------------------------------------

    def _create(self, text: str):
        if m := re.match(rf"CREATE\s+TABLE\s+({_NAME})\s+((?:SELECT|SCAN)\b.*)$", text, re.I | re.S):
            if m[2].upper().startswith("SCAN") or re.match(r"SELECT\s+COUNT\s*\(", m[2], re.I):
                raise DialectError("a table is made from SELECT of columns only")
            return self.register(m[1], self.sql(m[2]))
        if m := re.match(rf"CREATE\s+TABLE\s+({_NAME})\s*\((.*)\)\s*$", text, re.I | re.S):
            types, documents = {}, set()
            for part in split(m[2]):
                name, _, kind = part.strip().partition(" ")
                if name.upper() in ("PRIMARY", "UNIQUE", "FOREIGN", "KEY", "CONSTRAINT", "INDEX"):
                    continue
                if name.upper() in ("LRU", "LFU"):
                    raise DialectError(f"{name} is reserved")
                types[name.strip("`\"'")] = _type(kind)
                if kind.strip().upper().startswith(("LUATABLE", "DOCUMENT")):
                    documents.add(name)
            if len(types) < 2:
                raise DialectError("a table has at least two columns")
            if next(iter(types)) in documents:
                raise DialectError("a document is no primary key")
            if m[1].lower() in self.tables:
                raise DialectError(f"table {m[1]} exists")
            df = self.spark.createDataFrame([], ", ".join(f"`{c}` {k}" for c, k in types.items()))
            self.tables[m[1].lower()] = Table(m[1], types, df, documents=documents)
            return self.tables[m[1].lower()]
        if m := re.match(rf"CREATE\s+(UNIQUE\s+)?INDEX\s+({_NAME})\s+ON\s+({_NAME})\s*\((.*?)\)\s*(?:ORDER\s+BY\s+({_NAME}))?\s*(?:LONG|INT|TEXT|FLOAT)?\s*(?:LIMIT\s+\d+)?$", text, re.I):
            t, cols = self.table(m[3]), tuple(c.strip() for c in split(m[4]))
            index = Index(m[2], cols, bool(m[1]), m[5])
            if any(i.columns == cols for i in t.indexes.values()):
                raise DialectError("these columns have an index")
            for c in cols:
                if c not in t.types and c.split(".")[0] not in t.documents and "(" not in c:
                    raise DialectError(f"no column {c}")
            if index.unique:
                dml.check_unique(t.df, index)
            t.indexes[m[2]] = index
            return index
        if m := re.match(rf"CREATE\s+(LRU|LFU)INDEX\s+ON\s+({_NAME})$", text, re.I):
            t, c = self.table(m[2]), m[1].upper()
            t.types[c] = "bigint"
            t.hidden.add(c)
            t.df = t.df.withColumn(c, F.lit(0).cast("bigint"))
            t.indexes[f"{t.name}_{c}"] = Index(f"{t.name}_{c}", (c,))
            return t.indexes[f"{t.name}_{c}"]
        if m := re.match(rf"CREATE\s+LUATRIGGER\s+({_NAME})\s+ON\s+({_NAME})\s+(INSERT|DELETE|PREUPDATE|POSTUPDATE)\s+({_NAME})(?:\(.*\))?$", text, re.I):
            if m[4] not in self.functions:
                raise DialectError(f"no function {m[4]}")
            return self.trigger(m[1], m[2], m[3], self.functions[m[4]])
        raise DialectError("CREATE TABLE, INDEX, LRUINDEX, LFUINDEX or LUATRIGGER")

    def trigger(self, name: str, table: str, kind: str, f: Callable[[DataFrame], None]) -> None:
        """INSERT, DELETE, PREUPDATE or POSTUPDATE: ``f`` gets the rows concerned as a DataFrame."""
        self.table(table).triggers[name] = (kind.upper(), f)

    def _drop(self, text: str) -> None:
        _, kind, name = text.split()
        if kind.upper() == "INDEX" and name in self.function_indexes:
            del self.function_indexes[name]
            return
        if kind.upper() == "TABLE":
            self.table(name)
            del self.tables[name.lower()]
            return
        for t in self.tables.values():
            for of in (t.indexes, t.triggers):
                if name in of:
                    del of[name]
                    return
        raise DialectError(f"no {kind} {name}")

    def _alter(self, text: str) -> None:
        m = re.match(rf"ALTER\s+TABLE\s+({_NAME})\s+(.*)$", text, re.I)
        t = self.table(m[1])
        if a := re.match(rf"ADD\s+COLUMN\s+({_NAME})\s+(.*)$", m[2], re.I):
            t.types[a[1]] = _type(a[2])
            t.df = t.df.withColumn(a[1], F.lit(None).cast(t.types[a[1]]))
        elif re.match(r"ADD\s+HASHABILITY", m[2], re.I):
            t.dynamic = True
        elif re.match(r"SET\s+DIRTY", m[2], re.I):
            t.dirty = True
        elif not re.match(r"ADD\s+(SHARDKEY|FOREIGN\s+KEY)", m[2], re.I):
            raise DialectError("ADD COLUMN, HASHABILITY, SHARDKEY, FOREIGN KEY or SET DIRTY")

    def _desc(self, text: str) -> DataFrame:
        t = self.table(text.split()[1])
        rows = [(c, k, ",".join(i.name for i in t.indexes.values() if c in i.columns) + ("pk" if c == t.pk else "")) for c, k in t.types.items()]
        return self.spark.createDataFrame(rows, "column string, type string, index string")

    def _show(self, text: str) -> DataFrame:
        if text.split()[1].upper().startswith("TABLE"):
            return self.spark.createDataFrame([(t.name,) for t in self.tables.values()], "table string")
        return self.spark.createDataFrame([(i.name, t.name, ",".join(i.columns), i.unique) for t in self.tables.values() for i in t.indexes.values()], "index string, table string, columns string, unique boolean")

    def _explain(self, text: str) -> str:
        return self.sql(text.split(None, 1)[1])._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def _prepare(self, text: str) -> None:
        m = re.match(rf"PREPARE\s+({_NAME})\s+AS\s+(.*)$", text, re.I | re.S)
        self.prepared[m[1]] = m[2]

    def _execute(self, text: str) -> DataFrame:
        _, name, *values = re.findall(r"'(?:[^'\\]|\\.|'')*'|\S+", text)
        if name not in self.prepared:
            raise DialectError(f"no prepared statement {name}")
        body = self.prepared[name]
        places = {int(x) for x in re.findall(r"\$(\d+)", body)}
        if places and max(places) > len(values):
            raise DialectError(f"{name} takes {max(places)} values")
        return self.sql(re.sub(r"\$(\d+)", lambda m: values[int(m[1]) - 1], body))

    def _dump(self, text: str):
        from ..sources import snapshot

        m = re.match(rf"DUMP\s+({_NAME})(?:\s+TO\s+(FILE|MYSQL)\s*(\S+)?)?$", text, re.I)
        t = self.table(m[1])
        if not m[2]:
            return t.df.select(*t.columns)
        if m[2].upper() == "FILE":
            t.df.select(*t.columns).write.mode("overwrite").option("header", True).csv(m[3])
            return None
        return snapshot.script(t, m[3] or t.name)


_LOGGED = {"INSERT", "REPLACE", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER", "EVICT"}
_VERBS = _LOGGED | {"SELECT", "SCAN", "DESC", "SHOW", "EXPLAIN", "PREPARE", "EXECUTE", "DUMP", "INTERPRET", "LUAFUNC", "MESSAGE"}


@dataclass
class Query:
    columns: str = ""
    tables: str = ""
    where: str = ""
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: str | None = None


def _cut(text: str, word: str) -> tuple[str, str]:
    """``text`` before and after the keyword(s) ``word`` outside brackets and quotes."""
    pattern, depth, i = re.compile(rf"\s*\b{word}\b\s*", re.I), 0, 0
    while i < len(text):
        c = text[i]
        if c == "'":
            i = text.find("'", i + 1) + 1 or len(text)
            continue
        depth += (c == "(") - (c == ")")
        if depth == 0 and (i == 0 or not text[i - 1].isalnum()) and (m := pattern.match(text, i)):
            return text[:i].strip(), text[m.end() :].strip()
        i += 1
    return text.strip(), ""


def _tail(text: str) -> Query:
    q = Query()
    text, limit = _cut(text, "LIMIT")
    if limit:
        m = re.match(r"(\d+)(?:\s+OFFSET\s+(\w+))?$", limit, re.I)
        if not m:
            raise DialectError("LIMIT n [OFFSET m]")
        q.limit, q.offset = int(m[1]), m[2]
    q.where, order = _cut(text, r"ORDER\s+BY")
    for x in split(order) if order else []:
        down = re.sub(r"\s+DESC$", "", x, flags=re.I)
        q.order.append((re.sub(r"\s+ASC$", "", down, flags=re.I), down != x))
    if len(q.order) > 16:
        raise DialectError("at most 16 sort columns")
    return q


def _parse_select(text: str) -> Query:
    columns, rest = _cut(text[6:], "FROM")
    if not rest:
        raise DialectError("SELECT .. FROM ..")
    head, where = _cut(rest, "WHERE")
    if where:
        q = _tail(where)
        q.tables = head
    else:
        q = _tail(rest)
        q.tables, q.where = q.where, ""
    q.columns = columns
    return q


def _argument(text: str):
    if text[0] == "'":
        return text[1:-1].replace("''", "'")
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    return float(text) if re.fullmatch(r"-?\d+\.\d+", text) else text


def _from(text: str) -> tuple[str, str]:
    name, *alias = text.split()
    return name, alias[-1] if alias else name


def conjuncts(where: str) -> list[str]:
    """The conditions of an AND list; the AND of BETWEEN belongs to it. With an OR outside brackets it is one condition."""
    if where and _cut(where, "OR")[1]:
        return [where]
    out = []
    while where:
        head, where = _cut(where, "AND")
        if re.search(r"\bBETWEEN\s+\S+$", head, re.I) and where:
            high, where = _cut(where, "AND")
            head = f"{head} AND {high}"
        out.append(head)
    return out


def _rows(text: str) -> list[str]:
    out, depth, start, quoted = [], 0, 0, False
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted and c == "(":
            depth += 1
            start = i + 1 if depth == 1 else start
        elif not quoted and c == ")":
            depth -= 1
            if depth == 0:
                out.append(text[start:i])
    return out


def _type(text: str) -> str:
    word = text.strip().upper()
    for name, kind in _TYPES:
        if word.startswith(name):
            return kind
    raise DialectError(f"unknown type {text}")
