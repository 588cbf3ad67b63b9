"""Further registered queries: conditions over joins, expressions, functions, logs, output and graphs with cycles.

The same three forms as in :mod:`.catalogue`, which takes them up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, keyvalue
from ..sources import rows, session, snapshot
from ..streaming import feeds
from .catalogue import engine, ladder, query, table, tree
from .engine import DialectError, Engine

STATEMENTS: dict[str, tuple[str, list[str] | None, str]] = {
    "join_compare": ("SELECT o.o_orderkey, l.l_linenumber FROM orders o, lineitem l WHERE o.o_orderkey = l.l_orderkey AND o.o_totalprice < l.l_extendedprice * 3 AND o.o_custkey != l.l_suppkey", None, "SELECT o_orderkey, l_linenumber FROM orders, lineitem WHERE o_orderkey = l_orderkey AND o_totalprice < l_extendedprice * 3 AND o_custkey <> l_suppkey"),
    "join_bare_columns": ("SELECT c_name, n_name FROM customer c, nation n WHERE c_nationkey = n_nationkey AND c_acctbal > 5000 AND n_regionkey = 1", None, "SELECT c_name, n_name FROM customer, nation WHERE c_nationkey = n_nationkey AND c_acctbal > 5000 AND n_regionkey = 1"),
    "join_same_table_columns": ("SELECT l.l_orderkey, l.l_linenumber, o.o_custkey FROM lineitem l, orders o WHERE l.l_orderkey = o.o_orderkey AND l.l_suppkey = l.l_linenumber", None, "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem, orders WHERE l_orderkey = o_orderkey AND l_suppkey = l_linenumber"),
    "join_either": ("SELECT c.c_custkey, n.n_name FROM customer c, nation n WHERE c.c_nationkey = n.n_nationkey AND (c.c_acctbal > 9000 or n.n_regionkey == 2)", None, "SELECT c_custkey, n_name FROM customer, nation WHERE c_nationkey = n_nationkey AND (c_acctbal > 9000 OR n_regionkey = 2)"),
    "join_subquery": ("SELECT c.c_custkey, n.n_name FROM customer c, nation n WHERE c.c_nationkey = n.n_nationkey AND c.c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", None, "SELECT c_custkey, n_name FROM customer, nation WHERE c_nationkey = n_nationkey AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "join_five": ("SELECT l.l_orderkey, s.s_name, n.n_name, c.c_name FROM lineitem l, orders o, customer c, supplier s, nation n WHERE l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND l.l_suppkey = s.s_suppkey AND s.s_nationkey = n.n_nationkey AND c.c_nationkey = s.s_nationkey", None, "SELECT l_orderkey, s_name, n_name, c_name FROM lineitem, orders, customer, supplier, nation WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND c_nationkey = s_nationkey"),
    "scan_backwards": ("SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 100 AND 4000 ORDER BY o_orderkey DESC LIMIT 40 OFFSET 3", None, "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 100 AND 4000 ORDER BY o_orderkey DESC LIMIT 40 OFFSET 3"),
    "expression_binding": ("SCAN n_nationkey, n_nationkey * n_regionkey % 3, -n_nationkey % 3, (n_nationkey + n_regionkey) % 4, 2 ^ 3 ^ 2, -2 ^ 2, n_nationkey - 2 * n_regionkey / 4, n_nationkey % (0 - 3), 10 - 4 - 3 FROM nation", list("kabcdefgh"), "SELECT n_nationkey AS k, n_nationkey * n_regionkey % 3 AS a, (3 - n_nationkey % 3) % 3 AS b, (n_nationkey + n_regionkey) % 4 AS c, 512.0::DOUBLE AS d, -4.0::DOUBLE AS e, n_nationkey - n_regionkey / 2 AS f, CAST(n_nationkey - ceil(n_nationkey / 3) * 3 AS INT) AS g, 3 AS h FROM nation"),
    "expression_comparisons": ("SCAN p_partkey, p_size == 5, p_size ~= 5, p_size < 5, p_size <= 5, p_size > 5, p_size >= 5 FROM part", list("kabcdef"), "SELECT p_partkey AS k, p_size = 5 AS a, p_size <> 5 AS b, p_size < 5 AS c, p_size <= 5 AS d, p_size > 5 AS e, p_size >= 5 AS f FROM part"),
    "expression_logic": ("SCAN p_partkey FROM part WHERE p_size == 5 or p_size > 20 and not (p_partkey % 2 == 0) or p_brand == 'Brand#3'", None, "SELECT p_partkey FROM part WHERE p_size = 5 OR p_size > 20 AND NOT p_partkey % 2 = 0 OR p_brand = 'Brand#3'"),
    "expression_math": ("SCAN n_nationkey, math.abs(3 - n_nationkey), math.ceil(n_nationkey / 2), math.fmod(n_nationkey, 4), math.log(n_nationkey + 1), math.log10(n_nationkey + 1), math.min(n_nationkey, 7), math.exp(n_regionkey), math.pow(n_regionkey, 3), math.sin(n_nationkey), math.random(3, 3) FROM nation", list("kabcdefghij"), "SELECT n_nationkey AS k, abs(3 - n_nationkey) AS a, CAST(ceil(n_nationkey / 2) AS BIGINT) AS b, n_nationkey % 4 AS c, ln(n_nationkey + 1) AS d, log10(n_nationkey + 1) AS e, least(n_nationkey, 7) AS f, exp(n_regionkey) AS g, pow(n_regionkey, 3) AS h, sin(n_nationkey) AS i, 3::BIGINT AS j FROM nation"),
    "expression_text": ("SCAN n_nationkey, string.find(n_name, 'A'), string.gsub(n_name, 'A', 'o'), string.byte(n_name), string.char(65 + n_regionkey), string.format('%s-%d', n_name, n_regionkey) FROM nation", list("kabcde"), "SELECT n_nationkey AS k, CAST(instr(n_name, 'A') AS INT) AS a, replace(n_name, 'A', 'o') AS b, ascii(n_name) AS c, chr(65 + n_regionkey) AS d, n_name || '-' || n_regionkey AS e FROM nation"),
    "expression_time": ("SCAN r_regionkey, os.time() > 1000000000, string.len(os.date()) FROM region", list("kab"), "SELECT r_regionkey AS k, true AS a, 19 AS b FROM region"),
    "json_encode": ("SCAN n_nationkey, Json.encode(n_name), Json.encode(n_regionkey), DataDumper(n_name) FROM nation", list("kabc"), "SELECT n_nationkey AS k, '\"' || n_name || '\"' AS a, CAST(n_regionkey AS VARCHAR) AS b, '\"' || n_name || '\"' AS c FROM nation"),
    "json_decode": ("SCAN event_id, tostring(Json.decode(props)), Json.encode(props) FROM events", list("kab"), "SELECT event_id AS k, replace(props, ' ', '') AS a, props AS b FROM events"),
    "wire_encode": ("SCAN r_regionkey, Wire.encode('SET', r_name, r_regionkey) FROM region", ["k", "w"], "SELECT r_regionkey AS k, '*3' || chr(13) || chr(10) || '$3' || chr(13) || chr(10) || 'SET' || chr(13) || chr(10) || '$' || strlen(r_name) || chr(13) || chr(10) || r_name || chr(13) || chr(10) || '$1' || chr(13) || chr(10) || r_regionkey || chr(13) || chr(10) AS w FROM region"),
    "filter_number": ("SCAN p_partkey FROM part WHERE math.fmod(p_size, 3) AND p_partkey < 100", None, "SELECT p_partkey FROM part WHERE p_size % 3 <> 0 AND p_partkey < 100"),
    "filter_pattern": ("SCAN p_partkey FROM part WHERE p_brand like 'Brand#1%' AND p_name is not null AND p_size not in (1, 2, 3)", None, "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#1%' AND p_name IS NOT NULL AND p_size NOT IN (1, 2, 3)"),
    "project_case": ("SCAN o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END FROM orders", ["k", "c"], "SELECT o_orderkey AS k, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS c FROM orders"),
    "count_limit": ("SCAN COUNT(*) FROM lineitem WHERE l_quantity > 10 LIMIT 70 OFFSET 5", None, "SELECT count(*) AS count FROM (SELECT 1 FROM lineitem WHERE l_quantity > 10 LIMIT 70 OFFSET 5)"),
}

CHANGES: dict[str, tuple[tuple[str, ...], list[str], str]] = {
    "literal_with_line_break": (("region",), ["INSERT INTO region\n VALUES (7,'two\nlines  here')", "SCAN * FROM region"], "SELECT * FROM region UNION ALL VALUES (7, 'two' || chr(10) || 'lines  here')"),
    "prepared_text": (("nation",), ["INSERT INTO nation VALUES (40,'NEW LAND',1)", "PREPARE p AS SELECT n_nationkey FROM nation WHERE n_regionkey = $2 AND n_name = $1", "EXECUTE p 'NEW LAND' 1"], "SELECT 40 AS n_nationkey"),
    "drop_table": (("region", "nation"), ["DROP TABLE nation", "SHOW TABLES"], "SELECT 'region' AS \"table\""),
    "drop_index": (("nation",), ["CREATE INDEX i_name ON nation (n_name)", "DROP INDEX nation_0", "SHOW INDEXES"], "SELECT 'i_name' AS \"index\", 'nation' AS \"table\", 'n_name' AS columns, false AS \"unique\""),
    "frequency_index": (("region",), ["CREATE LFUINDEX ON region", "SHOW INDEXES"], "SELECT 'region_LFU' AS \"index\", 'region' AS \"table\", 'LFU' AS columns, false AS \"unique\""),
    "nested_path_index": (("events",), ["CREATE INDEX i_k ON events (props.k) LONG", "SCAN event_id FROM events WHERE props.k BETWEEN 20 AND 30 ORDER BY tonumber(props.k)"], "SELECT event_id FROM events WHERE CAST(props->>'$.k' AS INT) BETWEEN 20 AND 30"),
    "ordered_index": (("orders",), ["CREATE INDEX i_status ON orders (o_orderstatus) ORDER BY o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice LIMIT 30"], "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 30"),
    "index_built_in_steps": (("orders",), ["CREATE INDEX i_price ON orders (o_totalprice) LIMIT 100", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 20000"], "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 20000"),
    "functions_from_source": (("nation",), ["INTERPRET LUA 'function grade(a, b) return (a * 3 + b) % 7 end function twice(a) return grade(a, 1) * 2 end'", "SCAN n_nationkey, grade(n_nationkey, n_regionkey), twice(n_regionkey) FROM nation WHERE grade(n_nationkey, 0) > 2 ORDER BY grade(n_nationkey, 1), n_nationkey LIMIT 9"], "SELECT n_nationkey, (n_nationkey * 3 + n_regionkey) % 7 AS \"grade(n_nationkey,n_regionkey)\", (n_regionkey * 3 + 1) % 7 * 2 AS \"twice(n_regionkey)\" FROM nation WHERE n_nationkey * 3 % 7 > 2 ORDER BY (n_nationkey * 3 + 1) % 7, n_nationkey LIMIT 9"),
    "function_in_update": (("nation",), ["INTERPRET LUA 'function label(a, n) return a .. ''/'' .. tostring(n) end'", "UPDATE nation SET n_name = label(n_name, n_regionkey) WHERE n_regionkey > 1", "SCAN n_nationkey, n_name FROM nation"], "SELECT n_nationkey, CASE WHEN n_regionkey > 1 THEN n_name || '/' || n_regionkey ELSE n_name END AS n_name FROM nation"),
    "function_in_insert": (("events",), ["INTERPRET LUA 'function doc(n) return ''{\"k\":'' .. tostring(n * 2) .. ''}'' end'", "CREATE TABLE d (id INT, lo LUATABLE)", "INSERT INTO d VALUES (1,doc(4)) (2,{'k':9})", "SCAN id, lo.k FROM d"], "SELECT * FROM (VALUES (1::BIGINT, '8'), (2, '9')) AS v(id, \"lo.k\")"),
    "cursor_ends": (("nation",), ["SCAN n_nationkey FROM nation ORDER BY n_nationkey LIMIT 20 OFFSET c", "SCAN n_nationkey FROM nation ORDER BY n_nationkey LIMIT 20 OFFSET c", "SCAN n_nationkey FROM nation ORDER BY n_nationkey LIMIT 20 OFFSET c"], "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 20"),
    "update_key": (("nation",), ["UPDATE nation SET n_nationkey = 70 WHERE n_nationkey = 7", "SCAN n_nationkey, n_name FROM nation"], "SELECT CASE n_nationkey WHEN 7 THEN 70 ELSE n_nationkey END AS n_nationkey, n_name FROM nation"),
    "update_remainder": (("customer",), ["UPDATE customer SET c_nationkey = c_nationkey % 4 WHERE c_custkey > 5", "UPDATE customer SET c_nationkey = c_nationkey * 3 - c_nationkey % 2 WHERE c_custkey > 5", "SCAN c_custkey, c_nationkey FROM customer"], "SELECT c_custkey, CASE WHEN c_custkey > 5 THEN c_nationkey % 4 * 3 - c_nationkey % 4 % 2 ELSE c_nationkey END AS c_nationkey FROM customer"),
    "message_without_reply": (("region",), ["MESSAGE DELETE FROM region WHERE r_regionkey = 3", "SCAN r_regionkey FROM region"], "SELECT r_regionkey FROM region WHERE r_regionkey <> 3"),
    "update_subquery": (("orders", "customer"), ["UPDATE orders SET o_orderstatus = 'X' WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 4)", "SCAN o_orderkey, o_orderstatus FROM orders"], "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 4) THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders"),
    "delete_or": (("orders",), ["DELETE FROM orders WHERE o_custkey < 50 or o_totalprice > 200000", "SCAN o_orderkey FROM orders"], "SELECT o_orderkey FROM orders WHERE NOT (o_custkey < 50 OR o_totalprice > 200000)"),
}


def said(spark, values: list) -> DataFrame:
    """Values that the driver got, as rows (n, said)."""
    return spark.createDataFrame([(i, None if v is None else str(v)) for i, v in enumerate(values)], "n int, said string")


# -- statements, functions ------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES (0, 'True'), (1, 'True')) AS v(n, said)")
def explain(spark, sf_dir):
    text = engine(spark, sf_dir, "orders").sql("EXPLAIN SELECT o_orderkey FROM orders WHERE o_custkey = 7")
    return said(spark, ["EqualTo(o_custkey,7)" in text, "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text])


@query("SELECT min(o_orderkey) AS least, max(o_orderkey) AS greatest FROM orders")
def key_extremes(spark, sf_dir):
    return engine(spark, sf_dir, "orders").extremes("orders")


@query("SELECT * FROM (VALUES (0, '17'), (1, 'x/y'), (2, '21'), (3, '25'), (4, 'refused')) AS v(n, said)")
def function_calls(spark, sf_dir):
    """Calls by name: of an expression, of a Python function, and of one that runs statements itself."""
    e = engine(spark, sf_dir, "nation")
    e.sql("INTERPRET LUA 'function add(a, b) return a + b end function path(a, b) return a .. ''/'' .. b end'")
    e.functions["triple"] = lambda a: a * 3
    e.functions["rows_of"] = lambda t: e.sql(f"SCAN COUNT(*) FROM {t}").first()[0]
    got = [e.sql("LUAFUNC add 8 9"), e.sql("LUAFUNC path x 'y'"), e.sql("LUAFUNC triple 7"), e.sql("LUAFUNC rows_of nation")]
    try:
        e.sql("LUAFUNC none 1")
    except DialectError:
        got.append("refused")
    return said(spark, got)


@query("SELECT * FROM (VALUES (0, '10'), (1, '81')) AS v(n, said)")
def functions_from_file(spark, sf_dir):
    e, path = engine(spark, sf_dir, "region"), session.scratch(spark, "source")
    spark.createDataFrame([("function double(a) return a * 2 end\nfunction square(a) return math.floor(a ^ 2) end",)], "value string").coalesce(1).write.text(path)
    e.sql(f"INTERPRET LUAFILE {path}")
    return said(spark, [e.sql("LUAFUNC double 5"), e.sql("LUAFUNC square 9")])


@query("SELECT n_nationkey AS a, n_name AS b FROM nation WHERE n_regionkey = 2")
def function_gives_rows(spark, sf_dir):
    e = engine(spark, sf_dir, "nation")
    e.functions["of_region"] = lambda r: e.sql(f"SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = {r}")
    return e.sql("LUAFUNC of_region 2").toDF("a", "b")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (3, 9, 11)")
def index_kept_by_code(spark, sf_dir):
    """An index whose rows code makes and changes; conditions ask for it by name."""
    e = engine(spark, sf_dir, "nation")
    e.function_index("relation", "nation", spark.createDataFrame([(10, 3), (10, 4), (20, 9), (10, 5)], "value int, pk int"))
    e.delete_index("relation", 10, 4)
    e.update_index("relation", 20, 10, 9)
    e.update_index("relation", 10, 30, 5)
    e.set_index("relation", 10, 11)
    return e.sql("SELECT n_nationkey, n_name FROM nation WHERE relation() = 10")


@query("SELECT n_nationkey, 'PREUPDATE' AS kind, n_name FROM nation WHERE n_regionkey = 3 UNION ALL SELECT n_nationkey, 'POSTUPDATE', 'x' FROM nation WHERE n_regionkey = 3")
def update_triggers(spark, sf_dir):
    """Triggers of both kinds made by statements; one that fails is noted and ends nothing; dropped ones are silent."""
    e, seen = engine(spark, sf_dir, "nation"), []
    for kind in ("PREUPDATE", "POSTUPDATE"):
        e.functions[f"note_{kind.lower()}"] = lambda rows, k=kind: seen.append(rows.select("n_nationkey", F.lit(k).alias("kind"), "n_name"))
        e.sql(f"CREATE LUATRIGGER t_{kind.lower()} ON nation {kind} note_{kind.lower()}()")
    e.functions["broken"] = lambda rows: 1 / 0
    e.sql("CREATE LUATRIGGER t_broken ON nation PREUPDATE broken()")
    e.sql("UPDATE nation SET n_name = 'x' WHERE n_regionkey = 3")
    e.sql("DROP LUATRIGGER t_preupdate")
    e.sql("DROP LUATRIGGER t_postupdate")
    e.sql("UPDATE nation SET n_name = 'y' WHERE n_regionkey = 3")
    return seen[0].unionByName(seen[1])


@query("SELECT * FROM (VALUES (0, 'ConstraintError'), (1, 'ConstraintError'), (2, 'DialectError'), (3, 'DialectError'), (4, 'DialectError'), (5, 'DialectError'), (6, 'DialectError'), (7, 'ConstraintError'), (8, 'ConstraintError'), (9, '25')) AS v(n, said)")
def refusals(spark, sf_dir):
    """Statements that must fail, and the table unchanged by them."""
    e, got = engine(spark, sf_dir, "nation", "region"), []
    e.sql("CREATE UNIQUE INDEX u ON nation (n_name)")
    taken = e.sql("SELECT n_name FROM nation WHERE n_nationkey = 3").first()[0]
    for s in (f"INSERT INTO nation VALUES (90,'{taken}',1)", "INSERT INTO nation VALUES (3,'Z',1)", "CREATE INDEX i ON nation (none)", "EVICT nation 1", "SELECT n.n_name FROM nation n, region r WHERE n.n_regionkey > r.r_regionkey", "SELECT n.n_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey AND other = 3", "UPDATE nation SET n_name = 'same' WHERE n_regionkey = 1", f"UPDATE nation SET n_name = '{taken}' WHERE n_nationkey = 4", "UPDATE nation SET n_nationkey = 5 WHERE n_nationkey = 4"):
        try:
            e.sql(s)
            got.append("taken")
        except ValueError as x:
            got.append(type(x).__name__)
    return said(spark, [*got, e.sql("SCAN COUNT(*) FROM nation").first()[0]])


# -- persistence, output --------------------------------------------------------------------------------------------


@query("SELECT event_id, props->>'$.k' AS k FROM events WHERE CAST(props->>'$.k' AS INT) > 80")
def documents_round_trip(spark, sf_dir):
    """Documents saved with their table and read again by path."""
    e, path = engine(spark, sf_dir, "events"), session.scratch(spark, "snapshot")
    snapshot.save(e, path)
    other = Engine(spark)
    snapshot.load(other, path)
    return other.sql("SCAN event_id, props.k FROM events WHERE props.k > 80").toDF("event_id", "k")


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 2 THEN 'it''s, two' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey <> 5")
def log_rewritten(spark, sf_dir):
    """The least log of definitions and rows, run by a fresh engine."""
    e, path = engine(spark, sf_dir, "nation"), session.scratch(spark, "log")
    e.sql("UPDATE nation SET n_name = 'it''s, two' WHERE n_nationkey = 2")
    e.sql("DELETE FROM nation WHERE n_nationkey = 5")
    snapshot.rewrite_log(e, path)
    other = Engine(spark)
    snapshot.read_rewritten(other, path)
    return other.sql("SCAN n_nationkey, n_name, n_regionkey FROM nation").select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int"))


@query("SELECT r_regionkey, CASE r_regionkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE r_name END AS r_name FROM region")
def log_appended(spark, sf_dir):
    """Statements kept in the shared folder in turns, and run again in order."""
    e, other, path = engine(spark, sf_dir, "region"), engine(spark, sf_dir, "region"), session.scratch(spark, "log")
    for s in ("UPDATE region SET r_name = 'x' WHERE r_regionkey = 1", "UPDATE region SET r_name = 'two' WHERE r_regionkey = 2", "UPDATE region SET r_name = 'one' WHERE r_regionkey = 1"):
        e.sql(s)
        snapshot.append_log(e, path)
    snapshot.replay(other, snapshot.read_log(spark, path))
    return other.sql("SCAN * FROM region")


@query("SELECT n_nationkey || ',''' || replace(n_name, 'A', '''''') || ''',' || n_regionkey AS value FROM nation")
def rows_as_text(spark, sf_dir):
    got = engine(spark, sf_dir, "nation").sql("SCAN n_nationkey, n_name, n_regionkey FROM nation")
    return rows.as_text(got.withColumn("n_name", F.replace("n_name", F.lit("A"), F.lit("'"))))


@query("SELECT '*2' || chr(13) || chr(10) || ':' || n_nationkey || chr(13) || chr(10) || '$' || strlen(n_name) || chr(13) || chr(10) || n_name || chr(13) || chr(10) AS value FROM nation")
def rows_as_replies(spark, sf_dir):
    return rows.as_replies(engine(spark, sf_dir, "nation").sql("SCAN n_nationkey, n_name FROM nation"))


@query("SELECT 0 AS n, 'r_regionkey,r_name' AS said UNION ALL SELECT 1, NULL UNION ALL SELECT 2, '5' UNION ALL SELECT 3, '0 ' || r_name FROM region WHERE r_regionkey = 0")
def rows_to_a_callback(spark, sf_dir):
    df, seen = engine(spark, sf_dir, "region").sql("SCAN * FROM region ORDER BY r_regionkey"), []
    n = rows.each(df, lambda k, name: seen.append(f"{k} {name}"))
    return said(spark, [rows.header(df), rows.header(df.where("r_regionkey > 99")), n, seen[0]])


@query("SELECT CAST(n_nationkey AS VARCHAR) AS c0, n_name || ', \"' || n_regionkey || '\"' AS c1, NULL::VARCHAR AS c2 FROM nation")
def csv_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "nation").select(F.concat("n_nationkey", F.lit(',"'), "n_name", F.lit(', ""'), "n_regionkey", F.lit('"""')).alias("value"))
    return rows.csv_fields(lines, 3)


@query("WITH w AS (SELECT CAST(user_id AS VARCHAR) AS key, event_type AS value, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS next, max(ts) OVER () AS seen FROM events) SELECT key, value, ts AS at, CASE WHEN next IS NULL OR next >= ts + INTERVAL 600 SECONDS THEN ts + INTERVAL 600 SECONDS END AS gone FROM w WHERE next IS NOT NULL OR ts + INTERVAL 600 SECONDS < seen")
def stream_of_expiring_keys(spark, sf_dir):
    """Each event overwrites its user's last one, unless that has expired after 600 seconds."""
    static = table(spark, sf_dir, "events")
    out, mark = session.scratch(spark, "expiry"), session.scratch(spark, "expiry-state")
    path = f"{sf_dir}/events.parquet"
    source = (path, "*") if session.is_folder(spark, path) else (sf_dir, "events.parquet")
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", source[1]).parquet(source[0])
    told = feeds.expiring(stream.select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), "ts"), 600)
    told.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(told.schema).parquet(out)


# -- graphs ---------------------------------------------------------------------------------------------------------

_LADDER = "e AS (SELECT n_nationkey AS src, n_nationkey // 3 AS dst FROM nation WHERE n_nationkey > 0 UNION SELECT n_nationkey, n_nationkey - 1 FROM nation WHERE n_nationkey > 0)"


@query(f"WITH RECURSIVE {_LADDER}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w(id, depth) AS (SELECT 24, 1 UNION SELECT b.dst, w.depth + 1 FROM w JOIN b ON b.src = w.id WHERE w.depth < 26) SELECT id::BIGINT AS id, min(depth) AS depth FROM w GROUP BY id")
def graph_breadth_first_cycles(spark, sf_dir):
    """Edges taken in both directions, so every edge is a cycle."""
    return graph.bfs(ladder(spark, sf_dir), 24, expander="BOTH").select("id", "depth")


def ring(spark, sf_dir) -> DataFrame:
    """Each nation with an edge to the next one and one to the fifth after it."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("src"), F.explode(F.array(F.lit(1), F.lit(5))).alias("step"))
    return n.select("src", F.pmod(F.col("src") + F.col("step"), F.lit(25)).alias("dst"), F.when(F.col("step") == 1, "NEXT").otherwise("CHORD").alias("rtype"), F.col("step").cast("double").alias("weight"))


@query("SELECT n_nationkey::BIGINT AS id, n_nationkey + 1 AS depth, n_nationkey::BIGINT AS place FROM nation")
def graph_depth_first_cycles(spark, sf_dir):
    """A ring with chords: the walk goes round the ring before it takes a chord."""
    return graph.dfs(ring(spark, sf_dir), 0).select("id", "depth", "place")


@query("SELECT n_nationkey::BIGINT AS id, ((n_nationkey + 1) % 25)::BIGINT AS there, 'NEXT' AS rtype FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey, (n_nationkey + 24) % 25, 'NEXT' FROM nation WHERE n_regionkey = 1")
def graph_neighbours(spark, sf_dir):
    some = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("id"))
    return graph.neighbours(ring(spark, sf_dir), some, "BOTH", "NEXT")


@query("SELECT ((n_nationkey + 20) % 25)::BIGINT AS id FROM nation WHERE n_nationkey = 3")
def graph_relation_index(spark, sf_dir):
    return graph.connected_to(ring(spark, sf_dir), 3, "CHORD")


@query("SELECT n_name || '-[NEXT]->' || (SELECT n_name FROM nation WHERE n_nationkey = 8) AS path, 2 AS depth FROM nation WHERE n_nationkey = 7")
def graph_traverse_options(spark, sf_dir):
    people = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return graph.traverse(people, ring(spark, sf_dir), "BFS", 7, "REPLY.PATH", "TYPE.NEXT", "MIN_DEPTH.2", "MAX_DEPTH.2", "UNIQUENESS.PATH_GLOBAL")


@query("SELECT n_nationkey::BIGINT AS src, ((n_nationkey + 5) % 25)::BIGINT AS dst, 5.0::DOUBLE AS weight FROM nation WHERE n_nationkey NOT IN (4, 24) UNION ALL SELECT 9, 2, 1.5")
def graph_changes(spark, sf_dir):
    """Vertices and edges added and removed, saved and loaded."""
    people = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    edges = ring(spark, sf_dir).where("rtype = 'CHORD'")
    people = graph.add_vertex(people, spark.createDataFrame([(77, "new"), (3, "twice")], "id long, name string"))
    edges = graph.add_edge(graph.delete_edge(edges, 24, "CHORD", 4), 9, "CHORD", 2, weight=1.5)
    edges = graph.add_edge(edges, 77, "CHORD", 1, weight=0.5)
    people, edges = graph.delete_vertex(people, edges, [77])
    edges = graph.delete_edge(edges, 4, "CHORD", 9)
    path = session.scratch(spark, "graph")
    graph.save(people, edges, path)
    return graph.load(spark, path)[1].select("src", "dst", "weight")


@query("SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey = 3 THEN 'red' END AS colour FROM nation")
def graph_node_property(spark, sf_dir):
    people = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.create_map(F.lit("old"), "n_name").alias("props"))
    people = graph.set_property(people, F.col("id").isin(3, 4), "colour", "red")
    people = graph.set_property(people, F.col("id") == 4, "colour", None)
    return people.select("id", F.try_element_at("props", F.lit("colour")).alias("colour"))


@query("SELECT sqrt(pow(a.n_regionkey - b.n_regionkey, 2) + pow(a.n_nationkey - b.n_nationkey, 2)) AS distance FROM nation a, nation b WHERE a.n_nationkey = 20 AND b.n_nationkey = 3")
def graph_distance(spark, sf_dir):
    places = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("x"), F.col("n_nationkey").alias("y"))
    return graph.node_delta(places, 20, 3)


@query("SELECT n_nationkey::BIGINT AS id, least((n_nationkey + 1) % 25, (n_nationkey + 5) % 25) || ',' || greatest((n_nationkey + 1) % 25, (n_nationkey + 5) % 25) AS friends FROM nation")
def graph_friends(spark, sf_dir):
    got = graph.friends(ring(spark, sf_dir).withColumn("rtype", F.lit("KNOWS")), "KNOWS")
    return got.select("id", F.array_join(F.col("friends").cast("array<string>"), ",").alias("friends"))


@query("SELECT * FROM (VALUES (1, 1::BIGINT), (2, 2), (3, 4), (4, 8)) AS v(depth, walks)")
def graph_without_uniqueness(spark, sf_dir):
    """Every walk counts: two steps lead on from each vertex."""
    return graph.bfs(ring(spark, sf_dir), 0, max_depth=4, uniqueness="NONE").groupBy("depth").agg(F.count("*").alias("walks"))


@query("SELECT 1 + 2 * count(*) AS n FROM nation")
def graph_unique_by_step(spark, sf_dir):
    """Each (parent, type, vertex) once: every edge within reach, and the start."""
    return graph.bfs(ring(spark, sf_dir), 0, uniqueness="PATH_GLOBAL").agg(F.count("*").alias("n"))


@query("WITH RECURSIVE e AS (SELECT c_custkey AS src, c_custkey // 3 AS dst FROM customer WHERE c_custkey > 0), w(id, depth) AS (SELECT 0::BIGINT, 1 UNION ALL SELECT e.src, w.depth + 1 FROM w JOIN e ON e.dst = w.id WHERE w.id % 5 <> 2 OR w.depth < 3) SELECT * FROM w WHERE id % 2 = 1 OR depth = 2")
def graph_evaluation(spark, sf_dir):
    """Rows told and rows gone on from by conditions of their own: include or exclude, continue or prune."""
    edges = tree(spark, sf_dir)
    return graph.bfs(edges, 0, expander="INCOMING", emit="id % 2 = 1 or depth = 2", expand="id % 5 <> 2 or depth < 3").select("id", "depth")


@query("SELECT CAST(n_regionkey AS VARCHAR) AS key, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS items FROM nation GROUP BY n_regionkey")
def select_into_list(spark, sf_dir):
    got = engine(spark, sf_dir, "nation").sql("SCAN n_regionkey, n_nationkey FROM nation")
    lists = keyvalue.from_rows(got, F.col("n_regionkey").cast("string"), F.col("n_nationkey"), "list")
    return lists.select("key", F.array_join(F.array_sort("items").cast("array<string>"), ",").alias("items"))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS key, n_name AS field, CAST(n_nationkey AS VARCHAR) AS value FROM nation")
def select_into_hash(spark, sf_dir):
    got = engine(spark, sf_dir, "nation").sql("SCAN n_regionkey, n_name, n_nationkey FROM nation")
    return keyvalue.hgetall(keyvalue.from_rows(got, F.col("n_regionkey").cast("string"), F.struct("n_name", F.col("n_nationkey").cast("string")), "hash"))
