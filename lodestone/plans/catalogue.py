"""Registered queries of the engine and the SQL that gives the same rows.

``STATEMENTS`` holds single statements of the dialect: name -> (statement, column names or None, SQL). ``CHANGES`` holds
statement lists whose effect the last one, a SCAN, shows. Everything else is a function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, keyvalue
from ..sources import session, snapshot
from ..streaming import feeds
from .engine import Engine

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id"}
_INDEXES = {"nation": (("n_regionkey",),), "customer": (("c_nationkey",), ("c_mktsegment", "c_nationkey")), "orders": (("o_custkey",), ("o_orderdate",)), "lineitem": (("l_partkey",), ("l_suppkey", "l_partkey")), "part": (("p_size",), ("p_brand",)), "supplier": (("s_nationkey",),), "events": (("user_id",),)}


def engine(spark: SparkSession, sf_dir: str, *names: str, strict: bool = False) -> Engine:
    e = Engine(spark, strict=strict)
    for n in names or KEYS:
        e.register(n, spark.read.parquet(f"{sf_dir}/{n}.parquet"), documents=("props",) if n == "events" else (), indexes=_INDEXES.get(n, ()))
    return e


STATEMENTS: dict[str, tuple[str, list[str] | None, str]] = {
    # scans
    "scan_point": ("SELECT * FROM orders WHERE o_orderkey = 77", None, "SELECT * FROM orders WHERE o_orderkey = 77"),
    "scan_pk_range": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 400", None, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 400"),
    "scan_index_equal": ("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7", None, "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7"),
    "scan_index_range": ("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 12", None, "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 12"),
    "scan_in_pk": ("SELECT * FROM supplier WHERE s_suppkey IN (1, 3, 5, 7)", None, "SELECT * FROM supplier WHERE s_suppkey IN (1, 3, 5, 7)"),
    "scan_in_index": ("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", None, "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "scan_compound_index": ("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3", None, "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3"),
    "scan_full": ("SCAN o_orderkey, o_orderpriority FROM orders WHERE o_totalprice > 400000.5 AND o_orderstatus != 'F'", None, "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice > 400000.5 AND o_orderstatus <> 'F'"),
    "scan_all_rows": ("SCAN * FROM nation", None, "SELECT * FROM nation"),
    "scan_text_range": ("SCAN n_name FROM nation WHERE n_name BETWEEN 'NATION_1' AND 'NATION_2'", None, "SELECT n_name FROM nation WHERE n_name BETWEEN 'NATION_1' AND 'NATION_2'"),
    "scan_join_unindexed": ("SCAN s.s_name, c.c_name FROM supplier s, customer c WHERE s.s_nationkey = c.c_nationkey AND s.s_acctbal > 9000 AND c.c_acctbal > 9000", None, "SELECT s_name, c_name FROM supplier, customer WHERE s_nationkey = c_nationkey AND s_acctbal > 9000 AND c_acctbal > 9000"),
    # projection
    "project_expression": ("SCAN l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) FROM lineitem WHERE l_quantity > 49", ["l_orderkey", "l_linenumber", "price"], "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS price FROM lineitem WHERE l_quantity > 49"),
    "project_path": ("SELECT event_id, props.k FROM events WHERE user_id = 8", ["event_id", "k"], "SELECT event_id, props->>'$.k' AS k FROM events WHERE user_id = 8"),
    "project_text_functions": ("SCAN c_custkey, string.upper(c_name) .. '!' .. string.lower(c_mktsegment), string.len(c_name), string.sub(c_name, -3, -1), string.rep('ab', 2), string.reverse(c_mktsegment) FROM customer", ["c_custkey", "t", "n", "last", "rep", "rev"], "SELECT c_custkey, upper(c_name) || '!' || lower(c_mktsegment) AS t, CAST(strlen(c_name) AS INT) AS n, c_name[-3:] AS last, 'abab' AS rep, reverse(c_mktsegment) AS rev FROM customer"),
    "project_math_functions": ("SCAN o_orderkey, math.floor(o_totalprice), math.sqrt(o_orderkey), o_orderkey % 7, math.abs(0 - o_custkey), math.max(o_custkey, 5), 2 ^ 3 FROM orders", ["k", "f", "s", "m", "a", "g", "p"], "SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS f, sqrt(o_orderkey) AS s, o_orderkey % 7 AS m, abs(o_custkey) AS a, greatest(o_custkey, 5) AS g, 8.0::DOUBLE AS p FROM orders"),
    "project_casts": ("SCAN n_nationkey, tostring(n_regionkey), tonumber('12.5'), SHA1(n_name, 'x') FROM nation", ["k", "t", "n", "h"], "SELECT n_nationkey AS k, CAST(n_regionkey AS VARCHAR) AS t, 12.5::DOUBLE AS n, sha1(n_name || 'x') AS h FROM nation"),
    # filters
    "filter_operators": ("SCAN p_partkey FROM part WHERE p_size >= 10 AND p_size < 40 AND p_retailprice <= 1000 AND p_brand != 'Brand#2'", None, "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size < 40 AND p_retailprice <= 1000 AND p_brand <> 'Brand#2'"),
    "filter_path": ("SCAN event_id, event_type FROM events WHERE props.k = 69", None, "SELECT event_id, event_type FROM events WHERE CAST(props->>'$.k' AS INT) = 69"),
    "filter_path_between": ("SCAN event_id FROM events WHERE props.k BETWEEN 5 AND 9", None, "SELECT event_id FROM events WHERE CAST(props->>'$.k' AS INT) BETWEEN 5 AND 9"),
    "filter_expression": ("SCAN o_orderkey FROM orders WHERE (o_orderkey % 10 == 3 or o_custkey < 20) AND not (o_orderstatus == 'F')", None, "SELECT o_orderkey FROM orders WHERE (o_orderkey % 10 = 3 OR o_custkey < 20) AND NOT (o_orderstatus = 'F')"),
    "filter_in_subquery": ("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 4)", None, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 4)"),
    "filter_in_scan_subquery": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SCAN p_partkey FROM part WHERE p_retailprice > 1000.0 AND p_size = 5)", None, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_retailprice > 1000.0 AND p_size = 5)"),
    "filter_index_rank": ("SCAN n_nationkey, n_name FROM nation WHERE nation_pk.pos() BETWEEN 3 AND 8", None, "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 3"),
    # joins
    "join_two": ("SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey AND r.r_name = 'ASIA'", None, "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name = 'ASIA'"),
    "join_star": ("SELECT o.o_orderkey, l.l_linenumber, p.p_name, s.s_name FROM orders o, lineitem l, part p, supplier s WHERE o.o_orderkey = l.l_orderkey AND l.l_partkey = p.p_partkey AND l.l_suppkey = s.s_suppkey AND p.p_size < 20", None, "SELECT o_orderkey, l_linenumber, p_name, s_name FROM orders, lineitem, part, supplier WHERE o_orderkey = l_orderkey AND l_partkey = p_partkey AND l_suppkey = s_suppkey AND p_size < 20"),
    "join_chain": ("SELECT c.c_name, n.n_name, r.r_name FROM customer c, nation n, region r WHERE c.c_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey AND r.r_name != 'ASIA'", None, "SELECT c_name, n_name, r_name FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name <> 'ASIA'"),
    "join_self": ("SELECT a.n_name, b.n_name FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey = 3", None, "SELECT a.n_name AS a_n_name, b.n_name AS b_n_name FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey = 3"),
    "join_multi_key": ("SCAN a.l_orderkey, a.l_linenumber FROM lineitem a, lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_quantity = 50", ["k", "n"], "SELECT a.l_orderkey AS k, a.l_linenumber AS n FROM lineitem a, lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_quantity = 50"),
    "join_all_columns": ("SELECT * FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey AND r.r_regionkey = 2", None, "SELECT * FROM nation, region WHERE n_regionkey = r_regionkey AND r_regionkey = 2"),
    "join_order_limit": ("SELECT o.o_orderkey, c.c_name FROM orders o, customer c WHERE o.o_custkey = c.c_custkey AND c.c_nationkey = 5 ORDER BY o.o_totalprice DESC LIMIT 20 OFFSET 5", None, "SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey AND c_nationkey = 5 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5"),
    "join_count": ("SELECT COUNT(*) FROM orders o, lineitem l, customer c WHERE o.o_orderkey = l.l_orderkey AND o.o_custkey = c.c_custkey AND c.c_mktsegment = 'BUILDING'", None, "SELECT count(*) AS count FROM orders, lineitem, customer WHERE o_orderkey = l_orderkey AND o_custkey = c_custkey AND c_mktsegment = 'BUILDING'"),
    # counts
    "count_range": ("SELECT COUNT(*) FROM lineitem WHERE l_partkey BETWEEN 5 AND 50", None, "SELECT count(*) AS count FROM lineitem WHERE l_partkey BETWEEN 5 AND 50"),
    "count_table": ("SCAN COUNT(*) FROM lineitem", None, "SELECT count(*) AS count FROM lineitem"),
    "count_in": ("SELECT COUNT(*) FROM orders WHERE o_custkey IN (1, 2, 3)", None, "SELECT count(*) AS count FROM orders WHERE o_custkey IN (1, 2, 3)"),
    # order
    "order_multi": ("SCAN o_orderkey FROM orders WHERE o_totalprice > 0 ORDER BY o_orderpriority, o_custkey DESC LIMIT 100", None, "SELECT o_orderkey FROM orders WHERE o_totalprice > 0 ORDER BY o_orderpriority, o_custkey DESC, o_orderkey LIMIT 100"),
    "order_expression": ("SCAN s_suppkey FROM supplier WHERE s_acctbal > 0 ORDER BY s_suppkey % 7 DESC, s_name LIMIT 20", None, "SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 ORDER BY s_suppkey % 7 DESC, s_name LIMIT 20"),
    "order_limit_offset": ("SELECT c_custkey FROM customer WHERE c_nationkey BETWEEN 0 AND 24 ORDER BY c_acctbal DESC LIMIT 10 OFFSET 30", None, "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 30"),
    "order_path": ("SCAN event_id FROM events WHERE user_id = 46 ORDER BY tonumber(props.k) DESC LIMIT 5", None, "SELECT event_id FROM events WHERE user_id = 46 ORDER BY CAST(props->>'$.k' AS INT) DESC, event_id LIMIT 5"),
}

CHANGES: dict[str, tuple[tuple[str, ...], list[str], str]] = {
    "insert_rows": (("region",), ["INSERT INTO region VALUES (5,'ATLANTIS') (6,'It''s new')", "SCAN * FROM region"], "SELECT * FROM region UNION ALL VALUES (5, 'ATLANTIS'), (6, 'It''s new')"),
    "insert_columns_auto_key": (("nation",), ["INSERT INTO nation (n_name) VALUES ('X')", "INSERT INTO nation VALUES (,'Y',1)", "SCAN * FROM nation"], "SELECT * FROM nation UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + 1, 'X', NULL UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + 2, 'Y', 1"),
    "replace_rows": (("region",), ["REPLACE INTO region VALUES (1,'THE AMERICAS') (9,'NINE')", "SCAN * FROM region"], "SELECT * FROM region WHERE r_regionkey NOT IN (1, 9) UNION ALL VALUES (1, 'THE AMERICAS'), (9, 'NINE')"),
    "insert_or_update": (("nation",), ["INSERT INTO nation VALUES (3,'A',0) (99,'B',2) ON DUPLICATE KEY UPDATE n_regionkey = n_regionkey + 10", "SCAN * FROM nation"], "SELECT n_nationkey, n_name, n_regionkey + CASE WHEN n_nationkey = 3 THEN 10 ELSE 0 END AS n_regionkey FROM nation UNION ALL VALUES (99, 'B', 2)"),
    "update_arithmetic": (("customer",), ["UPDATE customer SET c_acctbal = c_acctbal * 2, c_nationkey = c_nationkey + 1 WHERE c_mktsegment = 'BUILDING'", "SCAN c_custkey, c_acctbal, c_nationkey FROM customer"], "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey FROM customer"),
    "update_expression": (("supplier",), ["UPDATE supplier SET s_name = s_name .. '-' .. tostring(s_nationkey) WHERE s_suppkey BETWEEN 2 AND 9", "SCAN s_suppkey, s_name FROM supplier"], "SELECT s_suppkey, CASE WHEN s_suppkey BETWEEN 2 AND 9 THEN s_name || '-' || s_nationkey ELSE s_name END AS s_name FROM supplier"),
    "update_ordered": (("supplier",), ["UPDATE supplier SET s_nationkey = 99 WHERE s_suppkey >= 0 ORDER BY s_acctbal DESC LIMIT 3", "SCAN s_suppkey, s_nationkey FROM supplier"], "SELECT s_suppkey, CASE WHEN row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) <= 3 THEN 99 ELSE s_nationkey END AS s_nationkey FROM supplier"),
    "update_path": (("events",), ["UPDATE events SET props.k = 5 WHERE user_id = 8", "SCAN event_id, props.k FROM events"], "SELECT event_id, CASE WHEN user_id = 8 THEN '5' ELSE props->>'$.k' END AS \"props.k\" FROM events"),
    "delete_rows": (("orders",), ["DELETE FROM orders WHERE o_custkey BETWEEN 0 AND 200", "SCAN o_orderkey FROM orders"], "SELECT o_orderkey FROM orders WHERE NOT o_custkey BETWEEN 0 AND 200"),
    "delete_ordered": (("supplier",), ["DELETE FROM supplier WHERE s_nationkey >= 0 ORDER BY s_acctbal LIMIT 4 OFFSET 2", "SCAN s_suppkey FROM supplier"], "SELECT s_suppkey FROM supplier QUALIFY row_number() OVER (ORDER BY s_acctbal, s_suppkey) NOT BETWEEN 3 AND 6"),
    "delete_evicted": (("nation",), ["ALTER TABLE nation SET DIRTY", "EVICT nation 1 2 3", "SCAN * FROM nation"], "SELECT * FROM nation WHERE n_nationkey NOT IN (1, 2, 3)"),
    "define_table": (("region",), ["CREATE TABLE t (id INT, name TEXT, x FLOAT)", "INSERT INTO t VALUES (1,'a',2.5) (2,'b',)", "ALTER TABLE t ADD COLUMN y LONG", "UPDATE t SET y = id + 1 WHERE id = 2", "SCAN id, name, x, y FROM t"], "SELECT * FROM (VALUES (1::BIGINT, 'a', 2.5::FLOAT, NULL::DECIMAL(20,0)), (2::BIGINT, 'b', NULL, 3)) AS v(id, name, x, y)"),
    "define_dynamic_columns": (("region",), ["CREATE TABLE t (id INT, name TEXT)", "ALTER TABLE t ADD HASHABILITY", "INSERT INTO t (id, name, extra) VALUES (1,'a','more')", "SCAN id, name, extra FROM t"], "SELECT 1::BIGINT AS id, 'a' AS name, 'more' AS extra"),
    "table_from_select": (("customer",), ["CREATE TABLE rich SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 5000 AND 20000", "SCAN COUNT(*) FROM rich"], "SELECT count(*) AS count FROM customer WHERE c_acctbal BETWEEN 5000 AND 20000"),
    "table_from_join": (("nation", "region"), ["CREATE TABLE nr SELECT n.n_nationkey, n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey", "SELECT n_name, r_name FROM nr WHERE n_nationkey BETWEEN 0 AND 12"], "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND n_nationkey BETWEEN 0 AND 12"),
    "show_tables": (("region", "nation"), ["SHOW TABLES"], "SELECT * FROM (VALUES ('region'), ('nation')) AS v(\"table\")"),
    "show_indexes": (("nation",), ["CREATE UNIQUE INDEX i_name ON nation (n_name)", "SHOW INDEXES"], "SELECT * FROM (VALUES ('nation_0', 'nation', 'n_regionkey', false), ('i_name', 'nation', 'n_name', true)) AS v(\"index\", \"table\", columns, \"unique\")"),
    "describe": (("region",), ["DESC region"], "SELECT * FROM (VALUES ('r_regionkey', 'int', 'pk'), ('r_name', 'string', '')) AS v(\"column\", type, \"index\")"),
    "prepared": (("orders",), ["PREPARE p AS SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = $1", "EXECUTE p 17"], "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 17"),
    "cursor_second_page": (("orders",), ["SELECT o_orderkey FROM orders WHERE o_orderkey >= 0 ORDER BY o_totalprice LIMIT 25 OFFSET page", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 0 ORDER BY o_totalprice LIMIT 25 OFFSET page"], "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25 OFFSET 25"),
    "recency_index": (("region",), ["CREATE LRUINDEX ON region", "SCAN * FROM region"], "SELECT * FROM region"),
    "dump_script": (("nation",), ["DUMP nation TO MYSQL n2"], "SELECT 'INSERT INTO `n2` VALUES (' || n_nationkey || ',''' || n_name || ''',' || n_regionkey || ');' AS value FROM nation"),
    "dump_table": (("nation",), ["DUMP nation"], "SELECT * FROM nation"),
}


def _statement(name: str):
    text, names, _ = STATEMENTS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        if name == "filter_index_rank":
            e.sql("CREATE INDEX nation_pk ON nation (n_nationkey)")
        df = e.sql(text)
        return df.toDF(*names) if names else df

    return run


def _change(name: str):
    tables, statements, _ = CHANGES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, *tables)
        for s in statements:
            out = e.sql(s)
        return out

    return run


FUNCTIONS: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function under its name, with the SQL for its rows if there is any."""

    def add(f):
        FUNCTIONS[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statement("join_star")(spark, sf_dir)


@query("SELECT n_nationkey, n_name, CAST(row_number() OVER (ORDER BY n_name) AS INT) AS pos FROM nation")
def project_index_rank(spark, sf_dir):
    e = engine(spark, sf_dir, "nation")
    e.sql("CREATE UNIQUE INDEX i_name ON nation (n_name)")
    return e.sql("SCAN n_nationkey, n_name, i_name.pos() FROM nation").withColumnRenamed("i_name_pos", "pos")


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'O'")
def count_of_true(spark, sf_dir):
    n = engine(spark, sf_dir, "orders").count_true("SCAN o_totalprice > 300000, o_orderstatus == 'O' FROM orders")
    return spark.createDataFrame([(n,)], "n long")


@query("SELECT p_partkey, p_retailprice * 1.5 + p_size AS v FROM part WHERE p_size % 5 = 0 ORDER BY v DESC, p_partkey LIMIT 50")
def function_in_statement(spark, sf_dir):
    """A registered pandas UDF as an item, a condition and a sort key."""
    e = engine(spark, sf_dir, "part")

    @F.pandas_udf("double")
    def score(price, size):
        return price * 1.5 + size

    @F.pandas_udf("boolean")
    def fifth(size):
        return size % 5 == 0

    e.function("score", score)
    e.function("fifth", fifth)
    return e.sql("SCAN p_partkey, score(p_retailprice, p_size) FROM part WHERE fifth(p_size) ORDER BY score(p_retailprice, p_size) DESC LIMIT 50").toDF("p_partkey", "v")


@query("SELECT n_nationkey, 'DELETE' AS kind FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 77, 'INSERT'")
def row_triggers(spark, sf_dir):
    e, seen = engine(spark, sf_dir, "nation"), []
    for kind in ("INSERT", "DELETE"):
        e.trigger(kind.lower(), "nation", kind, lambda rows, k=kind: seen.append(rows.select("n_nationkey", F.lit(k).alias("kind"))))
    e.sql("INSERT INTO nation VALUES (77,'NEW',1)")
    e.sql("DELETE FROM nation WHERE n_regionkey = 2")
    return seen[0].unionByName(seen[1])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey <> 4")
def snapshot_round_trip(spark, sf_dir):
    """Tables and definitions saved as Parquet and loaded by a fresh engine."""
    e, path = engine(spark, sf_dir, "nation", "region"), session.scratch(spark, "snapshot")
    e.sql("DELETE FROM nation WHERE n_nationkey = 4")
    snapshot.save(e, path)
    other = Engine(spark)
    snapshot.load(other, path)
    return other.sql("SCAN * FROM nation")


@query("SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN 'two' ELSE r_name END AS r_name FROM region WHERE r_regionkey <> 0")
def statement_log_replay(spark, sf_dir):
    e, other = engine(spark, sf_dir, "region"), engine(spark, sf_dir, "region")
    e.sql("UPDATE region SET r_name = 'two' WHERE r_regionkey = 2")
    e.sql("DELETE FROM region WHERE r_regionkey = 0")
    snapshot.replay(other, e.log)
    return other.sql("SCAN * FROM region")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def dump_file(spark, sf_dir):
    path = session.scratch(spark, "dump")
    engine(spark, sf_dir, "nation").sql(f"DUMP nation TO FILE {path}")
    return spark.read.option("header", True).csv(path)


# -- key/value structures, over the tables -------------------------------------------------------------------------


def kv(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), F.col("c_nationkey").cast("string").alias("value"), F.lit(None).cast("timestamp").alias("expire_at"))


def lists(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("key"))
    return o.agg(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>").alias("items"))


def sets(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_custkey").cast("string").alias("member")).distinct()


def zsets(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("member"), F.col("c_acctbal").alias("score"))


def hashes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.create_map(F.lit("brand"), "p_brand", F.lit("size"), F.col("p_size").cast("string")).alias("fields"))


_LIST = "(SELECT CAST(o_custkey AS VARCHAR) AS key, list_sort(list(o_orderkey))::VARCHAR[] AS items FROM orders GROUP BY o_custkey)"
_SET = "(SELECT DISTINCT o_orderpriority AS key, CAST(o_custkey AS VARCHAR) AS member FROM orders)"
_Z = "(SELECT c_mktsegment AS key, c_name AS member, c_acctbal AS score FROM customer)"


@query("SELECT CAST(c_nationkey AS VARCHAR) AS value FROM customer WHERE c_name = 'Customer#000000007'")
def kv_get(spark, sf_dir):
    return keyvalue.get(kv(spark, sf_dir), "Customer#000000007")


@query("SELECT * FROM (VALUES ('Customer#000000003'), ('none')) AS k(key) LEFT JOIN (SELECT c_name AS key, CAST(c_nationkey AS VARCHAR) AS value FROM customer) USING (key)")
def kv_mget(spark, sf_dir):
    return keyvalue.mget(kv(spark, sf_dir), ["Customer#000000003", "none"])


@query("SELECT c_name AS key, CASE c_custkey WHEN 1 THEN 'new' WHEN 2 THEN CAST(c_nationkey + 5 AS VARCHAR) WHEN 3 THEN c_nationkey || 'tail' ELSE CAST(c_nationkey AS VARCHAR) END AS value FROM customer WHERE c_custkey <> 4 UNION ALL SELECT 'fresh', 'x'")
def kv_writes(spark, sf_dir):
    t, name = kv(spark, sf_dir), "Customer#00000000"
    t = keyvalue.put(t, spark.createDataFrame([(name + "1", "new")], "key string, value string"))
    t = keyvalue.put_new(t, spark.createDataFrame([(name + "1", "no"), ("fresh", "x")], "key string, value string"))
    t = keyvalue.append(keyvalue.incr(t, name + "2", 5), name + "3", "tail")
    return keyvalue.delete(t, [name + "4"]).select("key", "value")


@query("SELECT c_name AS key FROM customer WHERE c_name LIKE 'Customer#0000000_7%'")
def kv_keys(spark, sf_dir):
    return keyvalue.keys(kv(spark, sf_dir), "Customer#0000000?7*")


@query("SELECT c_name AS key FROM customer WHERE c_custkey <> 1")
def kv_expiry(spark, sf_dir):
    t = keyvalue.expire(kv(spark, sf_dir), "Customer#000000001", F.lit("2001-01-01").cast("timestamp"))
    return keyvalue.alive(t).select("key")


@query(f"SELECT key, array_to_string(items[2:4], ',') AS items FROM {_LIST}")
def list_range(spark, sf_dir):
    return keyvalue.lrange(lists(spark, sf_dir), 1, 3).select("key", F.array_join("items", ",").alias("items"))


@query(f"SELECT key, len(items)::INT AS length, items[1] AS first, items[len(items)] AS last FROM {_LIST}")
def list_ends(spark, sf_dir):
    t = lists(spark, sf_dir)
    return keyvalue.llen(t).join(keyvalue.lindex(t, 0).withColumnRenamed("value", "first"), "key").join(keyvalue.lindex(t, -1).withColumnRenamed("value", "last"), "key")


@query(f"SELECT key, array_to_string(CASE WHEN key = '2' THEN list_concat(['z', 'y'], items) ELSE items END, ',') AS items FROM {_LIST} UNION ALL SELECT 'new', 'a,b'")
def list_push(spark, sf_dir):
    t = keyvalue.push(lists(spark, sf_dir), "2", ["y", "z"], left=True)
    return keyvalue.push(t, "new", ["a", "b"]).select("key", F.array_join("items", ",").alias("items"))


@query(f"SELECT count(*) AS n FROM (SELECT member FROM {_SET} WHERE key IN ('5-LOW', '1-URGENT') GROUP BY member HAVING count(*) = 2)")
def set_intersection_size(spark, sf_dir):
    return keyvalue.sinter(sets(spark, sf_dir), ["5-LOW", "1-URGENT"]).agg(F.count("*").alias("n"))


@query(f"SELECT member FROM {_SET} WHERE key = '5-LOW' EXCEPT SELECT member FROM {_SET} WHERE key = '1-URGENT'")
def set_difference(spark, sf_dir):
    return keyvalue.sdiff(sets(spark, sf_dir), "5-LOW", ["1-URGENT"])


@query(f"SELECT member FROM {_SET} WHERE key = '5-LOW' UNION SELECT member FROM {_SET} WHERE key = '1-URGENT'")
def set_union(spark, sf_dir):
    return keyvalue.sunion(sets(spark, sf_dir), ["5-LOW", "1-URGENT"])


@query(f"SELECT key, count(*) AS card FROM {_SET} GROUP BY key")
def set_sizes(spark, sf_dir):
    return keyvalue.scard(sets(spark, sf_dir))


@query(f"SELECT key, member, CAST(row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS INT) AS rank FROM {_Z}")
def zset_rank(spark, sf_dir):
    return keyvalue.zrank(zsets(spark, sf_dir)).select("key", "member", "rank")


@query(f"SELECT member, score FROM {_Z} WHERE key = 'BUILDING' ORDER BY score DESC, member DESC LIMIT 6 OFFSET 2")
def zset_reverse_range(spark, sf_dir):
    return keyvalue.zrange(zsets(spark, sf_dir), "BUILDING", 2, 7, descending=True)


@query(f"SELECT member, score FROM {_Z} WHERE key = 'BUILDING' AND score > 100 AND score <= 5000 ORDER BY score, member LIMIT 5 OFFSET 1")
def zset_score_range(spark, sf_dir):
    return keyvalue.zrangebyscore(zsets(spark, sf_dir), "BUILDING", "(100", "5000", offset=1, limit=5)


@query(f"SELECT key, count(*) AS n FROM {_Z} WHERE score >= 0 GROUP BY key")
def zset_count(spark, sf_dir):
    return keyvalue.zcount(zsets(spark, sf_dir), "0", "inf")


@query("SELECT CAST(c_nationkey AS VARCHAR) AS member, max(CASE c_mktsegment WHEN 'BUILDING' THEN 2 ELSE 3 END * floor(c_acctbal)) AS score FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY c_nationkey")
def zset_weighted_union(spark, sf_dir):
    z = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("key"), F.col("c_nationkey").cast("string").alias("member")).agg(F.max(F.floor("c_acctbal").cast("double")).alias("score"))
    return keyvalue.zalgebra(z, ["BUILDING", "MACHINERY"], [2, 3], "MAX")


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, 'brand' AS field, p_brand AS value FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'size', CAST(CASE p_partkey WHEN 3 THEN p_size + 4 ELSE p_size END AS VARCHAR) FROM part WHERE p_partkey <> 5 UNION ALL SELECT '9', 'colour', 'red'")
def hash_writes(spark, sf_dir):
    t = keyvalue.hset(hashes(spark, sf_dir), "9", {"colour": "red"})
    t = keyvalue.hdel(keyvalue.hincrby(t, "3", "size", 4), "5", "size")
    return keyvalue.hgetall(t)


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, p_brand AS value FROM part")
def hash_get(spark, sf_dir):
    return keyvalue.hget(hashes(spark, sf_dir), "brand")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS value, n_name AS get_0 FROM nation ORDER BY n_regionkey, CAST(n_nationkey AS VARCHAR) LIMIT 10")
def sort_by_external_keys(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    items = n.select(F.col("n_nationkey").alias("pos"), F.col("n_nationkey").cast("string").alias("value"))
    outer = n.select(F.concat(F.lit("w_"), "n_nationkey").alias("key"), F.col("n_regionkey").cast("string").alias("value")).unionByName(n.select(F.concat(F.lit("o_"), "n_nationkey").alias("key"), F.col("n_name").alias("value")))
    return keyvalue.sort(items, outer, by="w_*", get_patterns=["o_*"], limit=10)


@query("SELECT CAST(o_custkey AS VARCHAR) AS key, CAST(o_orderkey AS VARCHAR) AS value, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS pk FROM orders")
def table_from_list(spark, sf_dir):
    return keyvalue.to_rows(lists(spark, sf_dir))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS key, n_name AS member FROM nation")
def select_into_set(spark, sf_dir):
    rows = engine(spark, sf_dir, "nation").sql("SCAN n_regionkey, n_name FROM nation")
    return keyvalue.from_rows(rows, F.col("n_regionkey").cast("string"), F.col("n_name"), "set")


# -- graphs ---------------------------------------------------------------------------------------------------------


def tree(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("src"), F.floor(F.col("c_custkey") / 3).cast("long").alias("dst"), F.lit("UP").alias("rtype"))


def ladder(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation").where("n_nationkey > 0").select(F.col("n_nationkey").cast("long").alias("src"))
    far = n.select("src", F.floor(F.col("src") / 3).cast("long").alias("dst"), F.lit("JUMP").alias("rtype"), F.lit(2.5).alias("weight"))
    return far.unionByName(n.select("src", (F.col("src") - 1).alias("dst"), F.lit("STEP").alias("rtype"), F.lit(1.0).alias("weight")))


_TREE = "WITH RECURSIVE e AS (SELECT c_custkey AS src, c_custkey // 3 AS dst FROM customer WHERE c_custkey > 0), w(id, depth, path) AS (SELECT 0::BIGINT, 1, '0' UNION ALL SELECT e.src, w.depth + 1, w.path || '<-[UP]-' || e.src FROM w JOIN e ON e.dst = w.id)"


@query(f"{_TREE} SELECT * FROM w WHERE depth >= 2")
def graph_breadth_first(spark, sf_dir):
    return graph.bfs(tree(spark, sf_dir), 0, expander="INCOMING", min_depth=2)


@query(f"{_TREE} SELECT * FROM w")
def graph_depth_first(spark, sf_dir):
    return graph.dfs(tree(spark, sf_dir), 0, expander="INCOMING").select("id", "depth", "path")


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS src, n_nationkey // 3 AS dst, 2.5 AS w FROM nation WHERE n_nationkey > 0 UNION ALL SELECT n_nationkey, n_nationkey - 1, 1.0 FROM nation WHERE n_nationkey > 0), p(id, cost) AS (SELECT 24, 0.0::DOUBLE UNION ALL SELECT e.dst, p.cost + e.w FROM p JOIN e ON e.src = p.id) SELECT 0::BIGINT AS id, min(cost) AS cost FROM p WHERE id = 0")
def graph_shortest_path(spark, sf_dir):
    return graph.shortest_path(ladder(spark, sf_dir), 24, 0).select("id", "cost")


@query("WITH e AS (SELECT n_nationkey AS s, n_nationkey // 3 AS d FROM nation WHERE n_nationkey > 0 UNION SELECT n_nationkey, n_nationkey - 1 FROM nation WHERE n_nationkey > 0) SELECT DISTINCT a.s::BIGINT AS id, b.d::BIGINT AS fof FROM e a JOIN e b ON a.d = b.s WHERE a.s <> b.d AND NOT EXISTS (SELECT 1 FROM e WHERE e.s = a.s AND e.d = b.d)")
def graph_friends_of_friends(spark, sf_dir):
    return graph.friends_of_friends(ladder(spark, sf_dir).withColumn("rtype", F.lit("K")), "K")


# -- streams --------------------------------------------------------------------------------------------------------


@query("SELECT CAST(user_id AS VARCHAR) AS key, time_bucket(INTERVAL 5 SECONDS, ts) AS bucket, count(*) AS hits, max(ts) AS last FROM events GROUP BY ALL")
def access_recency(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "ts")
    return feeds.recency(log).select("key", F.col("window.start").alias("bucket"), "hits", "last")


@query("SELECT event_id, event_type AS channel FROM events WHERE event_type = 'click' OR event_type LIKE 'e%'")
def channel_subscription(spark, sf_dir):
    """The events as a stream of messages: read, filtered by channel and glob, and written by a streaming query."""
    static = table(spark, sf_dir, "events")
    out, mark = session.scratch(spark, "feed"), session.scratch(spark, "feed-state")
    path = f"{sf_dir}/events.parquet"
    # A stream reads folders; a table of one file is found in its folder by name.
    source = (path, "*") if session.is_folder(spark, path) else (sf_dir, "events.parquet")
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", source[1]).parquet(source[0])
    hits = feeds.subscribe(stream.select("event_id", F.col("event_type").alias("channel")), ["click"], ["e*"])
    hits.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(hits.schema).parquet(out)


from . import catalogue_commands, catalogue_more  # noqa: E402  they use the helpers above

STATEMENTS |= catalogue_more.STATEMENTS
CHANGES |= catalogue_more.CHANGES
catalogue_commands.register()

QUERIES: dict = {n: _statement(n) for n in STATEMENTS} | {n: _change(n) for n in CHANGES} | FUNCTIONS
ORACLE_SQL: dict[str, str] = {n: x[2] for n, x in STATEMENTS.items()} | {n: x[2] for n, x in CHANGES.items()} | SQL
