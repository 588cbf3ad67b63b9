"""The key/value commands by name, over structures made of the whole tables: each query gives the replies, in order.

``COMMANDS``: name -> (commands, SQL for their replies). A reply that is a table or a list gives its values as one text, sorted if
the command promises no order (``sorted:`` before its name).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.commands import Keyspace
from ..sources import session
from . import catalogue as base

C3, C4, NONE = "Customer#000000003", "Customer#000000004", "none"
#: Values by name, as SQL.
_V = "(SELECT CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_name = '{}')"
V3, V4 = _V.format(C3), _V.format(C4)
_L = "(SELECT list_sort(list(o_orderkey))::VARCHAR[] FROM orders WHERE o_custkey = 1)"
_N = f"(SELECT len({_L}))"
_S = "(SELECT DISTINCT o_orderpriority AS key, CAST(o_custkey AS VARCHAR) AS member FROM orders)"
_U, _W = f"(SELECT member FROM {_S} WHERE key = '1-URGENT')", f"(SELECT member FROM {_S} WHERE key = '5-LOW')"
_B = "(SELECT c_name AS member, c_acctbal AS score FROM customer WHERE c_mktsegment = 'BUILDING')"
_ZB = f"(SELECT count(*) FROM {_B})"
_FIRST = f"(SELECT member FROM {_B} ORDER BY score, member LIMIT 1)"
_KEYS = "((SELECT count(*) FROM customer) + (SELECT count(DISTINCT o_custkey) FROM orders) + (SELECT count(DISTINCT o_orderpriority) FROM orders) + (SELECT count(DISTINCT c_mktsegment) FROM customer) + (SELECT count(*) FROM part))"


def keyspace(spark, sf_dir, path: str | None = None) -> Keyspace:
    """Strings by customer, lists ``l:`` by customer, sets by priority, sorted sets by segment, hashes ``h:`` by part."""
    lists = base.lists(spark, sf_dir).withColumn("key", F.concat(F.lit("l:"), "key"))
    hashes = base.hashes(spark, sf_dir).withColumn("key", F.concat(F.lit("h:"), "key"))
    tables = {"string": base.kv(spark, sf_dir), "list": lists, "set": base.sets(spark, sf_dir), "zset": base.zsets(spark, sf_dir), "hash": hashes}
    return Keyspace(spark, tables, path)


def _text(reply, in_order: bool) -> str | None:
    if hasattr(reply, "collect"):
        reply = [",".join(_text(x, True) or "" for x in r) for r in reply.collect()]
    if isinstance(reply, (list, tuple)):
        some = [_text(x, True) or "" for x in reply]
        return ",".join(some if in_order else sorted(some))
    if isinstance(reply, float) and reply == int(reply):
        return str(int(reply))
    return None if reply is None else str(reply)


def _sql(replies: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS n, CAST({x} AS VARCHAR) AS reply" for i, x in enumerate(replies))


def _words(text: str) -> list[str]:
    return [w.replace("~", " ") for w in text.split()]


#: Commands, one a line ("~" is a blank within a word), with the SQL of the reply after " => ".
COMMANDS: dict[str, str] = {
    "cmd_set_get": f"SET fresh x => 'OK'\nGET fresh => 'x'\nGET {NONE} => NULL\nGET {C3} => {V3}\nGETSET {C3} new => {V3}\nGET {C3} => 'new'",
    "cmd_setnx": f"SETNX {C3} no => 0\nSETNX fresh yes => 1\nGET fresh => 'yes'\nGET {C3} => {V3}",
    "cmd_setex_ttl_persist": f"SETEX {C3} 100 v => 'OK'\nwithin:TTL {C3} => 100\nPERSIST {C3} => 1\nPERSIST {C3} => 0\nTTL {C3} => -1\nGET {C3} => 'v'\nTTL {NONE} => -1",
    "cmd_append_strlen": f"APPEND {C3} tail => (length({V3}) + 4)\nSTRLEN {C3} => (length({V3}) + 4)\nAPPEND fresh é => 2\nSTRLEN {NONE} => 0\nGET {C3} => {V3} || 'tail'",
    "cmd_del_exists": f"EXISTS {C3} => 1\nDEL {C3} {NONE} l:1 => 2\nEXISTS {C3} => 0\nEXISTS l:1 => 0",
    "cmd_bits": "SET b A => 'OK'\nGETBIT b 1 => 1\nGETBIT b 2 => 0\nSETBIT b 6 1 => 0\nGET b => 'C'\nSETBIT b 6 0 => 1\nSETBIT b 18 1 => 0\nSTRLEN b => 3\nGETBIT b 18 => 1\nGETBIT b 900 => 0\nSETBIT grown 9 1 => 0\nSTRLEN grown => 2",
    "cmd_ranges": "SET t This~is~text => 'OK'\nGETRANGE t 0 3 => 'This'\nGETRANGE t -4 -1 => 'text'\nGETRANGE t 5 100 => 'is text'\nGETRANGE t 4 2 => ''\nGETRANGE t 0 -100 => 'T'\nSUBSTR t 5 6 => 'is'\nSETRANGE t 8 more => 12\nGET t => 'This is more'\nSETRANGE gap 3 x => 4\nSTRLEN gap => 4\nSETRANGE t 2 é => 12",
    "cmd_counters": f"INCR {C3} => ({V3}::INT + 1)\nDECR {C3} => {V3}\nINCRBY {C3} 40 => ({V3}::INT + 40)\nDECRBY {C3} 50 => ({V3}::INT - 10)\nINCR fresh => 1\nSET big 9223372036854775806 => 'OK'\nINCR big => 9223372036854775807",
    "cmd_many": f"MSET a 1 b 2 a 3 => 'OK'\nMGET b a {NONE} {C4} => '2,3,,' || {V4}\nMSETNX c 1 a 9 => 0\nEXISTS c => 0\nMSETNX c 1 d 2 => 1\nMGET c d => '1,2'",
    "cmd_push_pop": f"RPUSH l:1 x y => ({_N} + 2)\nLPUSH l:1 p q => ({_N} + 4)\nLINDEX l:1 0 => 'q'\nRPOP l:1 => 'y'\nLPOP l:1 => 'q'\nLLEN l:1 => ({_N} + 2)\nRPUSHX {NONE} x => 0\nLPUSHX l:1 z => ({_N} + 3)\nRPUSHX l:1 z => ({_N} + 4)\nLPOP {NONE} => NULL\nLLEN {NONE} => 0",
    "cmd_list_places": f"LINDEX l:1 -1 => {_L}[{_N}]\nLINDEX l:1 9999 => NULL\nLRANGE l:1 0 1 => array_to_string({_L}[1:2], ',')\nLRANGE l:1 5000 6000 => ''\nLSET l:1 0 first => 'OK'\nLINDEX l:1 0 => 'first'\nLINSERT l:1 BEFORE first zero => ({_N} + 1)\nLINSERT l:1 AFTER first one => ({_N} + 2)\nLRANGE l:1 0 2 => 'zero,first,one'\nLINSERT l:1 BEFORE missing x => -1\nLINSERT {NONE} BEFORE a b => 0",
    "cmd_list_trims": "RPUSH t a b a c a => 5\nLREM t 1 a => 1\nLRANGE t 0 -1 => 'b,a,c,a'\nLREM t -1 a => 1\nLRANGE t 0 -1 => 'b,a,c'\nLREM t 0 a => 1\nLTRIM t 1 -1 => 'OK'\nLRANGE t 0 -1 => 'c'\nLTRIM t 5 9 => 'OK'\nEXISTS t => 0",
    "cmd_list_moves": f"RPOPLPUSH l:1 moved => {_L}[{_N}]\nLRANGE moved 0 -1 => {_L}[{_N}]\nRPOPLPUSH {NONE} moved => NULL\nBRPOPLPUSH l:1 moved 1 => {_L}[{_N} - 1]\nLLEN moved => 2\nBLPOP {NONE} moved 1 => 'moved,' || {_L}[{_N} - 1]\nBRPOP moved {NONE} 1 => 'moved,' || {_L}[{_N}]\nBLPOP {NONE} moved 1 => NULL",
    "cmd_set_members": f"SADD 1-URGENT x y x => 2\nSADD 1-URGENT x => 0\nSCARD 1-URGENT => ((SELECT count(*) FROM {_U}) + 2)\nSISMEMBER 1-URGENT x => 1\nSISMEMBER 1-URGENT none => 0\nSREM 1-URGENT x none => 1\nSMOVE 1-URGENT 5-LOW y => 1\nSMOVE 1-URGENT 5-LOW none => 0\nSCARD 5-LOW => ((SELECT count(*) FROM {_W}) + 1)\nSCARD {NONE} => 0",
    "cmd_set_reads": f"sorted:SMEMBERS 5-LOW => (SELECT string_agg(member, ',' ORDER BY member) FROM {_W})\nsorted:SINTER 1-URGENT 5-LOW => (SELECT string_agg(member, ',' ORDER BY member) FROM (SELECT * FROM {_U} INTERSECT SELECT * FROM {_W}))\nSINTER 1-URGENT {NONE} => ''\nsorted:SDIFF 1-URGENT 5-LOW => (SELECT coalesce(string_agg(member, ',' ORDER BY member), '') FROM (SELECT * FROM {_U} EXCEPT SELECT * FROM {_W}))\nSDIFF {NONE} 5-LOW => ''",
    "cmd_set_stores": f"SINTERSTORE both 1-URGENT 5-LOW => (SELECT count(*) FROM (SELECT * FROM {_U} INTERSECT SELECT * FROM {_W}))\nSUNIONSTORE any 1-URGENT 5-LOW => (SELECT count(*) FROM (SELECT * FROM {_U} UNION SELECT * FROM {_W}))\nSDIFFSTORE only 1-URGENT 5-LOW => (SELECT count(*) FROM (SELECT * FROM {_U} EXCEPT SELECT * FROM {_W}))\nSCARD any => (SELECT count(*) FROM (SELECT * FROM {_U} UNION SELECT * FROM {_W}))\nSINTERSTORE any 1-URGENT {NONE} => 0\nEXISTS any => 0",
    "cmd_set_random": f"SADD one only => 1\nSRANDMEMBER one => 'only'\nSCARD one => 1\nSPOP one => 'only'\nEXISTS one => 0\nSPOP {NONE} => NULL",
    "cmd_zset_writes": f"ZADD z 1 a 2 b 3 a => 2\nZSCORE z a => 3\nZADD z 5 a 1 c => 1\nZINCRBY z 2.5 c => 3.5\nZINCRBY z 1 d => 1\nZCARD z => 4\nZREM z d none => 1\nZCARD BUILDING => {_ZB}\nZSCORE z none => NULL",
    "cmd_zset_ranks": f"ZRANK BUILDING {NONE} => NULL\nZADD BUILDING -99999 low 99999 high => 2\nZRANK BUILDING low => 0\nZRANK BUILDING high => ({_ZB} + 1)\nZREVRANK BUILDING high => 0\nZREVRANK BUILDING low => ({_ZB} + 1)\nZCOUNT BUILDING (-99999 +inf => ({_ZB} + 1)\nZCOUNT BUILDING 0 100 => (SELECT count(*) FROM {_B} WHERE score BETWEEN 0 AND 100)",
    "cmd_zset_ranges": "ZADD z 1 a 2 b 2 c 4 d => 4\nZRANGE z 0 1 => 'a,b'\nZRANGE z -2 -1 WITHSCORES => 'c,2,d,4'\nZREVRANGE z 0 1 => 'd,c'\nZRANGEBYSCORE z (1 4 => 'b,c,d'\nZRANGEBYSCORE z -inf +inf LIMIT 1 2 => 'b,c'\nZREVRANGEBYSCORE z 2 1 WITHSCORES => 'c,2,b,2,a,1'",
    "cmd_zset_removes": f"ZREMRANGEBYSCORE BUILDING 0 +inf => (SELECT count(*) FROM {_B} WHERE score >= 0)\nZCARD BUILDING => (SELECT count(*) FROM {_B} WHERE score < 0)\nZADD z 1 a 2 b 3 c => 3\nZREMRANGEBYRANK z 0 1 => 2\nZRANGE z 0 -1 => 'c'",
    "cmd_zset_algebra": f"ZADD p 1 a 2 b => 2\nZADD q 10 b 20 c => 2\nSADD s b => 1\nZUNIONSTORE u 2 p q WEIGHTS 2 1 => 3\nZRANGE u 0 -1 WITHSCORES => 'a,2,b,14,c,20'\nZINTERSTORE i 3 p q s AGGREGATE MAX => 1\nZRANGE i 0 -1 WITHSCORES => 'b,10'\nZUNIONSTORE t 2 p p => 2\nZSCORE t b => 4\nZINTERSTORE u 2 p {NONE} => 0\nEXISTS u => 0",
    "cmd_hash_writes": "HSET h:1 colour red => 1\nHSET h:1 colour blue => 0\nHSETNX h:1 colour green => 0\nHSETNX h:1 shape round => 1\nHGET h:1 colour => 'blue'\nHMSET new a 1 b 2 => 'OK'\nHMGET new b none a => '2,,1'\nHLEN h:1 => 4\nHDEL h:1 shape none => 1\nHEXISTS h:1 shape => 0\nHEXISTS h:1 brand => 1\nHINCRBY new a 5 => 6\nHINCRBY fresh n -3 => -3\nHDEL fresh n => 1\nEXISTS fresh => 0",
    "cmd_hash_reads": f"sorted:HKEYS h:2 => 'brand,size'\nsorted:HVALS h:2 => (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT p_brand AS v FROM part WHERE p_partkey = 2 UNION ALL SELECT CAST(p_size AS VARCHAR) FROM part WHERE p_partkey = 2))\nsorted:HGETALL h:2 => (SELECT 'brand,' || p_brand || ',size,' || p_size FROM part WHERE p_partkey = 2)\nHGET {NONE} x => NULL\nHLEN {NONE} => 0",
    "cmd_keys": f"DBSIZE => {_KEYS}\nsorted:KEYS Customer#0000000[12]? => NULL\nTYPE {C3} => 'string'\nTYPE l:1 => 'list'\nTYPE 5-LOW => 'set'\nTYPE BUILDING => 'zset'\nTYPE h:1 => 'hash'\nTYPE {NONE} => 'none'",
    "cmd_rename": f"RENAME l:1 list => 'OK'\nEXISTS l:1 => 0\nLLEN list => {_N}\nRENAMENX {C3} {C4} => 0\nRENAMENX {C3} third => 1\nGET third => {V3}\nRENAME third {C4} => 'OK'\nGET {C4} => {V3}",
    "cmd_expire": f"EXPIRE {C3} 50 => 1\nwithin:TTL {C3} => 50\nEXPIRE {NONE} 5 => 0\nEXPIRE {C4} -1 => 1\nEXISTS {C4} => 0\nEXPIREAT l:1 1000 => 1\nEXISTS l:1 => 0\nEXPIREAT 5-LOW 99999999999 => 1\nSCARD 5-LOW => (SELECT count(*) FROM {_W})\nSET {C3} x => 'OK'\nTTL {C3} => -1",
    "cmd_databases": f"MOVE {C3} 1 => 1\nEXISTS {C3} => 0\nSELECT 1 => 'OK'\nGET {C3} => {V3}\nDBSIZE => 1\nSELECT 0 => 'OK'\nMOVE {NONE} 1 => 0\nFLUSHDB => 'OK'\nDBSIZE => 0\nSELECT 1 => 'OK'\nDBSIZE => 1\nFLUSHALL => 'OK'\nDBSIZE => 0",
    "cmd_transactions": f"MULTI => 'OK'\nSET a 1 => 'QUEUED'\nINCR a => 'QUEUED'\nEXEC => 'OK,2'\nWATCH a => 'OK'\nSET a 9 => 'OK'\nMULTI => 'OK'\nSET a 100 => 'QUEUED'\nEXEC => NULL\nGET a => '9'\nMULTI => 'OK'\nSET a 5 => 'QUEUED'\nDISCARD => 'OK'\nWATCH a => 'OK'\nSET a 7 => 'OK'\nUNWATCH => 'OK'\nMULTI => 'OK'\nGET a => 'QUEUED'\nEXEC => '7'",
    "cmd_sort": "RPUSH n 3 1 2 => 3\nMSET w_1 30 w_2 20 w_3 10 o_1 a o_3 c => 'OK'\nSORT n => '1,2,3'\nSORT n DESC LIMIT 0 2 => '3,2'\nSORT n BY w_* => '3,2,1'\nSORT n BY w_* GET o_* GET # => '3,c,3,2,,2,1,a,1'\nSORT n BY nosort => '3,1,2'\nSORT n ALPHA STORE out => 3\nLRANGE out 0 -1 => '1,2,3'\nSORT n BY w_* GET o_* STORE out => 3\nLRANGE out 0 -1 => 'c,,a'\nSADD s 10 9 => 2\nSORT s => '9,10'",
    "cmd_server": "PING => 'PONG'\nECHO hi => 'hi'\nCONFIG SET timeout 5 => 'OK'\nCONFIG GET time* => 'timeout,5'\nAUTH any => 'OK'\nCLIENT LIST => 'driver'\nLASTSAVE => 0\nOBJECT refcount l:1 => 1\nOBJECT encoding l:1 => 'array'\nOBJECT idletime h:1 => 0\nDEBUG OBJECT h:1 => 'map'\nSHUTDOWN => 'OK'",
}


def _commands(name: str):
    def run(spark, sf_dir):
        k, out = keyspace(spark, sf_dir), []
        for line in COMMANDS[name].split("\n"):
            words = _words(line.partition(" => ")[0])
            how, _, command = words[0].rpartition(":")
            reply = k.execute(command, *words[1:])
            if how == "within":  # seconds left, some of which have passed
                reply = -(-reply // 50) * 50
            out.append(_text(reply, how != "sorted"))
        return spark.createDataFrame(list(enumerate(out)), "n int, reply string")

    return run


def register() -> None:
    COMMANDS["cmd_keys"] = COMMANDS["cmd_keys"].replace("[12]? => NULL", "[12]? => (SELECT string_agg(c_name, ',' ORDER BY c_name) FROM customer WHERE regexp_full_match(c_name, 'Customer#0000000[12].'))")
    for name, lines in COMMANDS.items():
        base.FUNCTIONS[name] = _commands(name)
        base.SQL[name] = _sql([line.partition(" => ")[2] for line in lines.split("\n")])


def _replies(spark, got: list):
    return spark.createDataFrame([(i, _text(x, True)) for i, x in enumerate(got)], "n int, reply string")


@base.query(_sql(["1", "2", "2", "0", "3", "'news:a,news:b,sport:c,news:a'", "0"]))
def cmd_channels(spark, sf_dir):
    k, seen = keyspace(spark, sf_dir), []
    note = lambda channel, message: seen.append(f"{channel}:{message}")
    got = [k.execute("SUBSCRIBE", "news", note), k.execute("PSUBSCRIBE", "s*", note)]
    got += [k.execute("PUBLISH", "news", "a") + k.execute("PUBLISH", "news", "b"), k.execute("PUBLISH", "none", "x")]
    k.execute("PUBLISH", "sport", "c")
    k.execute("PSUBSCRIBE", "n?ws", lambda c, m: None)
    got.append(k.execute("PUBLISH", "news", "a") + k.execute("UNSUBSCRIBE", "news") - 1)
    k.execute("PUNSUBSCRIBE")
    return _replies(spark, [*got, seen, k.execute("PUBLISH", "sport", "d")])


@base.query(_sql(["'OK'", V3, f"array_to_string({_L}, ',')", "'OK'", f"array_to_string({_L}, ',')", "0", "'NOKEY'", "NULL", "'refused'", "'refused'"]))
def cmd_one_value(spark, sf_dir):
    """One value written out, restored under another key and moved to another keyspace."""
    k, other = keyspace(spark, sf_dir), Keyspace(spark)
    got = [k.execute("RESTORE", "copy", 0, k.execute("CDUMP", C3)), k.execute("GET", "copy")]
    k.execute("RESTORE", "copy2", 0, k.execute("CDUMP", "l:1"))
    got += [k.execute("LRANGE", "copy2", 0, -1), k.execute("MIGRATE", other, "copy2"), other.execute("LRANGE", "copy2", 0, -1), k.execute("EXISTS", "copy2"), k.execute("MIGRATE", other, NONE), k.execute("CDUMP", NONE)]
    for command in (("RESTORE", "copy", 0, "{}"), ("SYNC",)):
        try:
            got.append(k.execute(*command))
        except ValueError:
            got.append("refused")
    return _replies(spark, got)


@base.query(_sql(["'OK'", "'OK'", "'True'", "'OK'", "1", "(SELECT count(*) FROM customer) + 1", "'True'"]))
def cmd_saves(spark, sf_dir):
    k = keyspace(spark, sf_dir, session.scratch(spark, "keyspace"))
    k.execute("SET", "fresh", "x")
    got = [k.execute("SAVE"), k.execute("BGSAVE"), k.execute("LASTSAVE") > 0, k.execute("BGREWRITEAOF")]
    got.append(len(k.execute("MONITOR")))
    got.append(spark.read.parquet(f"{k.path}/{k.writes}/0/string").count())
    return _replies(spark, [*got, k.execute("INFO")["writes"] == 1])


@base.query("SELECT * FROM (VALUES (0, 'refused'), (1, 'refused'), (2, 'refused'), (3, 'refused'), (4, 'refused'), (5, 'refused'), (6, 'refused'), (7, 'refused'), (8, 'refused')) AS v(n, reply)")
def cmd_refusals(spark, sf_dir):
    """Commands that must fail: other types, numbers that are none, keys that are missing, unknown names."""
    k, got = keyspace(spark, sf_dir), []
    k.execute("MSET", "big", 2**63 - 1, "word", "x")
    for c in (("GET", "l:1"), ("LPUSH", C3, "x"), ("INCR", "big"), ("INCR", "word"), ("RENAME", NONE, "x"), ("RENAME", C3, C3), ("LSET", "l:1", 99999, "x"), ("ZADD", "z", "nan", "a"), ("NOSUCH",)):
        try:
            got.append(k.execute(*c))
        except Exception:
            got.append("refused")
    return _replies(spark, got)


@base.query("SELECT key, pk, field, value FROM (SELECT 'h:' || p_partkey AS key, 0 AS pk, 'brand' AS field, p_brand AS value FROM part UNION ALL SELECT 'h:' || p_partkey, 1, 'size', CAST(p_size AS VARCHAR) FROM part)")
def table_from_hashes(spark, sf_dir):
    from ..operators import keyvalue

    return keyvalue.to_rows(base.hashes(spark, sf_dir).withColumn("key", F.concat(F.lit("h:"), "key")))


@base.query("SELECT c_mktsegment AS key, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_name) - 1 AS INT) AS pk, c_name AS value, c_acctbal AS score FROM customer")
def table_from_sorted_sets(spark, sf_dir):
    from ..operators import keyvalue

    return keyvalue.to_rows(base.zsets(spark, sf_dir))


@base.query(f"SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY member) - 1 AS INT) AS pk, member AS value FROM {_S}")
def table_from_sets(spark, sf_dir):
    from ..operators import keyvalue

    return keyvalue.to_rows(base.sets(spark, sf_dir))


@base.query(f"SELECT CAST(row_number() OVER (ORDER BY ord) - 1 AS BIGINT) AS pk, value FROM (SELECT unnest({_L}) AS value, unnest(range({_N})) AS ord)")
def table_from_reply(spark, sf_dir):
    """The reply of a command made a table and read by a statement."""
    from ..operators import keyvalue
    from .engine import Engine

    reply = [r.value for r in keyspace(spark, sf_dir).execute("LRANGE", "l:1", 0, -1).collect()]
    e = Engine(spark)
    e.register("reply", keyvalue.from_reply(spark, reply))
    return e.sql("SCAN pk, value FROM reply")
