"""The dialect where no table of the test data leads: empty tables, ranks over many partitions, strict mode, odd literals."""

import pytest

from lodestone.operators import ordering
from lodestone.plans.engine import DialectError, Engine, conjuncts
from lodestone.sources import rows


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.sql("CREATE TABLE t (id INT, name TEXT, x FLOAT)")
    return e


def test_ranks_over_partitions(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as k", "id % 3 as v").repartition(13)
    got = ordering.with_rank(df, ["v", "k"], "place", first=0).collect()
    assert len(got) == 1000 and [r.place for r in sorted(got, key=lambda r: (r.v, r.k))] == list(range(1000))
    assert ordering.with_rank(df.limit(0), ["k"], "place").count() == 0


def test_statements_on_an_empty_table(engine):
    assert engine.sql("SCAN * FROM t").count() == 0 and engine.sql("SCAN COUNT(*) FROM t").first()[0] == 0
    assert engine.sql("UPDATE t SET x = x + 1 WHERE id = 3") == 0 and engine.sql("DELETE FROM t WHERE name = 'a' or id < 4") == 0
    assert engine.sql("SELECT id FROM t WHERE id IN (SELECT id FROM t WHERE id > 0)").count() == 0
    assert rows.header(engine.sql("SCAN * FROM t")) is None


def test_literals_and_quotes(engine):
    engine.sql("INSERT INTO t VALUES (1,'a AND b',1.5) (2,'or (x','') (3,'it''s, \"so\"',)")
    assert [r.name for r in engine.sql("SCAN name FROM t ORDER BY id").collect()] == ["a AND b", "or (x", 'it\'s, "so"']
    assert engine.sql("SELECT id FROM t WHERE name = 'a AND b' AND id = 1").count() == 1
    assert engine.sql("SELECT id FROM t WHERE name = 'it''s, \"so\"'").first().id == 3
    assert engine.sql("SELECT id FROM t WHERE name = 'or (x' AND x is null").count() == 1


def test_conditions_are_cut_at_and_only():
    assert conjuncts("a = 1 AND b BETWEEN 2 AND 3 AND c IN (1, 2)") == ["a = 1", "b BETWEEN 2 AND 3", "c IN (1, 2)"]
    assert conjuncts("a = 1 or b = 2 and c = 3") == ["a = 1 or b = 2 and c = 3"]
    assert conjuncts("(a = 1 or b = 2) AND name = 'x OR y'") == ["(a = 1 or b = 2)", "name = 'x OR y'"]
    assert conjuncts("") == []


def test_strict_mode_and_errors(spark, engine):
    strict = Engine(spark, strict=True)
    strict.register("n", spark.range(5).selectExpr("id", "id % 2 as odd"))
    assert strict.sql("SELECT odd FROM n WHERE id = 3").first().odd == 1
    for bad in ("SELECT id FROM n WHERE odd = 1", "SELECT id FROM n", "SCAN id FROM none", "FETCH n", "SCAN COUNT(*) FROM n ORDER BY id", "SELECT a.id FROM n a, n b WHERE a.id = 1"):
        with pytest.raises(DialectError):
            strict.sql(bad)
    assert strict.sql("SCAN id FROM n WHERE odd = 1").count() == 2
    for bad in ("SELECT a.id FROM n a, n b WHERE a.id = b.id AND odd = 1", "SELECT a.id FROM n a, n b WHERE a.id = b.none", "SELECT n.id FROM n, n WHERE n.id = n.id"):
        with pytest.raises(DialectError):
            strict.sql(bad)
    for bad in ("EXECUTE none 1", "EVICT t 1", "CREATE TABLE t (id INT, y INT)", "LUAFUNC none", "DROP INDEX none", "UPDATE t SET none = 1 WHERE id = 1"):
        with pytest.raises(DialectError):
            engine.sql(bad)
