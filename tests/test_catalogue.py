"""Every registered query with SQL against DuckDB on the same tables."""

import datetime
import math
from decimal import Decimal

import duckdb
import pytest

from lodestone.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def cell(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return str(x)
    if isinstance(x, (int, float, Decimal)):
        return f"{float(x):.9g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    sql = duck.execute(catalogue.ORACLE_SQL[name])
    want = rows([d[0] for d in sql.description], sql.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert not math.isnan(len(got[1]))
