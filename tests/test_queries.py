"""Every registered query of the core against its DuckDB SQL at the smallest scale."""

import datetime
import decimal

import duckdb
import pytest

from strataq.plans import queries as core

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (decimal.Decimal, bool, int)):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return "NULL" if v is None else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", list(core.oracle_sql()))
def test_matches_duckdb(spark, duck, name):
    df = core.queries()[name](spark, DATA)
    cursor = duck.execute(core.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


def test_every_query_has_an_oracle():
    assert set(core.queries()) == set(core.oracle_sql())
