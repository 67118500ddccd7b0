"""Every registered query against its comparison SQL on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from inkgauge.plans.catalog import CATALOG
from inkgauge.plans.fixtures import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "None" if value != value else str(int(value)) if value == int(value) else repr(round(value, 6))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_matches(spark, duck, name):
    run, sql = CATALOG[name]
    df = run(spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert got, "the query found nothing to do"
    if sql is None:
        return
    relation = duck.sql(sql)
    assert sorted(relation.columns) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    want = sorted(tuple(map(plain, r)) for r in duck.sql(f"SELECT {listed} FROM ({sql})").fetchall())
    assert got == want
