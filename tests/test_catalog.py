"""Every catalog query against its SQL in DuckDB over the smallest tables."""

from __future__ import annotations

import datetime
import math
import os

import duckdb
import pytest

from sylva.plans import access, catalog, transfer, upkeep  # noqa: F401  they add their queries to the catalog's

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are elsewhere")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    wanted = duck.execute(catalog.ORACLE_SQL[name])
    columns = [x[0] for x in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert canonical(found.collect(), found.columns) == canonical(wanted.fetchall(), columns)
