"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from drawgraph.plans import catalog, views

DIR = "/root/testdata/sf0.001"
#: Queries whose result may be empty on the smallest tables.
MAY_BE_EMPTY = {"match_off_page_refs", "resolve_inter_edges"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in views.TABLES:
        connection.sql(f"create view {name} as from '{DIR}/{name}.parquet'")
    return connection


def shown(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, float):
        return str(int(value)) if math.isfinite(value) and value == int(value) else repr(round(value, 6))
    return str(value)


@pytest.mark.parametrize("key", sorted(catalog.QUERIES))
def test_query(spark, duck, key):
    df = catalog.QUERIES[key](spark, DIR)
    names = sorted(df.columns)
    got = sorted(tuple(shown(r[n]) for n in names) for r in df.collect())
    assert got or key in MAY_BE_EMPTY
    if key not in catalog.ORACLE_SQL:
        return
    result = duck.sql(catalog.ORACLE_SQL[key])
    columns = list(result.columns)
    assert sorted(columns) == names
    place = [columns.index(n) for n in names]
    assert got == sorted(tuple(shown(r[i]) for i in place) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(views.VIEWS))
def test_view(spark, duck, name):
    df = views.frame(spark, DIR, name)
    result = duck.sql(views.duckdb(f"SELECT * FROM {{{name}}}"))
    place = [list(result.columns).index(c) for c in df.columns]
    assert sorted(tuple(map(shown, r)) for r in df.collect()) == sorted(tuple(shown(r[i]) for i in place) for r in result.fetchall())
