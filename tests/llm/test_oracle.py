"""Corpus queries that have SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from drawgraph.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query(spark, key):
    duck = duckdb.connect()
    for name in ("conversations", "embeddings"):
        duck.sql(f"create view {name} as from '{DIR}/{name}.parquet'")
    df = QUERIES[key](spark, DIR)
    result = duck.sql(ORACLE_SQL[key])
    assert sorted(result.columns) == sorted(df.columns)
    place = [list(result.columns).index(c) for c in df.columns]
    assert sorted(tuple(r) for r in df.collect()) == sorted(tuple(r[i] for i in place) for r in result.fetchall())
