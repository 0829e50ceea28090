"""The table of registered queries: each has a Spark function and, where SQL can say it, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from drawgraph.plans import views


@dataclass(frozen=True)
class Source:
    """Tables and views of one folder."""

    spark: SparkSession
    sf_dir: str

    def __call__(self, name: str) -> DataFrame:
        return views.frame(self.spark, self.sf_dir, name)

    def sql(self, text: str) -> DataFrame:
        """A query's own fixture, in SQL that DuckDB runs too."""
        return views.run(self.spark, self.sf_dir, text)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable:
    """Register a function of a ``Source``; ``{name}`` in ``sql`` stands for a table or view."""

    def add(function: Callable[[Source], DataFrame]) -> Callable:
        assert key not in QUERIES, key
        QUERIES[key] = lambda spark, sf_dir: function(Source(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[key] = views.duckdb(sql)
        return function

    return add
