"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawgraph.llm.common import cut

#: More rounds than any graph needs (their number grows with the logarithm of its size).
MOST_ROUNDS = 100


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node that has none: then all is done."""
    ends = edges.select("u", F.lit(1).alias("out")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("out")))
    sums = ends.groupBy("u").agg(F.sum("out").alias("out"), F.count("*").alias("n"))
    return sums.filter((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("n") > 1))).isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """(x, label) of each end of ``links`` (x, y): the smallest end that is reachable.

    Large-star and small-star rounds: each node is linked to the least of its neighbourhood until all are stars.
    Only minima are gathered for a node, so a node of many links is no unbounded group.
    """
    edges = cut(
        links.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    )
    for _ in range(MOST_ROUNDS):
        if _stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = cut(small)
    labels = edges.select(F.col("u").alias("x"), F.col("v").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("x"), "label").distinct())
