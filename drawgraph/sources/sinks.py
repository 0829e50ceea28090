"""Writers. Spark places and commits the files; each also has the form that only makes the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graph_json(nodes: DataFrame, edges: DataFrame, version: str = "pid.graph.v0.1.1") -> DataFrame:
    """(pid, json): one document per drawing with its nodes and edges in file order. A drawing is a bounded group."""
    n = nodes.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("node_seq", F.struct(*[c for c in nodes.columns if c not in ("pid", "node_seq")]).alias("x")))).alias("n"))
    renamed = F.struct(*[F.col(c).alias({"src": "from", "dst": "to"}.get(c, c)) for c in edges.columns if c not in ("pid", "edge_seq")]).alias("x")
    e = edges.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("edge_seq", renamed))).alias("e"))
    joined = n.join(e, "pid", "left")
    body = F.struct(F.lit(version).alias("schema_version"), F.transform("n", lambda r: r["x"]).alias("nodes"), F.coalesce(F.transform("e", lambda r: r["x"]), F.array()).alias("edges"))
    return joined.select("pid", F.to_json(body).alias("json"))


def write_graphs(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    graph_json(nodes, edges).select("pid", F.col("json").alias("value")).write.partitionBy("pid").text(path)


def write_index(chunks: DataFrame, path: str) -> None:
    chunks.write.parquet(path)


def manifest(labels: DataFrame) -> DataFrame:
    """(stem, source, split, ann_count) of labelled images (stem, source, split)."""
    return labels.groupBy("stem", "source", "split").agg(F.count("*").alias("ann_count"))


def write_manifest(labels: DataFrame, path: str) -> None:
    manifest(labels).write.option("header", True).csv(path)


def report(**tables: DataFrame) -> DataFrame:
    """One row: the number of rows of each table as JSON text."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias(name))
        counts = one if counts is None else counts.join(one)  # one row each
    return counts.select(F.to_json(F.struct(*tables)).alias("report"))


def write_report(path: str, **tables: DataFrame) -> None:
    report(**tables).select(F.col("report").alias("value")).write.text(path)
