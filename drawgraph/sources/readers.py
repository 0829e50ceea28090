"""Readers of the files that the operators start from. Each gives DataFrames; files that don't parse are told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawgraph.sources import schemas


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def explode_graphs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of parsed graph documents (pid, nodes, edges); ``node_seq`` and ``edge_seq`` are places in the file."""
    nodes = docs.select("pid", F.posexplode("nodes").alias("node_seq", "n")).select("pid", "node_seq", "n.*")
    edges = docs.select("pid", F.posexplode("edges").alias("edge_seq", "e")).select("pid", "edge_seq", "e.*")
    return nodes, edges.withColumnsRenamed({"from": "src", "to": "dst"})


def graph_documents(spark: SparkSession, path: str) -> DataFrame:
    """(pid, …, _corrupt_record) of a folder of graph files, one per drawing, named by drawing; a missing folder is an error."""
    files = spark.read.text(path, wholetext=True)
    pid = _stem(F.regexp_replace(F.col("_metadata.file_name"), r"\.graph\.json$", ".json"))
    # read as text: a query on the corrupt column alone is allowed then
    return files.select(pid.alias("pid"), F.from_json("value", schemas.GRAPH, {"mode": "PERMISSIVE"}).alias("d")).select("d.*", "pid")


def read_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return explode_graphs(graph_documents(spark, path).filter("_corrupt_record is null"))


def parse_graphs(texts: DataFrame, column: str = "json") -> DataFrame:
    """Graph documents held as text (pid, json)."""
    return texts.select("pid", F.from_json(column, schemas.GRAPH).alias("d")).select("pid", "d.*")


def tile_components(docs: DataFrame) -> DataFrame:
    return docs.select("tile", "pass", F.posexplode("components").alias("seq", "c")).select("tile", "pass", "seq", "c.*")


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Tile extractions (tile, pass, components, connections, _corrupt_record)."""
    return spark.read.schema(schemas.TILE).option("multiLine", True).json(path)


def tag_list(text: Column) -> Column:
    """Tags of a tag file: a list, or an object's 'tags', 'text', 'labels' or 'items', of objects with a tag or of scalars."""
    v = F.try_parse_json(text)
    as_list = lambda path: F.try_variant_get(v, path, "array<variant>")
    items = F.coalesce(as_list("$"), *[as_list(f"$.{k}") for k in ("tags", "text", "labels", "items")])
    tag = lambda x: F.coalesce(F.try_variant_get(x, "$.tag", "string"), F.try_variant_get(x, "$", "string"))
    return F.transform(items, tag)


def read_tag_lists(spark: SparkSession, path: str) -> DataFrame:
    """(pid, tag) of a folder of tag files."""
    files = spark.read.text(path, wholetext=True).select(_stem(F.col("_metadata.file_name")).alias("pid"), "value")
    return files.select("pid", F.explode(tag_list(F.col("value"))).alias("tag"))


def clean_sheet(sheet: DataFrame) -> DataFrame:
    """Trimmed headers, ``col_i`` for blank ones; rows without any value go."""
    names = [c.strip() if c and c.strip() and not c.startswith("_c") else f"col_{i}" for i, c in enumerate(sheet.columns)]
    return sheet.toDF(*names).na.drop(how="all")


def read_sheets(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: clean_sheet(spark.read.option("header", True).csv(f"{folder}/{n}.csv")) for n in names}


def yolo_fields(lines: DataFrame) -> DataFrame:
    """(stem, cls, cx, cy, bw, bh) of label lines (stem, line) with exactly five fields; a field that is no number is null."""
    f = F.split(F.trim("line"), r"\s+")
    value = lambda k: F.get(f, F.lit(k)).try_cast("double")
    return lines.filter(F.size(f) == 5).select("stem", value(0).cast("int").alias("cls"), *[value(k + 1).alias(n) for k, n in enumerate(("cx", "cy", "bw", "bh"))])


def read_yolo_labels(spark: SparkSession, path: str) -> DataFrame:
    return yolo_fields(spark.read.text(path).select(_stem(F.col("_metadata.file_name")).alias("stem"), F.col("value").alias("line")))


def read_graphml(spark: SparkSession, path: str, stem: Column | None = None) -> DataFrame:
    """(stem, node, label, xmin, ymin, xmax, ymax) of GraphML files; a later datum of an attribute wins, empty ones are none.

    Data name their attribute through ``<key id attr.name>``. A row is a node: a file is read as a stream and
    never held whole, files side by side. (The source can also split a file, but loses nodes that share a line with what
    stands before them.) ``stem`` names the file, from ``file_path``; nodes without data are left out.
    """
    named = (stem if stem is not None else _stem(F.col("file_path"))).alias("stem")

    def tags(tag: str, schema: str) -> DataFrame:
        reader = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).option("mode", "DROPMALFORMED").schema(schema)
        return reader.load(path).select("*", F.col("_metadata.file_path").alias("file_path")).select(named, "*").drop("file_path")

    keys = tags("key", "_id string, `_attr.name` string").filter("_id is not null").groupBy("stem", "_id").agg(F.max("`_attr.name`").alias("name"))
    keys = keys.groupBy("stem").agg(F.map_from_entries(F.collect_list(F.struct("_id", "name"))).alias("keys"))  # a few dozen a file
    nodes = tags("node", "_id string, data array<struct<_key string, _VALUE string>>").filter(F.size("data") > 0).join(keys, "stem")
    of = lambda name: F.filter("data", lambda d: (F.element_at("keys", d["_key"]) == name) & (d["_VALUE"] != ""))
    last = lambda name: F.get(of(name), F.size(of(name)) - 1)["_VALUE"]
    return nodes.select("stem", F.col("_id").alias("node"), last("label").alias("label"), *[last(a).try_cast("double").alias(a) for a in ("xmin", "ymin", "xmax", "ymax")])


def pixel_rows(lines: DataFrame, pixels: int) -> DataFrame:
    """(…, pixels, label) of lines of ``pixels`` numbers and a label."""
    f = F.split("line", ",")
    return lines.filter(F.size(f) == pixels + 1).withColumn("pixels", F.slice(f, 1, pixels).cast("array<double>")).withColumn("label", F.get(f, F.lit(pixels)))


def read_corpus(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(path, mtime, text) of whole files."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("value").alias("text"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, height, width, n_channels, data) of image files."""
    return spark.read.format("image").load(path).select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("n_channels"), "image.data")


def pixel_shares(images: DataFrame, dark: int = 128, light: int = 240) -> DataFrame:
    """(origin, dark, light): shares of dark and of light pixels (channel means), from Arrow batches of image bytes."""
    import pandas as pd

    def run(batches):
        import numpy as np

        for batch in batches:
            rows = []
            for origin, n, data in zip(batch["origin"], batch["n_channels"], batch["data"], strict=True):
                v = np.frombuffer(data, np.uint8).reshape(-1, n).mean(axis=1)
                rows.append((origin, float((v < dark).mean()), float((v >= light).mean())))
            yield pd.DataFrame(rows, columns=["origin", "dark", "light"])

    return images.select("origin", "n_channels", "data").mapInPandas(run, "origin string, dark double, light double")


def split_stems(lines: DataFrame, column: str = "line") -> DataFrame:
    return lines.withColumn("stem", _stem(F.trim(column)))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Chunks with their vectors in one row, so nothing has to be kept in step by position."""
    return spark.read.parquet(path)
