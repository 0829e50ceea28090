"""A folder of texts as a stored table that is carried forward: only files that changed are read again."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths that one read names; more changed files are more reads in one job.
BLOCK = 5000
KEYS = ["path", "mtime", "size"]


@dataclass(frozen=True)
class Refresh:
    """What a refresh did: the version that holds now, files read, files kept from the version before, files gone."""

    version: int
    read: int
    kept: int
    gone: int


def _files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob).option("recursiveFileLookup", True) if glob else reader).load(path)


def _listed(files: DataFrame) -> DataFrame:
    return files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def versions(spark: SparkSession, store: str) -> list[int]:
    """Whole versions of a store, rising: a version counts from the moment its last file is committed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{store}/version=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(re.search(r"version=(\d+)", f.getPath().toString())[1]) for f in found)


def read(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """(path, mtime, size, text) of a version, the last one if none is named."""
    known = versions(spark, store)
    if not known:
        raise FileNotFoundError(f"no whole version in {store}")
    return spark.read.parquet(f"{store}/version={known[-1] if version is None else version}")


def refresh(spark: SparkSession, folder: str, store: str, glob: str = "*.md") -> Refresh:
    """Bring ``store`` up to the files of ``folder``.

    Files are listed without being read. Those whose time and size are the last version's keep its row, only the others
    are read, and those that are gone go. The new version is one write; readers see the old one until its commit, and a
    refresh that fails leaves nothing that counts. Without a change the version stays. Empty files aren't listed.
    """
    known = versions(spark, store)
    now = _listed(_files(spark, folder, glob)).cache()
    try:
        last = spark.read.parquet(f"{store}/version={known[-1]}") if known else None
        todo = now if last is None else now.join(last.select(*KEYS), KEYS, "left_anti")
        n, total = todo.count(), now.count()
        gone = 0 if last is None else last.select("path").join(now.select("path"), "path", "left_anti").count()
        if known and not n and not gone:
            return Refresh(known[-1], 0, total, 0)
        blocks = -(-n // BLOCK)
        parts = [last.join(now, KEYS, "left_semi").select(*KEYS, "text")] if last is not None else []
        for b in range(blocks):
            paths = [r["path"] for r in todo.filter(F.pmod(F.xxhash64("path"), F.lit(blocks)) == b).select("path").collect()]  # about BLOCK
            if paths:
                files = _files(spark, [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths])
                parts.append(files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text")))
        version = (known[-1] if known else 0) + 1
        rows = reduce(DataFrame.unionByName, parts) if parts else now.select(*KEYS, F.lit("").alias("text"))
        rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{store}/version={version}")
        return Refresh(version, n, total - n, gone)
    finally:
        now.unpersist()
