"""Incremental work: what is still to do, which files changed, and file streams that go on where they stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending_work(wanted: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """(keys, reason): items without a result ('new'), and items whose only result is a parse error ('retry', once)."""
    if force:
        return wanted.select(*keys).distinct().withColumn("reason", F.lit("forced"))
    state = done.groupBy(*keys).agg(F.count("*").alias("_n"), F.bool_or("ok").alias("_ok"))
    joined = wanted.select(*keys).distinct().join(state, keys, "left")
    reason = F.when(F.col("_n").isNull(), "new").when(~F.col("_ok") & (F.col("_n") < 2), "retry")
    return joined.select(*keys, reason.alias("reason")).filter("reason is not null")


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, change) of files that are new, changed or gone since the last snapshot (path, mtime)."""
    a, b = now.select("path", F.col("mtime").alias("_a")), before.select("path", F.col("mtime").alias("_b"))
    change = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "gone").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).filter("change is not null")


def stream_json(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str) -> None:
    """Append the rows of JSON files that arrived since the last call to a Parquet folder, each file once."""
    rows = spark.readStream.schema(schema).json(source).withColumn("file", F.col("_metadata.file_name"))
    query = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    query.awaitTermination()


def stream_counts(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, delay: str = "1 hour") -> None:
    """Counts of events by hour and type from Parquet files that arrived, late events within ``delay`` included."""
    events = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    counts = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    rows = counts.select(F.col("window.start").alias("hour"), "event_type", "n")
    query = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    query.awaitTermination()
