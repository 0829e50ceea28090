"""What the corpus operators share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word definitions of the operators have it.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and go on from there.

    The folder is the cluster's ``spark.checkpoint.dir``; only a session without
    one (tests) gets a temporary folder, if it is a local one.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="drawgraph-"))
    return df.checkpoint(eager=True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once; the optimizer would copy it into lambda bodies."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words between ASCII white space; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def text_bytes(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


#: Bits of a table that keeps rows without a partner out of a join; a full table lets more through, nothing is lost.
TABLE_BITS = 22


def bit_table(keys: DataFrame, bits: int = TABLE_BITS) -> DataFrame:
    """One row, one array of longs: a bit for each number in column ``h``. Its size is fixed: 2 ** (bits - 3) bytes."""
    slot = F.pmod(F.col("h"), F.lit(1 << bits))
    held = (
        keys.select(F.shiftright(slot, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(pmod(h, 64) as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
    )
    words = keys.sparkSession.range(1 << (bits - 6)).select(F.col("id").cast("int").alias("w")).join(held, "w", "left")
    rows = F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0)).alias("b"))))
    return cut(words.agg(F.transform(rows, lambda x: x["b"]).alias("bits")))


def has_bit(table: Column, h: Column, bits: int = TABLE_BITS) -> Column:
    word = F.get(table, F.shiftright(F.pmod(h, F.lit(1 << bits)), 6).cast("int"))
    return F.coalesce(F.getbit(word, F.pmod(h, F.lit(64)).cast("int")) == 1, F.lit(False))
