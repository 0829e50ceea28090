"""Ranks and running sums within keys, also of keys that are too large for one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawgraph.operators.lineage import cut_lineage

#: Rows of one key that one task takes; a key with more is dealt over ranges of its order.
MOST = 1_000_000
#: Ranges for so many rows each; their number bounds the table of what lies before each range.
RANGE_ROWS = 250_000
MOST_RANGES = 20_000


def _plain(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"rank": F.row_number().over(w).cast("long"), **{c: F.sum(v).over(running) for c, v in sums.items()}})


def ranked(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column] | None = None, totals: bool = False, most: int = MOST) -> DataFrame:
    """``rows`` with ``rank`` from 1 within each key ``by``, and for each of ``sums`` a running sum that ends with the row.

    With ``totals`` there is also ``rows`` and, for each sum c, ``all_c``: count and sum of the whole key.

    ``order`` should tell all rows of a key apart; rows that it doesn't may come in any order. Null keys are a key.

    Keys of at most ``most`` rows are windows. If any key is larger, rows are dealt into ranges of (key, order), which
    are counted and summed on their own; what lies before a range is added from a table that has a row only for ranges
    of a key that spans several, at most two for each range, so it is small enough to send to every task. No task
    holds more of a key than a range.
    """
    sums = sums or {}
    counts = rows.groupBy(*by).agg(F.count("*").alias("rows"), *[F.sum(v).alias(f"all_{c}") for c, v in sums.items()])
    largest = counts.agg(F.max("rows").alias("m"), F.sum("rows").alias("n")).first()
    same = lambda a, b, keys: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])
    if (largest["m"] or 0) <= most:
        out = _plain(rows, by, order, sums)
        if totals:
            w = Window.partitionBy(*by)
            out = out.withColumns({"rows": F.count("*").over(w), **{f"all_{c}": F.sum(v).over(w) for c, v in sums.items()}})
        return out
    n = max(2, min(MOST_RANGES, -(-largest["n"] // min(RANGE_ROWS, most))))
    # the ranges must not change when a task is run again, so they are written
    dealt = cut_lineage(rows.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()))
    local = _plain(dealt, [*by, "_range"], order, sums)
    parts = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_n"), *[F.sum(v).alias(f"_{c}") for c, v in sums.items()])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.select(
        *by, "_range", F.sum("_n").over(before).alias("_rank"), *[F.sum(f"_{c}").over(before).alias(f"_{c}") for c in sums]
    ).filter("_rank > 0")
    joined = local.join(F.broadcast(ahead), same(local, ahead, [*by, "_range"]), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = joined.select(
        *[local[c] for c in rows.columns],
        (local["rank"] + zero("_rank")).alias("rank"),
        # a sum of nulls only is null
        *[F.when(local[c].isNotNull() | ahead[f"_{c}"].isNotNull(), F.coalesce(local[c], F.lit(0)) + zero(f"_{c}")).alias(c) for c in sums],
    )
    if totals:
        big = cut_lineage(counts.filter(F.col("rows") > most))  # few: each has more than ``most`` rows
        small = counts.filter(F.col("rows") <= most)
        marks = [c for c in counts.columns if c not in by]
        wide = F.broadcast(big.select(*by, F.struct(*marks).alias("_big")))
        out = out.join(wide, same(out, wide, by), "left").select(*[out[c] for c in out.columns], "_big")
        thin = small.select(*by, F.struct(*marks).alias("_small"))
        held = out.filter("_big is null")
        met = held.join(thin, same(held, thin, by)).select(*[held[c] for c in held.columns if c != "_big"], F.col("_small").alias("_t"))
        out = out.filter("_big is not null").withColumnRenamed("_big", "_t").unionByName(met).select("*", "_t.*").drop("_t")
    return out
