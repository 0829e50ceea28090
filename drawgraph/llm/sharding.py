"""Contiguous balanced shards by global byte prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawgraph.llm.common import cut, text_bytes

#: The order of rows is dealt over ranges of the text hash, one for so many rows and between these powers of two.
RANGE_ROWS, LEAST_BITS, MOST_BITS = 50_000, 10, 20
#: Rows of one text are counted in this many parts, so that no group is one task.
SALTS = 64


def shard_by_bytes(
    docs: DataFrame,
    n_shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 16,
    whole_group: float = 0.02,
) -> DataFrame:
    """Deal all rows out to ``n_shards`` contiguous shards of near equal bytes.

    Rows are ordered by (hash of text, id), which sets equal texts side by side.
    Ranges of the hash have totals; their prefix sums give each row its global
    start in bytes and in rows; equal targets cut that line. A group of equal
    texts stays whole while it holds at most ``whole_group`` of a shard; larger
    groups are cut like other rows.

    Returns id, size (UTF-8 bytes plus ``overhead``), text_crc32, law ('bytes'),
    shard, slot (gapless from 0 in each shard), grown_shard (null).

    Null text counts as empty (size is ``overhead``); null ids are kept; repeated
    rows each take a slot of their own; ties are ordered by id; an empty table
    gives no rows; other columns are not read.
    """
    raw = text_bytes(F.col(text_col))
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(raw) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(raw).alias("crc"),
            F.xxhash64(raw).alias("h"),
            F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int").alias("salt"),
            # rows of one text and id are alike, so whatever deals them out changes nothing that can be seen
            F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("turn"),
        )
    )
    bits = min(MOST_BITS, max(LEAST_BITS, (rows.count() // RANGE_ROWS).bit_length()))
    group = ["h", "crc", "size"]
    part = [*group, "salt"]
    parts = (
        rows.groupBy(*part)
        .agg(F.count("*").alias("n"))
        .withColumn("range", F.shiftright("h", 64 - bits).cast("int"))
    )
    # per-range totals: at most 2 ** MOST_BITS rows, so one window and a broadcast are bounded
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = parts.groupBy("range").agg(F.sum(F.col("n") * F.col("size")).alias("b"), F.sum("n").alias("r"))
    totals = totals.select(
        "range",
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("range_byte"),
        F.coalesce(F.sum("r").over(before), F.lit(0)).alias("range_row"),
        F.sum("b").over(everything).alias("total"),
    )
    inner = Window.partitionBy("range").orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    of_group = Window.partitionBy("range", *group)
    placed = (
        parts.withColumn("byte", F.coalesce(F.sum(F.col("n") * F.col("size")).over(inner), F.lit(0)))
        .withColumn("row", F.coalesce(F.sum("n").over(inner), F.lit(0)))
        .withColumn("group_byte", F.min("byte").over(of_group))
        .withColumn("group_bytes", F.sum(F.col("n") * F.col("size")).over(of_group))
        .join(F.broadcast(totals), "range")
        .select(
            *part,
            "total",
            "group_bytes",
            (F.col("byte") + F.col("range_byte")).alias("byte"),
            (F.col("row") + F.col("range_row")).alias("row"),
            (F.col("group_byte") + F.col("range_byte")).alias("group_byte"),
        )
    )
    # rows of one text, salt and id are counted first, in parts; a row's rank is what lies before its part and its place there
    same = [*part, "id", "turn"]
    alike = rows.groupBy(*same).agg(F.count("*").alias("k"))
    ahead = F.sum("k").over(Window.partitionBy(*part).orderBy("id", "turn").rowsBetween(Window.unboundedPreceding, -1))
    alike = alike.select(*[F.col(c).alias(f"_{c}") for c in same], F.coalesce(ahead, F.lit(0)).alias("ahead"))
    place = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0))) - 1
    middle = F.when(
        F.col("group_bytes") * n_shards <= F.col("total") * whole_group,
        2 * F.col("group_byte") + F.col("group_bytes"),
    ).otherwise(2 * (F.col("byte") + F.col("rank") * F.col("size")) + F.col("size"))
    numbered = rows.withColumn("place", place)
    met = [F.col(c) == F.col(f"_{c}") for c in (*part, "turn")] + [F.col("id").eqNullSafe(F.col("_id"))]
    numbered = numbered.join(alike, met).select(*part, "id", (F.col("place") + F.col("ahead")).alias("rank"))
    dealt = cut(
        numbered.join(placed, part)
        .select(
            "id",
            "size",
            "crc",
            (F.col("row") + F.col("rank")).alias("row"),
            F.least(
                F.lit(n_shards - 1),
                F.floor(middle.cast("decimal(38,0)") * n_shards / (2 * F.col("total"))).cast("int"),
            ).alias("shard"),
        )
    )
    first = dealt.groupBy("shard").agg(F.min("row").alias("first"))  # n_shards rows
    return dealt.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
