"""Tag mining from OCR words. Words have (page, pos, text, lft, top, width, height, conf, rotation)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawgraph.functions.scalars import tag_category
from drawgraph.operators.lineage import cut_lineage, forget

#: Cells on a side of a block, by which rows meet what may be too near to them.
BLOCK = 4


def word_windows(words: DataFrame) -> DataFrame:
    """(page, pos, n, text, lft, right, conf): each word alone, with the next, and with the next two.

    The next word must not be blank; of three the third must not, the middle may be.
    """
    w = Window.partitionBy("page").orderBy("pos")
    ahead = lambda c, k: F.lead(c, k).over(w)
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    right = F.col("lft") + F.col("width")
    named = words.select(
        "page", "pos", "text", "lft", right.alias("r0"), F.col("conf").alias("c0"),
        ahead("text", 1).alias("t1"), (ahead("lft", 1) + ahead("width", 1)).alias("r1"), ahead("conf", 1).alias("c1"),
        ahead("text", 2).alias("t2"), (ahead("lft", 2) + ahead("width", 2)).alias("r2"), ahead("conf", 2).alias("c2"),
    )
    one = lambda n, text, r, c: F.struct(F.lit(n).alias("n"), text.alias("text"), r.alias("right"), c.alias("conf"))
    some = F.array(
        F.when(filled(F.col("text")), one(1, F.col("text"), F.col("r0"), F.col("c0"))),
        F.when(filled(F.col("text")) & filled(F.col("t1")), one(2, F.concat_ws(" ", "text", "t1"), F.col("r1"), F.least("c0", "c1"))),
        F.when(filled(F.col("text")) & filled(F.col("t2")), one(3, F.concat_ws(" ", "text", "t1", "t2"), F.col("r2"), F.least("c0", "c2"))),
    )
    return named.select("page", "pos", "lft", F.explode(F.array_compact(some)).alias("x")).select("page", "pos", "lft", "x.*")


def dedup_same_pos(tags: DataFrame) -> DataFrame:
    """The first row of each (page, tag, x, y)."""
    rank = F.row_number().over(Window.partitionBy("page", "tag", "x", "y").orderBy("pos"))
    return tags.withColumn("_r", rank).filter("_r = 1").drop("_r")


def drop_prefix_tags(tags: DataFrame) -> DataFrame:
    """Drop a tag that begins another, longer tag at the same place; of equal tags the first stays."""
    longer = tags.select("page", "x", "y", F.col("tag").alias("_t"), F.col("pos").alias("_p"))
    hit = F.startswith(F.col("_t"), F.col("tag")) & ((F.length("_t") > F.length("tag")) | ((F.col("_t") == F.col("tag")) & (F.col("_p") < F.col("pos"))))
    joined = tags.alias("a").join(longer.alias("b"), (F.col("a.page") == F.col("b.page")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y")) & hit, "left_anti")
    return joined


def dedup_proximity(tags: DataFrame, near: int = 50) -> DataFrame:
    """Greedy by confidence, then position: a tag is dropped if a kept one of its name is nearer than ``near`` on both axes.

    The choice is the one that a scan in that order makes, but is made in rounds. Places are dealt into cells of
    ``near``, of which two rows are always too near. In a round the first undecided row of a cell is kept if none of the
    eight cells around holds an earlier one that is too near; then what is too near to it goes. A row meets at most the
    first rows, and later the kept ones, of the cells in and around its block of cells, so a crowded group or cell costs
    no more than its rows.

    Rows that order, name and place don't tell apart are one row. Null names are a name; null places or pages drop out.
    """
    grid = lambda c: F.floor(F.col(c) / near)
    order = F.struct((-F.col("conf")).alias("a"), F.col("pos").alias("b"), "x", "y")
    cell = ["page", "tag", "_i", "_j"]
    block = lambda c: F.floor(c / (near * BLOCK))
    blocks = ["page", "tag", "_bi", "_bj"]
    placed = lambda df: df.withColumns({"_i": grid("x"), "_j": grid("y"), "_bi": block(F.col("x")), "_bj": block(F.col("y")), "_o": order})
    open_ = placed(tags.filter("page is not null and x is not null and y is not null").withColumn("tag", F.struct("tag")))  # a struct is never null
    # places and order are made again from what is kept, which so has no more columns than the rows
    open_ = cut_lineage(open_.dropDuplicates([*cell, "_o"]).select(*tags.columns))
    near_by = (F.abs(F.col("x") - F.col("_x")) < near) & (F.abs(F.col("y") - F.col("_y")) < near)

    def around(rows: DataFrame) -> DataFrame:
        """Cells, places and order of ``rows``, once for each block that what is too near to them may lie in."""
        reach = lambda c: F.explode(F.sequence(block(F.col(c) - near), block(F.col(c) + near)))
        named = rows.select("page", "tag", F.col("_i").alias("_ci"), F.col("_j").alias("_cj"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("_o").alias("_best"), reach("x").alias("_bi"))
        return named.withColumn("_bj", reach("_y"))

    kept: list[DataFrame] = []
    while not open_.isEmpty():
        rows = placed(open_)
        first = cut_lineage(rows.groupBy(*cell).agg(F.min("_o").alias("_o")))
        first_at = first.select("*", F.col("_o.x").alias("x"), F.col("_o.y").alias("y"))
        beaten = rows.join(around(first_at), blocks).filter(near_by & (F.col("_o") < F.col("_best"))).select("page", "tag", F.col("_ci").alias("_i"), F.col("_cj").alias("_j")).distinct()
        won = cut_lineage(first.join(beaten, cell, "left_anti"))
        won_at = won.select("*", F.col("_o.x").alias("x"), F.col("_o.y").alias("y"))
        kept.append(cut_lineage(rows.join(won, [*cell, "_o"], "left_semi").select(*tags.columns)))
        gone = around(won_at).select(*blocks, "_x", "_y").alias("w")
        mine = [F.col(f"r.{c}") == F.col(f"w.{c}") for c in blocks]
        too_near = (F.abs(F.col("r.x") - F.col("w._x")) < near) & (F.abs(F.col("r.y") - F.col("w._y")) < near)
        left = cut_lineage(rows.alias("r").join(gone, [*mine, too_near], "left_anti").select(*tags.columns))
        for table in (open_, first, won):  # a round leaves what it kept and what is open, nothing else
            forget(table)
        open_ = left
    out = reduce(DataFrame.unionByName, kept) if kept else open_
    return out.withColumn("tag", F.col("tag.tag"))


def aggregate_tags(tags: DataFrame) -> DataFrame:
    """(tag, category, code, number, first_page, n, best, occurrences): each tag as it was seen first, and where it was seen.

    ``occurrences`` are (page, pos, conf) in order; category and code follow from the letters of the tag.
    """
    sums = tags.groupBy("tag").agg(
        F.count("*").alias("n"), F.min("page").alias("first_page"), F.max("conf").alias("best"), F.sort_array(F.collect_list(F.struct("page", "pos", "conf"))).alias("occurrences")
    )
    code = F.regexp_extract("tag", r"^([A-Z]+)", 1)
    return sums.select("tag", tag_category(code).alias("category"), code.alias("code"), F.regexp_extract("tag", r"^[A-Z]+[- ]?(.*)$", 1).alias("number"), "first_page", "n", "best", "occurrences")


def category_counts(found: DataFrame) -> DataFrame:
    """(category, tags) of aggregated tags, and of all under 'all'."""
    sums = found.rollup("category").agg(F.count("*").alias("tags"), F.grouping("category").alias("_g"))
    return sums.select(F.when(F.col("_g") == 1, "all").otherwise(F.col("category")).alias("category"), "tags")


def index_by_page(tags: DataFrame) -> DataFrame:
    return tags.groupBy("page").agg(F.sort_array(F.collect_set("tag")).alias("tags"), F.count("*").alias("n"))


def page_groups(pages: DataFrame, by: str, threshold: float) -> DataFrame:
    """(by, sheet, page): consecutive pages as alike as the threshold are one sheet, and its last page stands for it.

    ``pages`` has (by, page, similarity to the page before).
    """
    w = Window.partitionBy(by).orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    sheet = F.sum(F.when(F.coalesce("similarity", F.lit(0.0)) < threshold, 1).otherwise(0)).over(w)
    return pages.withColumn("sheet", sheet).groupBy(by, "sheet").agg(F.max("page").alias("page"))
