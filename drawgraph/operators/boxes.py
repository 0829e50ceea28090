"""Detection-dataset preparation: tiles, splits, oversampling, integrity. Boxes have (image_id, ann_id, cls, xmin, ymin, w, h)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawgraph.operators.ranks import ranked

#: Least share of a box that a tile must hold.
KEPT_SHARE = 0.3


def tile_starts(length: Column, tile: int, step: int) -> Column:
    """Starts 0, step, 2 * step, … of tiles that begin inside the image, and a last one at the border if it is uncovered."""
    last = F.greatest(F.lit(0), length - tile)
    regular = F.sequence(F.lit(0), F.greatest(F.lit(0), length - 1), F.lit(step))
    fitting = F.filter(regular, lambda s: (s + tile <= length) | (s == 0))
    covered = F.element_at(fitting, -1) + tile >= length
    return F.when(covered, fitting).otherwise(F.array_union(fitting, F.array(last)))


def tile_grid(images: DataFrame, width: str, height: str, tile: int, step: int) -> DataFrame:
    """(…, tx, ty) of every tile of each image."""
    columns = images.withColumn("tx", F.explode(tile_starts(F.col(width), tile, step)))
    return columns.withColumn("ty", F.explode(tile_starts(F.col(height), tile, step)))


def tile_boxes(boxes: DataFrame, width: int, height: int, tile: int, step: int) -> DataFrame:
    """(image_id, ann_id, cls, tx, ty, cx, cy, bw, bh): each box in every tile that holds enough of it, as shares of the tile.

    A box meets only the starts that it overlaps, so no tile is tried in vain.
    """
    over = lambda start, size, full: F.filter(tile_starts(F.lit(full), tile, step), lambda s: (s < start + size) & (s + tile > start))
    placed = (
        boxes.filter("w > 0 and h > 0")
        .withColumn("tx", F.explode(over(F.col("xmin"), F.col("w"), width)))
        .withColumn("ty", F.explode(over(F.col("ymin"), F.col("h"), height)))
    )
    x0, x1 = F.greatest(F.col("xmin"), F.col("tx")), F.least(F.col("xmin") + F.col("w"), F.col("tx") + tile)
    y0, y1 = F.greatest(F.col("ymin"), F.col("ty")), F.least(F.col("ymin") + F.col("h"), F.col("ty") + tile)
    cut = placed.withColumn("x0", x0).withColumn("x1", x1).withColumn("y0", y0).withColumn("y1", y1)
    share = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("w") * F.col("h"))
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return cut.filter(share >= KEPT_SHARE).select(
        "image_id", "ann_id", "cls", "tx", "ty",
        unit(((F.col("x0") + F.col("x1")) / 2 - F.col("tx")) / tile).alias("cx"),
        unit(((F.col("y0") + F.col("y1")) / 2 - F.col("ty")) / tile).alias("cy"),
        unit((F.col("x1") - F.col("x0")) / F.lit(tile)).alias("bw"),
        unit((F.col("y1") - F.col("y0")) / F.lit(tile)).alias("bh"),
    )


def overlap_grid(sheets: DataFrame, rows: int, cols: int, overlap: float = 0.15) -> DataFrame:
    """(…, r, c, x0, y0, x1, y1): a grid of cells, each grown by a share of its size and clamped to the sheet."""
    cells = sheets.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    w, h = F.floor(F.col("width") / cols), F.floor(F.col("height") / rows)
    dx, dy = F.floor(w * overlap), F.floor(h * overlap)
    return (
        cells.withColumn("x0", F.greatest(F.lit(0).cast("bigint"), F.col("c") * w - dx))
        .withColumn("y0", F.greatest(F.lit(0).cast("bigint"), F.col("r") * h - dy))
        .withColumn("x1", F.least(F.col("width").cast("bigint"), (F.col("c") + 1) * w + dx))
        .withColumn("y1", F.least(F.col("height").cast("bigint"), (F.col("r") + 1) * h + dy))
    )


def crop_window(boxes: DataFrame, width: int, height: int, pad: float = 1.5, least: int = 128) -> DataFrame:
    """(…, x0, y0, x1, y1): the box grown by ``pad`` of its size on each side, clamped, and at least ``least`` pixels."""

    def side(start: Column, size: Column, full: int) -> tuple[Column, Column]:
        a = F.greatest(F.lit(0), F.floor(start - size * pad).cast("int"))
        b = F.least(F.lit(full), F.floor(start + size + size * pad).cast("int"))
        middle = F.floor((a + b) / 2).cast("int")
        low = F.greatest(F.lit(0), middle - least // 2)
        return F.when(b - a < least, low).otherwise(a), F.when(b - a < least, F.least(F.lit(full), low + least)).otherwise(b)

    x0, x1 = side(F.col("xmin"), F.col("w"), width)
    y0, y1 = side(F.col("ymin"), F.col("h"), height)
    return boxes.withColumn("x0", x0).withColumn("x1", x1).withColumn("y0", y0).withColumn("y1", y1)


def seeded(*columns: str, seed: str = "42") -> Column:
    """A fixed draw for each row: MD5 of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(seed), *columns))


def stratified_split(rows: DataFrame, by: str, key: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """``split`` by seeded order within each dataset: int(n * train) train, int(n * val) val, the rest test."""
    placed = ranked(rows.withColumn("_h", seeded(key)), [by], [F.col("_h"), F.col(key)], totals=True)
    a = F.floor(F.col("rows") * train)
    split = F.when(F.col("rank") <= a, "train").when(F.col("rank") <= a + F.floor(F.col("rows") * val), "val").otherwise("test")
    return placed.select(*rows.columns, split.alias("split"), F.concat_ws("__", by, F.col(key).cast("string")).alias("stem"))


def oversample_minority(tiles: DataFrame, targets: dict[int, int]) -> DataFrame:
    """(cls, tile, copy) of the tiles to repeat so that each minority class reaches its target count of boxes.

    ``tiles`` has (tile, cls, n). Classes take their turn in the order of ``targets``. A class draws from the tiles that
    hold it, in seeded order, round after round, while its count is below the target; boxes on copies that were drawn
    for earlier classes count. A class that no tile holds draws nothing.

    Nothing is drawn one by one: whole rounds are a division, and the last one ends where a running sum does.
    """
    held = tiles.filter("n > 0")
    drawn = held.filter("false").select("cls", "tile", F.lit(0).cast("long").alias("copies"))
    for cls, target in targets.items():
        pool = held.filter(F.col("cls") == cls)
        own, more = pool.agg(F.sum("n")).first()[0], pool.select("tile", "n").join(drawn.select("tile", "copies"), "tile").agg(F.sum(F.col("n") * F.col("copies"))).first()[0]
        need = target - (own or 0) - (more or 0)
        if not own or need <= 0:
            continue
        rounds, rest = divmod(need, own)
        placed = ranked(pool.select("cls", "tile", "n", seeded("tile", "cls").alias("_h")), ["cls"], [F.col("_h"), F.col("tile")], {"run": F.col("n")})
        copies = F.lit(rounds).cast("long") + F.when(F.col("run") - F.col("n") < rest, 1).otherwise(0)
        drawn = drawn.unionByName(placed.select("cls", "tile", copies.alias("copies")).filter("copies > 0"))
    return drawn.select("cls", "tile", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))


def sample_per_class(boxes: DataFrame, n: int = 5, least_side: int = 0) -> DataFrame:
    """Up to ``n`` boxes of each class in seeded order, one image after the other before any image twice."""
    some = boxes.filter((F.least("w", "h") >= least_side) & (F.least("w", "h") > 0)).withColumn("_h", seeded("ann_id"))
    turn = F.row_number().over(Window.partitionBy("cls", "image_id").orderBy("_h", "ann_id"))
    rank = F.row_number().over(Window.partitionBy("cls").orderBy("_t", "_h", "ann_id"))
    return some.withColumn("_t", turn).filter(F.col("_t") <= n).withColumn("_r", rank).filter(F.col("_r") <= n).drop("_h", "_t", "_r")


def replicate_rows(tiles: DataFrame) -> DataFrame:
    """Each training row twice, the copy prefixed aug1__; other rows as they are."""
    copies = F.when(F.col("split") == "train", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return tiles.withColumn("copy", F.explode(copies)).withColumn("stem", F.when(F.col("copy") == 1, F.concat(F.lit("aug1__"), "stem")).otherwise(F.col("stem")))


def number_rows(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``number`` from 0 in each group, and ``name`` with four digits."""
    placed = ranked(rows, [by], [F.col(c) for c in order]).select(*rows.columns, (F.col("rank") - 1).alias("number"))
    return placed.withColumn("name", F.concat_ws("_", F.col(by).cast("string"), F.lpad(F.col("number").cast("string"), F.greatest(F.lit(4), F.length(F.col("number").cast("string"))), F.lit("0"))))


def class_distribution(boxes: DataFrame, classes: list[int]) -> DataFrame:
    """(split, cls, n, share) with zero rows for classes that a split lacks."""
    counts = boxes.groupBy("split", "cls").agg(F.count("*").alias("n"))
    every = boxes.select("split").distinct().withColumn("cls", F.explode(F.array(*[F.lit(c) for c in classes])))
    joined = every.join(counts, ["split", "cls"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    total = F.sum("n").over(Window.partitionBy("split"))
    return joined.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0)))


def dataset_totals(images: DataFrame) -> DataFrame:
    """(dataset, images, labelled, annotations) per dataset and over all; ``images`` has (dataset, stem, n)."""
    sums = images.rollup("dataset").agg(
        F.count("*").alias("images"), F.count_if(F.col("n") > 0).alias("labelled"), F.sum("n").alias("annotations"), F.grouping("dataset").alias("_g")
    )
    return sums.select(F.when(F.col("_g") == 1, "all").otherwise(F.col("dataset")).alias("dataset"), "images", "labelled", "annotations")


def parse_labels(lines: DataFrame) -> DataFrame:
    """``fields`` of each label line as numbers; a field that is no number is null."""
    return lines.withColumn("fields", F.transform(F.split("line", " "), lambda x: x.try_cast("double")))


def corrupt_lines(lines: DataFrame, classes: int) -> DataFrame:
    """(dataset, corrupt): lines without five fields, or with a class or value out of range."""
    f = F.col("fields")
    good = (F.size(f) == 5) & F.forall(f, lambda x: x.isNotNull()) & f[0].between(0, classes) & F.forall(F.slice(f, 2, 4), lambda x: x.between(0, 1))
    return parse_labels(lines).groupBy("dataset").agg(F.count_if(~F.coalesce(good, F.lit(False))).alias("corrupt"))


def label_log(lines: DataFrame, stems: DataFrame) -> DataFrame:
    """(stem, reason) of images whose label file is missing, or has no line of five fields or more."""
    counts = lines.groupBy("stem").agg(F.count_if(F.size(F.split("line", " ")) >= 5).alias("_ok"))
    joined = stems.join(counts, "stem", "left")
    reason = F.when(F.col("_ok").isNull(), "no label file").when(F.col("_ok") == 0, "no valid line")
    return joined.select("stem", reason.alias("reason")).filter("reason is not null")


def dark_density(pixels: DataFrame, dark: int = 128, dense: float = 0.12) -> DataFrame:
    share = F.avg((F.col("v") < dark).cast("int"))
    return pixels.groupBy("image").agg(share.alias("share")).withColumn("dense", F.col("share") > dense)


def blank_filter(pixels: DataFrame, annotated: DataFrame, light: int = 240, share: float = 0.92) -> DataFrame:
    """(image, blank, dropped): blank if nearly all pixels are light; dropped only if no annotation lies on it."""
    found = pixels.groupBy("image").agg((F.avg((F.col("v") >= light).cast("int")) >= share).alias("blank"))
    marked = annotated.select("image").distinct().withColumn("_a", F.lit(True))
    return found.join(marked, "image", "left").select("image", "blank", (F.col("blank") & F.col("_a").isNull()).alias("dropped"))


def page_similarity(pages: DataFrame, other: DataFrame, near: int = 15) -> DataFrame:
    """(a, b, similarity): share of pixels that differ by at most ``near``; 0 for pages of different sizes."""
    a, b = pages.select(F.col("page").alias("a"), F.col("next").alias("b"), F.col("pixels").alias("pa")), other.select(F.col("page").alias("b"), F.col("pixels").alias("pb"))
    near_ones = F.size(F.filter(F.zip_with("pa", "pb", lambda x, y: F.abs(x - y)), lambda d: d <= near))
    same = (F.size("pa") == F.size("pb")) & (F.size("pa") > 0)
    return a.join(b, "b").select("a", "b", F.when(same, near_ones / F.size("pa")).otherwise(F.lit(0.0)).alias("similarity"))
