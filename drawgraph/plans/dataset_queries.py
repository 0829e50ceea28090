"""Queries of detection-dataset preparation, tag mining, retrieval and incremental work."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawgraph.functions.scalars import LINE_PATTERN
from drawgraph.operators import boxes as B
from drawgraph.operators import mentions
from drawgraph.operators import retrieval as R
from drawgraph.operators import tags as T
from drawgraph.plans.registry import Source, query
from drawgraph.streaming import incremental

_STARTS_X = "(SELECT unnest(range(0, 5889, 1152)) AS tx UNION SELECT 7168 - 1280)"
_STARTS_Y = "(SELECT unnest(range(0, 3283, 1152)) AS ty UNION SELECT 4562 - 1280)"


@query("tile_grid", f"SELECT DISTINCT image_id, tx, ty FROM {{boxes}}, {_STARTS_X} x, {_STARTS_Y} y")
def tile_grid(t: Source) -> DataFrame:
    images = t("boxes").select("image_id").distinct().withColumn("width", F.lit(7168)).withColumn("height", F.lit(4562))
    return B.tile_grid(images, "width", "height", 1280, 1152).select("image_id", F.col("tx").cast("bigint").alias("tx"), F.col("ty").cast("bigint").alias("ty"))


@query(
    "tile_boxes",
    f"""WITH c AS (SELECT *, greatest(xmin, tx) AS x0, least(xmin + w, tx + 1280) AS x1, greatest(ymin, ty) AS y0, least(ymin + h, ty + 1280) AS y1
    FROM {{boxes}}, {_STARTS_X} x, {_STARTS_Y} y WHERE w > 0 AND h > 0 AND tx < xmin + w AND tx + 1280 > xmin AND ty < ymin + h AND ty + 1280 > ymin)
    SELECT image_id, ann_id, cls, CAST(tx AS BIGINT) AS tx, CAST(ty AS BIGINT) AS ty, greatest(0, least(1, ((x0 + x1) / 2 - tx) / 1280))::DOUBLE AS cx, greatest(0, least(1, ((y0 + y1) / 2 - ty) / 1280))::DOUBLE AS cy,
    greatest(0, least(1, (x1 - x0) / 1280))::DOUBLE AS bw, greatest(0, least(1, (y1 - y0) / 1280))::DOUBLE AS bh FROM c WHERE (x1 - x0) * (y1 - y0) / (w * h) >= 0.3""",
)
def tile_boxes(t: Source) -> DataFrame:
    found = B.tile_boxes(t("boxes"), 7168, 4562, 1280, 1152)
    return found.withColumn("tx", F.col("tx").cast("bigint")).withColumn("ty", F.col("ty").cast("bigint"))


@query(
    "overlap_grid",
    """WITH s AS (SELECT p_partkey, 1000 + p_size * 37 AS width, 800 + p_size * 11 AS height, r, c FROM {part}, (SELECT unnest([0, 1]) AS r) x, (SELECT unnest([0, 1, 2]) AS c) y),
    z AS (SELECT *, CAST(floor(width / 3) AS BIGINT) AS w, CAST(floor(height / 2) AS BIGINT) AS h FROM s)
    SELECT p_partkey, r, c, greatest(0, c * w - CAST(floor(w * 0.15) AS BIGINT)) AS x0, greatest(0, r * h - CAST(floor(h * 0.15) AS BIGINT)) AS y0,
    least(width, (c + 1) * w + CAST(floor(w * 0.15) AS BIGINT)) AS x1, least(height, (r + 1) * h + CAST(floor(h * 0.15) AS BIGINT)) AS y1 FROM z""",
)
def overlap_grid(t: Source) -> DataFrame:
    sheets = t("part").select("p_partkey", (1000 + F.col("p_size") * 37).alias("width"), (800 + F.col("p_size") * 11).alias("height"))
    return B.overlap_grid(sheets, 2, 3).drop("width", "height")


@query(
    "crop_window",
    """WITH a AS (SELECT ann_id, greatest(0, CAST(floor(xmin - w * 1.5) AS INT)) AS a0, least(7168, CAST(floor(xmin + w + w * 1.5) AS INT)) AS a1, greatest(0, CAST(floor(ymin - h * 1.5) AS INT)) AS b0, least(4562, CAST(floor(ymin + h + h * 1.5) AS INT)) AS b1 FROM {boxes}),
    m AS (SELECT *, greatest(0, CAST(floor((a0 + a1) / 2) AS INT) - 64) AS la, greatest(0, CAST(floor((b0 + b1) / 2) AS INT) - 64) AS lb FROM a)
    SELECT ann_id, CASE WHEN a1 - a0 < 128 THEN la ELSE a0 END AS x0, CASE WHEN a1 - a0 < 128 THEN least(7168, la + 128) ELSE a1 END AS x1,
    CASE WHEN b1 - b0 < 128 THEN lb ELSE b0 END AS y0, CASE WHEN b1 - b0 < 128 THEN least(4562, lb + 128) ELSE b1 END AS y1 FROM m""",
)
def crop_window(t: Source) -> DataFrame:
    return B.crop_window(t("boxes"), 7168, 4562).select("ann_id", "x0", "x1", "y0", "y1")


_SPLIT = """SELECT *, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM (
    SELECT doc_id, lang, lang || '__' || CAST(doc_id AS STRING) AS stem, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || CAST(doc_id AS STRING)), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM {documents}) u"""


def _split(t: Source) -> DataFrame:
    return B.stratified_split(t("documents").select("doc_id", "lang"), "lang", "doc_id")


@query("stratified_split", f"SELECT doc_id, stem, split FROM ({_SPLIT}) v")
def stratified_split(t: Source) -> DataFrame:
    return _split(t).select("doc_id", "stem", "split")


@query("replicate_rows", f"SELECT stem, split FROM ({_SPLIT}) v UNION ALL SELECT 'aug1__' || stem, split FROM ({_SPLIT}) v WHERE split = 'train'")
def replicate_rows(t: Source) -> DataFrame:
    return B.replicate_rows(_split(t)).select("stem", "split")


def _drawn(cls: int, target: int, earlier: str = "") -> str:
    """SQL of one class's turn: rounds over its whole pool, then the tiles of the last, unfinished round."""
    less = f" - (SELECT coalesce(sum(p.n * d.copies), 0) FROM p{cls} p JOIN {earlier} d ON d.tile = p.tile)" if earlier else ""
    return f"""p{cls} AS (SELECT *, sum(n) OVER (ORDER BY md5('42|' || CAST(tile AS STRING) || '|' || CAST(cls AS STRING)), tile ROWS UNBOUNDED PRECEDING) - n AS before FROM t WHERE cls = {cls}),
    n{cls} AS (SELECT greatest({target} - (SELECT sum(n) FROM p{cls}){less}, 0) AS need, (SELECT sum(n) FROM p{cls}) AS round),
    d{cls} AS (SELECT tile, need // round + CASE WHEN before < need % round THEN 1 ELSE 0 END AS copies FROM p{cls}, n{cls})"""


@query(
    "oversample_minority",
    f"""WITH t AS (SELECT CAST(image_id AS BIGINT) AS tile, cls, count(*) AS n FROM {{boxes}} WHERE cls IN (1, 2) GROUP BY ALL), {_drawn(1, 400000)}, {_drawn(2, 600000, "d1")}
    SELECT 1 AS cls, tile, CAST(unnest(range(1, CAST(copies AS BIGINT) + 1)) AS BIGINT) AS copy FROM d1 UNION ALL SELECT 2, tile, CAST(unnest(range(1, CAST(copies AS BIGINT) + 1)) AS BIGINT) FROM d2""",
)
def oversample_minority(t: Source) -> DataFrame:
    tiles = t("boxes").groupBy(F.col("image_id").alias("tile"), "cls").agg(F.count("*").alias("n"))
    return B.oversample_minority(tiles, {1: 400000, 2: 600000})


@query(
    "sample_per_class",
    """WITH a AS (SELECT cls, image_id, ann_id, md5('42|' || CAST(ann_id AS STRING)) AS h FROM {boxes} WHERE least(w, {boxes}.h) >= 20),
    b AS (SELECT *, row_number() OVER (PARTITION BY cls, image_id ORDER BY h, ann_id) AS t FROM a)
    SELECT cls, image_id, ann_id FROM b QUALIFY row_number() OVER (PARTITION BY cls ORDER BY t, h, ann_id) <= 5""",
)
def sample_per_class(t: Source) -> DataFrame:
    return B.sample_per_class(t("boxes"), 5, 20).select("cls", "image_id", "ann_id")


@query(
    "number_rows",
    """SELECT image_id, ann_id, number, CAST(image_id AS STRING) || '_' || lpad(CAST(number AS STRING), 4, '0') AS name FROM (SELECT image_id, ann_id, row_number() OVER (PARTITION BY image_id ORDER BY ann_id) - 1 AS number FROM {boxes}) u""",
)
def number_rows(t: Source) -> DataFrame:
    return B.number_rows(t("boxes"), "image_id", ["ann_id"]).select("image_id", "ann_id", "number", "name")


@query(
    "class_distribution",
    """WITH b AS (SELECT 's' || CAST(image_id % 3 AS STRING) AS split, cls FROM {boxes} WHERE NOT (image_id % 3 = 1 AND cls = 2)), c AS (SELECT split, cls, count(*) AS n FROM b GROUP BY ALL)
    SELECT s.split, k.cls, coalesce(c.n, 0) AS n, coalesce(c.n, 0) / (SELECT count(*) FROM b WHERE b.split = s.split) AS share FROM (SELECT DISTINCT split FROM b) s CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS cls) k LEFT JOIN c ON c.split = s.split AND c.cls = k.cls""",
)
def class_distribution(t: Source) -> DataFrame:
    some = t("boxes").filter("not (image_id % 3 = 1 and cls = 2)").select(F.concat(F.lit("s"), (F.col("image_id") % 3).cast("string")).alias("split"), "cls")
    return B.class_distribution(some, list(range(1, 9)))


@query("detections_report", "SELECT image_id, cls, count(*) AS n FROM {boxes} GROUP BY ALL")
def detections_report(t: Source) -> DataFrame:
    return t("boxes").groupBy("image_id", "cls").agg(F.count("*").alias("n"))


@query(
    "dataset_totals",
    """WITH i AS (SELECT dataset, stem, count(*) FILTER (len(string_split(line, ' ')) = 5) AS n FROM {label_lines} GROUP BY ALL)
    SELECT coalesce(dataset, 'all') AS dataset, count(*) AS images, count(*) FILTER (n > 0) AS labelled, CAST(sum(n) AS BIGINT) AS annotations FROM i GROUP BY ROLLUP (dataset)""",
)
def dataset_totals(t: Source) -> DataFrame:
    images = t("label_lines").groupBy("dataset", "stem").agg(F.count_if(F.size(F.split("line", " ")) == 5).alias("n"))
    return B.dataset_totals(images)


@query(
    "corrupt_lines",
    """WITH f AS (SELECT dataset, list_transform(string_split(line, ' '), lambda x: TRY_CAST(x AS DOUBLE)) AS f FROM {label_lines})
    SELECT dataset, count(*) FILTER (NOT coalesce(len(f) = 5 AND f[1] BETWEEN 0 AND 7 AND f[2] BETWEEN 0 AND 1 AND f[3] BETWEEN 0 AND 1 AND f[4] BETWEEN 0 AND 1 AND f[5] BETWEEN 0 AND 1, false)) AS corrupt FROM f GROUP BY dataset""",
)
def corrupt_lines(t: Source) -> DataFrame:
    return B.corrupt_lines(t("label_lines"), 7)


@query(
    "label_log",
    """WITH s AS (SELECT DISTINCT 'img' || CAST(o_orderkey AS STRING) AS stem FROM {orders}), c AS (SELECT stem, count(*) FILTER (len(string_split(line, ' ')) >= 5) AS ok FROM {label_lines} GROUP BY stem)
    SELECT s.stem, CASE WHEN ok IS NULL THEN 'no label file' ELSE 'no valid line' END AS reason FROM s LEFT JOIN c ON s.stem = c.stem WHERE ok IS NULL OR ok = 0""",
)
def label_log(t: Source) -> DataFrame:
    stems = t("orders").select(F.concat(F.lit("img"), F.col("o_orderkey").cast("string")).alias("stem")).distinct()
    return B.label_log(t("label_lines"), stems)


_PIX = "SELECT vec_id AS image, unnest(embedding) AS e FROM {embeddings}"


def _pixels(t: Source) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("image"), F.explode("embedding").alias("e")).select("image", F.floor((F.col("e").cast("double") + 1) * 127).alias("v"))


@query("dark_density", f"SELECT image, avg(CASE WHEN floor((CAST(e AS DOUBLE) + 1) * 127) < 128 THEN 1 ELSE 0 END) AS share, avg(CASE WHEN floor((CAST(e AS DOUBLE) + 1) * 127) < 128 THEN 1 ELSE 0 END) > 0.5 AS dense FROM ({_PIX}) p GROUP BY image")
def dark_density(t: Source) -> DataFrame:
    return B.dark_density(_pixels(t), 128, 0.5)


@query(
    "blank_filter",
    f"""WITH b AS (SELECT image, avg(CASE WHEN floor((CAST(e AS DOUBLE) + 1) * 127) >= 120 THEN 1 ELSE 0 END) >= 0.7 AS blank FROM ({_PIX}) p GROUP BY image)
    SELECT image, blank, blank AND image NOT IN (SELECT doc_id FROM {{labels}} WHERE doc_id IS NOT NULL) AS dropped FROM b""",
)
def blank_filter(t: Source) -> DataFrame:
    return B.blank_filter(_pixels(t), t("labels").select(F.col("doc_id").alias("image")), 120, 0.7)


@query(
    "page_similarity",
    """SELECT a.vec_id AS a, b.vec_id AS b, len(list_filter(list_zip(a.embedding, b.embedding), lambda x: abs(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) <= 0.1)) / 64 AS similarity FROM {embeddings} a JOIN {embeddings} b ON b.vec_id = a.vec_id + 1""",
)
def page_similarity(t: Source) -> DataFrame:
    pages = t("embeddings").select(F.col("vec_id").alias("page"), (F.col("vec_id") + 1).alias("next"), F.col("embedding").cast("array<double>").alias("pixels"))
    return B.page_similarity(pages, pages, 0.1)


@query(
    "word_windows",
    """WITH a AS (SELECT page, pos, lft, text AS t0, lft + width AS r0, conf AS c0, lead(text, 1) OVER w AS t1, lead(lft + width, 1) OVER w AS r1, lead(conf, 1) OVER w AS c1, lead(text, 2) OVER w AS t2, lead(lft + width, 2) OVER w AS r2, lead(conf, 2) OVER w AS c2 FROM {words} WINDOW w AS (PARTITION BY page ORDER BY pos))
    SELECT page, pos, lft, 1 AS n, t0 AS text, r0 AS "right", c0 AS conf FROM a UNION ALL SELECT page, pos, lft, 2, t0 || ' ' || t1, r1, least(c0, c1) FROM a WHERE t1 IS NOT NULL
    UNION ALL SELECT page, pos, lft, 3, t0 || ' ' || t1 || ' ' || t2, r2, least(c0, c2) FROM a WHERE t2 IS NOT NULL""",
)
def word_windows(t: Source) -> DataFrame:
    return T.word_windows(t("words"))


@query("dedup_same_pos", "SELECT page, pos, tag FROM {tags} QUALIFY row_number() OVER (PARTITION BY page, tag, x, y ORDER BY pos) = 1")
def dedup_same_pos(t: Source) -> DataFrame:
    return T.dedup_same_pos(t("tags")).select("page", "pos", "tag")


_SHORT = "SELECT page, pos, CASE WHEN pos % 3 = 0 THEN substr(tag, 1, 6) ELSE tag END AS tag, x % 3 AS x, 0 AS y FROM {tags}"


@query(
    "drop_prefix_tags",
    f"""WITH s AS ({_SHORT}) SELECT page, pos, tag FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.page = b.page AND a.x = b.x AND a.y = b.y AND starts_with(b.tag, a.tag) AND (length(b.tag) > length(a.tag) OR (b.tag = a.tag AND b.pos < a.pos)))""",
)
def drop_prefix_tags(t: Source) -> DataFrame:
    short = F.when(F.col("pos") % 3 == 0, F.substring("tag", 1, 6)).otherwise(F.col("tag"))
    rows = t("tags").select("page", "pos", short.alias("tag"), (F.col("x") % 3).alias("x"), F.lit(0).alias("y"))
    return T.drop_prefix_tags(rows).select("page", "pos", "tag")


@query("dedup_proximity")
def dedup_proximity(t: Source) -> DataFrame:
    return T.dedup_proximity(t("tags").withColumn("pos", F.col("page") * 100 + F.col("pos")).withColumn("page", F.floor(F.col("page") / 20))).select("page", "pos", "tag", "x", "y", "conf")


@query(
    "aggregate_tags",
    """WITH a AS (SELECT tag, CASE substr(tag, 1, 2) WHEN 'HV' THEN 'valve' WHEN 'PT' THEN 'instrument' ELSE 'unknown' END AS category, substr(tag, 1, 2) AS code, substr(tag, 4) AS number, min(page) AS first_page, count(*) AS n, max(conf) AS best,
    md5(string_agg(CAST(page AS STRING) || ':' || CAST(pos AS STRING) || ':' || CAST(conf AS STRING), ',' ORDER BY page, pos, conf)) AS occurrences FROM (SELECT *, 1 AS one FROM {tags}) t GROUP BY tag),
    c AS (SELECT coalesce(category, 'all') AS category, count(*) AS tags FROM a GROUP BY ROLLUP (category))
    SELECT tag, category, code, number, first_page, n, best, occurrences FROM a UNION ALL SELECT NULL, category, NULL, NULL, NULL, tags, NULL, NULL FROM c""",
)
def aggregate_tags(t: Source) -> DataFrame:
    found = T.aggregate_tags(t("tags"))
    shown = F.transform("occurrences", lambda o: F.concat_ws(":", o["page"].cast("string"), o["pos"].cast("string"), o["conf"].cast("string")))
    counts = T.category_counts(found).select("category", F.col("tags").alias("n"))
    return found.withColumn("occurrences", F.md5(F.array_join(shown, ","))).unionByName(counts, allowMissingColumns=True)


@query("index_by_page", "SELECT page, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags, count(*) AS n FROM {tags} GROUP BY page")
def index_by_page(t: Source) -> DataFrame:
    return T.index_by_page(t("tags")).withColumn("tags", F.array_join("tags", ","))


@query("distinct_lines", "SELECT DISTINCT '20\"-PP01-361-GF' || lpad(CAST(lft AS STRING), 4, '0') || '-B03F9' AS line FROM {words}")
def distinct_lines(t: Source) -> DataFrame:
    from drawgraph.functions.scalars import line_numbers

    text = F.concat(F.lit('at 20"-pp01-361-gf'), F.lpad(F.col("lft").cast("string"), 4, "0"), F.lit("-b03f9 end"))
    return t("words").select(F.explode(line_numbers(text)).alias("line")).distinct()


@query(
    "tags_report",
    """SELECT CASE WHEN grouping(category) = 1 THEN 'all' ELSE category END AS category, CASE WHEN grouping(code) = 1 THEN 'all' ELSE code END AS code, count(*) AS n FROM (SELECT CASE substr(text, 1, 2) WHEN 'HV' THEN 'valve' ELSE 'instrument' END AS category, substr(text, 1, 2) AS code FROM {words} WHERE regexp_matches(text, '^(HV|PT)')) u GROUP BY ROLLUP (category, code)""",
)
def tags_report(t: Source) -> DataFrame:
    from drawgraph.functions.scalars import tag_category

    code = F.regexp_extract("text", "^(HV|PT)", 1)
    rows = t("words").filter(F.col("text").rlike("^(HV|PT)")).select(tag_category(code).alias("category"), code.alias("code"))
    sums = rows.rollup("category", "code").agg(F.count("*").alias("n"), F.grouping("category").alias("_a"), F.grouping("code").alias("_b"))
    return sums.select(F.when(F.col("_a") == 1, "all").otherwise(F.col("category")).alias("category"), F.when(F.col("_b") == 1, "all").otherwise(F.col("code")).alias("code"), "n")


@query(
    "page_groups",
    """WITH p AS (SELECT user_id, event_id AS page, (event_id * 37 % 100) / 100 AS similarity FROM {events}), g AS (SELECT *, CAST(sum(CASE WHEN similarity < 0.7 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY page ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sheet FROM p)
    SELECT user_id, sheet, max(page) AS page FROM g GROUP BY ALL""",
)
def page_groups(t: Source) -> DataFrame:
    pages = t("events").select("user_id", F.col("event_id").alias("page"), ((F.col("event_id") * 37 % 100) / 100).alias("similarity"))
    return T.page_groups(pages, "user_id", 0.7)


#: Texts of 60 orders each: tags with and without hyphen, line numbers and plain words, on lines of one order each.
_PAGES = """SELECT CAST(floor(page / 60) AS BIGINT) AS doc_id, page * 100 + pos AS place, CASE WHEN pos = 1 THEN '{newline}' ELSE ' ' END || CASE pos % 4 WHEN 0 THEN '20"-PP01-361-gf' || lpad(CAST(lft AS STRING), 4, '0') || '-B03F9'
    WHEN 1 THEN lower(text) WHEN 2 THEN replace(text, '-', '') ELSE text || ' line' END AS word FROM {{words}}"""
#: Real tags of drawings, one in thirteen of the numbers.
_TAGS = "SELECT DISTINCT 'HV-' || lpad(CAST(p_partkey % 10000 AS STRING), 4, '0') AS tag FROM {part} WHERE p_partkey % 13 = 0"
_TEXTS = "t AS (SELECT doc_id, string_agg(word, '' ORDER BY place) AS text FROM ({}) u GROUP BY doc_id), g AS ({}), h AS (SELECT *, contains(lower(text), lower(tag)) AS whole FROM t JOIN g ON contains(replace(lower(text), '-', ''), replace(lower(tag), '-', '')))".format(
    _PAGES.format(newline="' || chr(10) || '"), _TAGS
)


_LINE = LINE_PATTERN.replace("{", "{{").replace("}", "}}")


def _texts(t: Source) -> DataFrame:
    words = t.sql(_PAGES.format(newline="\\n"))
    return words.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), "").alias("text"))


@query(
    "tag_context",
    f"""WITH {_TEXTS}, f AS (SELECT doc_id, tag, regexp_extract_all(text, '(?i)[^\\n]{{{{0,120}}}}' || CASE WHEN whole THEN tag ELSE replace(tag, '-', '') END || '[^\\n]{{{{0,120}}}}')[1:2] AS f FROM h WHERE whole OR contains(lower(text), lower(replace(tag, '-', ''))))
    SELECT doc_id, tag, array_to_string(list_transform(f, lambda x: trim(x)), ' | ') AS context FROM f""",
)
def tag_context(t: Source) -> DataFrame:
    return mentions.tag_contexts(_texts(t), t.sql(_TAGS))


@query(
    "lines_near_tag",
    f"""WITH {_TEXTS}, f AS (SELECT doc_id, tag, text, unnest([lower(tag), lower(replace(tag, '-', ''))]) AS form FROM h),
    s AS (SELECT doc_id, tag, text, form, string_split(lower(text), form) AS parts FROM f WHERE contains(lower(text), form)),
    p AS (SELECT doc_id, tag, text, length(form) AS n, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(form) AS BIGINT) AS place FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM s) z),
    w AS (SELECT doc_id, tag, substr(text, greatest(place - 400, 0) + 1, place + n + 400 - greatest(place - 400, 0)) AS around FROM p)
    SELECT DISTINCT doc_id, tag, upper(unnest(regexp_extract_all(around, '{_LINE}'))) AS line FROM w""",
)
def lines_near_tag(t: Source) -> DataFrame:
    return mentions.lines_near_tags(_texts(t), t.sql(_TAGS))


@query(
    "chunk_text",
    r"""WITH RECURSIVE w AS (SELECT doc_id, text, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS a, CASE WHEN 1500 < length(text) AND greatest(p, s) > 750 THEN greatest(p, s) + 1 ELSE 1500 END AS b FROM (
    SELECT doc_id, text, CASE WHEN contains(substr(text, 1, 1500), chr(10) || chr(10)) THEN 1500 - strpos(reverse(substr(text, 1, 1500)), chr(10) || chr(10)) - 1 ELSE -1 END AS p,
    CASE WHEN contains(substr(text, 1, 1500), '. ') THEN 1500 - strpos(reverse(substr(text, 1, 1500)), ' .') - 1 ELSE -1 END AS s FROM {documents} WHERE length(text) > 0) z
    UNION ALL SELECT doc_id, text, k + 1, a, CASE WHEN a + 1500 < length(text) AND greatest(p, s) > 750 THEN a + greatest(p, s) + 1 ELSE a + 1500 END FROM (
    SELECT doc_id, text, k, b - 200 AS a, CASE WHEN contains(substr(text, b - 199, 1500), chr(10) || chr(10)) THEN 1500 - strpos(reverse(substr(text, b - 199, 1500)), chr(10) || chr(10)) - 1 ELSE -1 END AS p,
    CASE WHEN contains(substr(text, b - 199, 1500), '. ') THEN 1500 - strpos(reverse(substr(text, b - 199, 1500)), ' .') - 1 ELSE -1 END AS s FROM w WHERE b - 200 < length(text)) z),
    c AS (SELECT doc_id, k, a AS start, regexp_replace(substr(text, a + 1, b - a), '^\s+|\s+$', '', 'g') AS text FROM w)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS chunk_index, CAST(start AS INT) AS start, md5(text) AS digest FROM c WHERE length(text) > 100""",
)
def chunk_text(t: Source) -> DataFrame:
    return R.chunk_text(t("documents")).select("doc_id", "chunk_index", "start", F.md5("text").alias("digest"))


@query("tag_chunks", "SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'd1,d2' WHEN source = 'src3' THEN 'd3' ELSE 'global' END AS pid_tags FROM {documents}")
def tag_chunks(t: Source) -> DataFrame:
    mapping = t.spark.createDataFrame([("src1", "d1"), ("src1", "d2"), ("src2", "d2"), ("src2", "d1"), ("src3", "d3")], "source string, pid string")
    return R.tag_chunks(t("documents"), mapping, "source").select("doc_id", F.array_join("pid_tags", ",").alias("pid_tags"))


@query("batch_rows", "SELECT doc_id, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 100) AS BIGINT) AS batch, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM {documents}")
def batch_rows(t: Source) -> DataFrame:
    return R.batch_rows(t("documents"), "source", "doc_id").select("doc_id", "batch", "tokens")


@query(
    "rag_topk",
    """WITH c AS (SELECT vec_id, embedding::DOUBLE[] AS e, CASE WHEN vec_id % 5 = 0 THEN 'global' ELSE 'd' || CAST(vec_id % 3 AS STRING) END AS tag FROM {embeddings}),
    q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e, 'd' || CAST(label % 3 AS STRING) AS pid FROM {embeddings} WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, vec_id, list_dot_product(q.e, c.e) / ((sqrt(list_dot_product(q.e, q.e)) + 1e-10) * (sqrt(list_dot_product(c.e, c.e)) + 1e-10)) AS score FROM q JOIN c ON c.tag = q.pid OR c.tag = 'global')
    SELECT query_id, vec_id, round(score, 6) AS score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) u WHERE r <= 5""",
)
def rag_topk(t: Source) -> DataFrame:
    e = t("embeddings")
    chunks = e.select("vec_id", "embedding", F.when(F.col("vec_id") % 5 == 0, "global").otherwise(F.concat(F.lit("d"), (F.col("vec_id") % 3).cast("string"))).alias("tag"))
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.concat(F.lit("d"), (F.col("label") % 3).cast("string")).alias("pid"))
    return R.rag_topk(chunks, queries, 5).withColumn("score", F.round("score", 6))


@query(
    "pack_context",
    """WITH e AS (SELECT source, doc_id, '[' || source || ']' || chr(10) || text AS e FROM {documents}), r AS (SELECT *, sum(length(e)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
    SELECT source, md5(string_agg(e, chr(10) || chr(10) ORDER BY doc_id)) AS digest, count(*) AS n FROM r WHERE run <= 3000 GROUP BY source""",
)
def pack_context(t: Source) -> DataFrame:
    return R.pack_context(t("documents"), "source", "doc_id").select("source", F.md5("context").alias("digest"), "n")


_REQUESTS = "SELECT item_id AS request, CASE item_id % 3 WHEN 0 THEN NULL WHEN 1 THEN item_id * 7 ELSE -item_id END AS doc_id, text AS question FROM {benchmark}"


@query(
    "assemble_context",
    f"""WITH d AS (SELECT doc_id, '# ' || CAST(row_number() OVER (ORDER BY doc_id) AS STRING) || ' source ' || source || chr(10) || coalesce(text, '') || chr(10) || chr(10) AS e,
    sum(length('source ' || source || coalesce(text, '')) + 3) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM {{documents}}), w AS (SELECT CAST((SELECT count(*) FROM {{documents}}) AS STRING) || ' documents' || chr(10) || chr(10) || string_agg(e, '' ORDER BY doc_id) AS whole FROM d WHERE run <= 20000),
    n AS (SELECT conv_id AS request, string_agg(text, chr(10) ORDER BY turn) AS notes FROM {{conversations}} WHERE role = 'assistant' GROUP BY 1)
    SELECT r.request, md5(CASE WHEN r.doc_id IS NULL THEN w.whole WHEN d.doc_id IS NULL THEN 'No document ' || CAST(r.doc_id AS STRING) || '.' || chr(10) || chr(10) ELSE '# ' || d.source || chr(10) || d.text || chr(10) || chr(10) END
    || coalesce('Notes:' || chr(10) || n.notes || chr(10) || chr(10), '') || 'Question: ' || r.question) AS digest FROM ({_REQUESTS}) r CROSS JOIN w LEFT JOIN {{documents}} d ON d.doc_id = r.doc_id LEFT JOIN n ON n.request = r.request""",
)
def assemble_context(t: Source) -> DataFrame:
    notes = t("conversations").filter("role = 'assistant'").select(F.col("conv_id").alias("request"), F.col("turn").alias("k"), "text")
    found = R.assemble_context(t("documents").select("doc_id", "source", "text"), t.sql(_REQUESTS), notes, 20_000)
    return found.select("request", F.md5("context").alias("digest"))


@query(
    "assemble_document_text",
    r"""WITH p AS (SELECT conv_id, 0 AS k, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM {conversations} WHERE role <> 'assistant'),
    c AS (SELECT conv_id, 1 AS k, turn, array_to_string(list_filter(list_transform(string_split(text || ' .  . x', '.'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ' | ') AS t FROM {conversations} WHERE role = 'assistant')
    SELECT conv_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY k, turn, t)) AS digest FROM (SELECT * FROM p UNION ALL SELECT * FROM c) u WHERE t <> '' GROUP BY conv_id""",
)
def assemble_document_text(t: Source) -> DataFrame:
    turns = t("conversations")
    cells = F.split(F.concat("text", F.lit(" .  . x")), r"\.", -1)
    rows = turns.filter("role = 'assistant'").select("conv_id", "turn", cells.alias("cells"))
    return R.assemble_documents(turns.filter("role <> 'assistant'"), "conv_id", "turn", rows).select("conv_id", F.md5("text").alias("digest"))


@query(
    "pending_work",
    """WITH w AS (SELECT DISTINCT l_orderkey AS pid, l_linenumber AS step FROM {lineitem}), d AS (SELECT o_orderkey AS pid, 1 + o_custkey % 7 AS step, count(*) AS n, bool_or(o_orderstatus <> 'F') AS ok FROM {orders} GROUP BY ALL)
    SELECT w.pid, w.step, CASE WHEN n IS NULL THEN 'new' ELSE 'retry' END AS reason FROM w LEFT JOIN d ON w.pid = d.pid AND w.step = d.step WHERE n IS NULL OR (NOT ok AND n < 2)""",
)
def pending_work(t: Source) -> DataFrame:
    wanted = t("lineitem").select(F.col("l_orderkey").alias("pid"), F.col("l_linenumber").alias("step"))
    done = t("orders").select(F.col("o_orderkey").alias("pid"), (1 + F.col("o_custkey") % 7).cast("int").alias("step"), (F.col("o_orderstatus") != "F").alias("ok"))
    return incremental.pending_work(wanted, done, ["pid", "step"])


@query(
    "changed_files",
    """WITH a AS (SELECT doc_id AS path, n_chars AS m FROM {documents} WHERE doc_id % 9 <> 0), b AS (SELECT doc_id AS path, n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS m FROM {documents} WHERE doc_id % 7 <> 0)
    SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.m IS NULL THEN 'new' WHEN a.m IS NULL THEN 'gone' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.m IS NULL OR b.m IS NULL OR a.m <> b.m""",
)
def changed_files(t: Source) -> DataFrame:
    docs = t("documents")
    now = docs.filter("doc_id % 9 <> 0").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("mtime"))
    before = docs.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("path"), (F.col("n_chars") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("mtime"))
    return incremental.changed_files(now, before)
