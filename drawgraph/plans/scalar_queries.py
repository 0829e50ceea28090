"""Queries of the scalar functions (projections, filters)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawgraph.functions import scalars as S
from drawgraph.operators import lists, mentions, merge, validate
from drawgraph.plans.registry import Source, query


@query("norm_tag", "SELECT c_custkey, coalesce(regexp_replace(upper(c_name), '[\\s\\-]', '', 'g'), '') AS tag FROM {customer}")
def norm_tag(t: Source) -> DataFrame:
    return t("customer").select("c_custkey", S.norm_tag(F.col("c_name")).alias("tag"))


@query("norm_tag_strict", "SELECT n_nationkey, coalesce(regexp_replace(upper(n_name), '[\\s\\-_]', '', 'g'), '') AS tag FROM {nation}")
def norm_tag_strict(t: Source) -> DataFrame:
    return t("nation").select("n_nationkey", S.norm_tag_strict(F.col("n_name")).alias("tag"))


@query("norm_ref", "SELECT page_id, coalesce(regexp_replace(upper(url), '[\\s\\-_./]', '', 'g'), '') AS ref FROM {pages}")
def norm_ref(t: Source) -> DataFrame:
    return t("pages").select("page_id", S.norm_ref(F.col("url")).alias("ref"))


@query(
    "tag_suffix_match",
    """SELECT o_orderkey, x <> '' AND y <> '' AND (ends_with(x, y) OR ends_with(y, x)) AS matches FROM (
    SELECT o_orderkey, coalesce(regexp_replace(upper(CAST(o_orderkey AS STRING)), '[\\s\\-_]', '', 'g'), '') AS x,
    coalesce(regexp_replace(upper(CAST(o_custkey % 100 AS STRING)), '[\\s\\-_]', '', 'g'), '') AS y FROM {orders}) u""",
)
def tag_suffix_match(t: Source) -> DataFrame:
    a, b = F.col("o_orderkey").cast("string"), (F.col("o_custkey") % 100).cast("string")
    return t("orders").select("o_orderkey", S.tag_suffix_match(a, b).alias("matches"))


@query("canonical_tag", "SELECT page, pos, regexp_replace(upper(text), '([A-Z]+)[- ]?0*(\\d+)', '\\1-\\2', 'g') AS tag FROM {words}")
def canonical_tag(t: Source) -> DataFrame:
    return t("words").select("page", "pos", S.canonical_tag(F.col("text")).alias("tag"))


@query("list_nodes", "SELECT pid, id, subtype, tag, service FROM {g_nodes} WHERE type = 'valve' AND starts_with(coalesce(subtype, ''), 'valve.s')")
def list_nodes(t: Source) -> DataFrame:
    return lists.list_nodes(t("g_nodes"), "valve", "valve.s").select("pid", "id", "subtype", "tag", "service")


@query(
    "props_summary",
    """SELECT k, array_to_string(list_sort(list_filter([CASE WHEN coalesce(design_pressure, '') <> '' THEN 'design_pressure=' || design_pressure END,
    CASE WHEN coalesce(op_pressure, '') <> '' THEN 'op_pressure=' || op_pressure END, CASE WHEN coalesce(size_code, '') <> '' THEN 'size_code=' || size_code END],
    lambda x: x IS NOT NULL)), ';') AS props, node_seq FROM {p_nodes}""",
)
def props_summary(t: Source) -> DataFrame:
    names = ("design_pressure", "op_pressure", "size_code")
    props = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    kept = lists.props_summary(props)
    shown = F.array_join(F.sort_array(F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return t("p_nodes").select("k", shown.alias("props"), "node_seq")


def _tree(clean: bool) -> str:
    """SQL of a document of four levels with real, made-up and numeric ids; ``clean``: without the made-up ones."""

    def entry(made_up: str, id_: str, before: str = "", after: str = "") -> str:
        text = f"""'{before}"id":"' || {id_} || '"{after}'"""
        return f"CASE WHEN {made_up} THEN '' ELSE {text} END" if clean else text

    a = entry("k % 4 < 2", "CASE k % 4 WHEN 0 THEN 'V_r1c' || CAST(k AS STRING) WHEN 1 THEN 'Spec_Break_7' ELSE id END", after=",")
    b = entry("k % 5 < 2", "CASE k % 5 WHEN 0 THEN 'term_1' WHEN 1 THEN 'a_TILE_b' WHEN 2 THEN 'my_term_1' ELSE tag END", before=",")
    c = "CASE k % 3 WHEN 0 THEN 'anno_2' WHEN 1 THEN 'x_osbl' ELSE 'r1c1_' || id END"
    inner, alone = entry("k % 3 < 2", c, before=","), entry("k % 3 < 2", c)
    parts = ["'{{'", a, """'"tag":"_osbl","near":[{{"kind":"id"'""", b, """',"at":{{"x":1'""", inner, "'}}}},{{'", alone, """'}},"term_1"],"n":[[{{"id":' || CAST(k AS STRING) || '}}]]}}'"""]
    return f"SELECT node_seq, {' || '.join(parts)} AS doc FROM {{g_nodes}} WHERE tag IS NOT NULL"


@query("strip_auto_ids", _tree(clean=True))
def strip_auto_ids(t: Source) -> DataFrame:
    return t.sql(_tree(clean=False)).select("node_seq", lists.strip_auto_ids(F.col("doc")).alias("doc"))


@query("first_number", "SELECT p_partkey, TRY_CAST(nullif(regexp_extract(p_brand, '[\\d.]+', 0), '') AS DOUBLE) AS n FROM {part}")
def first_number(t: Source) -> DataFrame:
    return t("part").select("p_partkey", S.first_number(F.col("p_brand")).alias("n"))


@query("norm_size", "SELECT p_partkey, regexp_replace(lower(p_name), '[\\s\"''in]', '', 'g') AS size FROM {part}")
def norm_size(t: Source) -> DataFrame:
    return t("part").select("p_partkey", S.norm_size(F.col("p_name")).alias("size"))


@query(
    "split_compound_tag",
    """SELECT o_orderkey, unnest([t, 'PT-' || CAST(o_orderkey AS STRING) || 'B', 'B', 'PT-' || CAST(o_orderkey AS STRING) || 'C', 'C']) AS candidate
    FROM (SELECT o_orderkey, 'PT-' || CAST(o_orderkey AS STRING) || 'A' AS t FROM {orders}) u""",
)
def split_compound_tag(t: Source) -> DataFrame:
    tag = F.concat(F.lit("PT-"), F.col("o_orderkey").cast("string"), F.lit("A/B,C"))
    return t("orders").select("o_orderkey", F.explode(S.split_compound(tag)).alias("candidate"))


@query("px_to_pt", "SELECT page, pos, round(lft * 72.0 / 300, 2)::DOUBLE AS x, round(top * 72.0 / 300, 2)::DOUBLE AS y FROM {words}")
def px_to_pt(t: Source) -> DataFrame:
    return t("words").select("page", "pos", S.px_to_pt(F.col("lft"), 300).alias("x"), S.px_to_pt(F.col("top"), 300).alias("y"))


@query(
    "unrotate_bbox",
    """SELECT page, pos, greatest(0, CASE rotation WHEN 90 THEN 2000 - top - height WHEN 180 THEN 2000 - lft - width WHEN 270 THEN top ELSE lft END) AS x,
    greatest(0, CASE rotation WHEN 90 THEN lft WHEN 180 THEN 1500 - top - height WHEN 270 THEN 1500 - lft - width ELSE top END) AS y,
    CASE WHEN rotation IN (90, 270) THEN height ELSE width END AS w, CASE WHEN rotation IN (90, 270) THEN width ELSE height END AS h FROM {words}""",
)
def unrotate_bbox(t: Source) -> DataFrame:
    box = S.unrotate_box(*[F.col(c) for c in ("lft", "top", "width", "height", "rotation")], 2000, 1500)
    return t("words").select("page", "pos", box.alias("b")).select("page", "pos", "b.x", "b.y", "b.w", "b.h")


#: All codes of the tag grammar and one that is none; a word has the one that its place picks.
_CODES = (*S.VALVE_CODES, *S.INSTRUMENT_CODES, "QQ")
_CODE_SQL = "[" + ", ".join(f"'{c}'" for c in _CODES) + f"][CAST(1 + (lft * 7 + top) % {len(_CODES)} AS INT)]"


def _code() -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in _CODES]), (1 + (F.col("lft") * 7 + F.col("top")) % len(_CODES)).cast("int"))


def _quoted(codes: tuple[str, ...]) -> str:
    return ", ".join(f"'{c}'" for c in codes)


@query(
    "tag_category",
    f"SELECT page, pos, code, CASE WHEN code IN ({_quoted(S.VALVE_CODES)}) THEN 'valve' WHEN code IN ({_quoted(S.INSTRUMENT_CODES)}) THEN 'instrument' ELSE 'unknown' END AS category FROM (SELECT page, pos, {_CODE_SQL} AS code FROM {{words}}) u",
)
def tag_category(t: Source) -> DataFrame:
    return t("words").select("page", "pos", _code().alias("code"), S.tag_category(F.lower(_code())).alias("category"))


@query(
    "match_tags",
    f"""SELECT page, pos, code || '-' || d || CASE pos % 4 WHEN 0 THEN '' WHEN 1 THEN '/' || d || '7' WHEN 2 THEN chr(92) || d ELSE 'A' END AS tag FROM (SELECT page, pos, {_CODE_SQL} AS code, lpad(CAST(lft AS STRING), 4, '0') AS d FROM {{words}}) u WHERE code <> 'QQ'""",
)
def match_tags(t: Source) -> DataFrame:
    digits = F.lpad(F.col("lft").cast("string"), 4, "0")
    k = F.col("pos") % 4
    gap = F.when(k == 0, " ").when(k == 1, "-").otherwise("")
    tail = F.when(k == 0, "").when(k == 1, F.concat(F.lit("/"), digits, F.lit("7"))).when(k == 2, F.concat(F.lit("\\"), digits)).otherwise("a")
    text = F.concat(F.lit("see "), F.when(k == 3, _code()).otherwise(F.lower(_code())), gap, digits, tail, F.lit(", next"))
    return t("words").select("page", "pos", F.explode(S.match_tags(text)).alias("tag"))


@query("extract_line_numbers", "SELECT page, pos, '20\"-PP01-361-GF' || lpad(CAST(lft AS STRING), 4, '0') || '-B03F9' AS line FROM {words}")
def extract_line_numbers(t: Source) -> DataFrame:
    line = F.concat(F.lit('20"-pp01-361-gf'), F.lpad(F.col("lft").cast("string"), 4, "0"), F.lit("-b03f9"))
    return t("words").select("page", "pos", F.explode(S.line_numbers(F.concat(F.lit("on "), line, F.lit(" and "), line))).alias("line"))


@query(
    "yolo_line",
    """SELECT image_id, ann_id, cls, greatest(0.0, least(1.0, (xmin + w / 2) / 7168)) AS cx, greatest(0.0, least(1.0, (ymin + h / 2) / 4562)) AS cy,
    greatest(0.0, least(1.0, w / 7168)) AS bw, greatest(0.0, least(1.0, h / 4562)) AS bh FROM {boxes} WHERE w > 0 AND h > 0""",
)
def yolo_line(t: Source) -> DataFrame:
    box = S.yolo_box(*[F.col(c) for c in ("xmin", "ymin", "w", "h")], 7168, 4562)
    return t("boxes").select("image_id", "ann_id", "cls", box.alias("b")).filter("b is not null").select("image_id", "ann_id", "cls", "b.*")


@query(
    "remap_class",
    """SELECT stem, ann_id, new_cls FROM (SELECT stem, ann_id, CASE WHEN regexp_full_match(line, '\\d+( [0-9.]+){{4}}') AND CAST(split_part(line, ' ', 1) AS INT) BETWEEN 1 AND 7
    THEN CAST(split_part(line, ' ', 1) AS INT) - 1 END AS new_cls FROM (SELECT 'o' || CAST(CAST(floor(ann_id / 1000000) AS BIGINT) AS STRING) AS stem, ann_id, line FROM {label_lines}) v) u QUALIFY bool_and(new_cls IS NOT NULL) OVER (PARTITION BY stem)""",
)
def remap_class(t: Source) -> DataFrame:
    mapping = {i: i - 1 for i in range(1, 8)}
    files = t("label_lines").withColumn("stem", F.concat(F.lit("o"), F.floor(F.col("ann_id") / 1000000).cast("string")))
    return lists.remap_classes(files, mapping).select("stem", "ann_id", "new_cls")


@query(
    "norm_class_label",
    "SELECT o_orderkey, CASE trim(o_orderpriority) WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' ELSE lower(trim(o_orderpriority)) END AS label FROM {orders}",
)
def norm_class_label(t: Source) -> DataFrame:
    return t("orders").select("o_orderkey", lists.norm_class_label(F.col("o_orderpriority"), {"1-URGENT": "urgent", "2-HIGH": "high"}).alias("label"))


@query(
    "lenient_json",
    """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST(props->>'k' AS BIGINT) END AS k, event_id % 5 = 4 AS parse_error FROM {events}""",
)
def lenient_json(t: Source) -> DataFrame:
    p = F.col("props")
    kind = F.col("event_id") % 5
    text = (
        F.when(kind == 0, p)
        .when(kind == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Here is the result.\n\n"), p))
        .when(kind == 3, F.regexp_replace(p, "}$", ",}"))
        .otherwise(F.lit("no json"))
    )
    found = t("events").select("event_id", S.lenient_json(text).alias("x"))
    return found.select("event_id", F.get_json_object("x.json", "$.k").cast("bigint").alias("k"), "x.parse_error")


@query(
    "pid_from_name",
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN lpad(CAST(page_id % 10000 AS STRING), 4, '0') ELSE 'sheet' || CAST(page_id AS STRING) END AS pid FROM {pages}""",
)
def pid_from_name(t: Source) -> DataFrame:
    i = F.col("page_id")
    name = F.when(i % 2 == 0, F.concat(F.lit("/a/b/X-PID-"), F.lpad((i % 10000).cast("string"), 4, "0"), F.lit(".pdf"))).otherwise(
        F.concat(F.lit("/a/sheet"), i.cast("string"), F.lit(".pdf"))
    )
    return t("pages").select("page_id", S.pid_from_name(name).alias("pid"))


@query(
    "tile_key",
    "SELECT seq, CAST(substr(tile, 2, 1) AS INT) AS row, CAST(substr(tile, 4, 1) AS INT) AS col FROM {x_components}",
)
def tile_key(t: Source) -> DataFrame:
    return t("x_components").select("seq", S.tile_key(F.col("tile")).alias("k")).select("seq", "k.row", "k.col")


@query(
    "call_cost",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity * coalesce(r.i, 0) + l_extendedprice * coalesce(r.o, 0)) / 1e6 AS cost
    FROM {lineitem} LEFT JOIN (VALUES ('A', 3.0, 15.0), ('N', 1.0, 5.0)) r(m, i, o) ON l_returnflag = r.m""",
)
def call_cost(t: Source) -> DataFrame:
    rates = {"A": (3.0, 15.0), "N": (1.0, 5.0)}
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", lists.call_cost(F.col("l_returnflag"), F.col("l_quantity"), F.col("l_extendedprice"), rates).alias("cost"))


@query(
    "title_block",
    r"""SELECT doc_id, l[1] AS title, l[2] AS system FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS l FROM {documents}) u""",
)
def title_block(t: Source) -> DataFrame:
    return lists.title_block(t("documents")).select("doc_id", "title", "system")


@query(
    "text_preview",
    r"SELECT doc_id, regexp_replace(replace(substr(text, 1, 500), chr(10), ' '), '^\s+|\s+$', '', 'g') AS preview, length(text) AS size FROM {documents}",
)
def text_preview(t: Source) -> DataFrame:
    return t("documents").select("doc_id", S.text_preview(F.col("text")).alias("preview"), F.length("text").cast("long").alias("size"))


#: Messages that name drawings in all three forms, some twice, some unknown.
_MESSAGES = """SELECT o_orderkey AS k, 'a [doc_id:PID-' || lpad(CAST(o_orderkey % 20 AS STRING), 4, '0') || '.pdf] b [pid-' || lpad(CAST(o_custkey % 20 AS STRING), 3, '0') || '] c PID-' || lpad(CAST(o_orderkey % 7 AS STRING), 4, '0')
    || CASE WHEN o_orderkey % 3 = 0 THEN ', Pid-' || lpad(CAST(o_orderkey % 7 AS STRING), 4, '0') ELSE ', PID-' || lpad(CAST(o_custkey % 20 AS STRING), 3, '0') || 'x' END || ' [doc_id:none]' AS text FROM {orders}"""


def _linked(source: str, k: str, pattern: str, number: str, key: str, seen: str) -> str:
    """SQL of one round: matches and what stands between them; the first of a known key becomes a link."""
    return f"""{k}m AS (SELECT k, text, {seen} AS seen, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS gaps FROM {source}),
    {k}n AS (SELECT *, list_transform(m, lambda x: {number}) AS nums, list_transform(m, lambda x: CASE WHEN TRY_CAST({number} AS INT) < 10 THEN {key} END) AS keys FROM {k}m),
    {k} AS (SELECT k, list_concat(seen, list_filter(keys, lambda x: x IS NOT NULL)) AS seen, gaps[1] || coalesce(array_to_string(list_transform(range(1, len(m) + 1), lambda i: CASE WHEN keys[i] IS NOT NULL AND list_position(keys, keys[i]) = i AND NOT list_contains(seen, keys[i])
    THEN '[PID-' || nums[i] || '](#pid-d' || nums[i] || ')' ELSE m[i] END || gaps[i + 1]), ''), '') AS text FROM {k}n)"""


_FOUR, _SOME = "regexp_extract(x, 'PID-(\\d{{4}})', 1)", "regexp_extract(x, '(?i)PID-(\\d{{3,4}})', 1)"


@query(
    "link_drawing_refs",
    f"""WITH s AS ({_MESSAGES}), {_linked("s", "a", "(?i)\\[doc_id:[^\\]]+\\]", _FOUR, _FOUR, "CAST([] AS STRING[])")},
    {_linked("a", "b", "(?i)\\[PID-\\d{{3,4}}\\]", f"lpad({_SOME}, 4, '0')", f"lpad({_SOME}, 4, '0')", "seen")}, {_linked("b", "c", "(?i)\\bPID-\\d{{3,4}}\\b", f"lpad({_SOME}, 4, '0')", _SOME, "CAST([] AS STRING[])")}
    SELECT k, text FROM c""",
)
def link_drawing_refs(t: Source) -> DataFrame:
    number = F.lpad(F.col("id").cast("string"), 4, "0")
    mapping = t.spark.range(10).select(number.alias("number"), F.concat(F.lit("d"), number).alias("target"))
    return mentions.link_drawing_refs(t.sql(_MESSAGES), ["k"], mapping)


@query(
    "compact_entities",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY node_seq) AS r FROM {p_nodes} WHERE tag <> ''), e AS (SELECT e.*, n.pid, row_number() OVER (PARTITION BY n.pid ORDER BY edge_seq) AS r FROM {g_edges} e JOIN {g_nodes} n ON n.id = e.src)
    SELECT pid, 'node' AS kind, id, '{{"id":"' || id || '","type":"' || type || '"' || coalesce(',"subtype":"' || subtype || '"', '') || ',"tag":"' || tag || '"' || coalesce(',"service":"' || service || '"', '') || CASE WHEN op_pressure <> '' THEN ',"op_pressure":"' || op_pressure || '"' ELSE '' END || '}}' AS body FROM n WHERE r <= 100
    UNION ALL SELECT pid, 'edge', id, '{{"id":"' || id || '","src":"' || src || '","dst":"' || dst || '","kind":"' || kind || '"}}' FROM e WHERE r <= 150""",
)
def compact_entities(t: Source) -> DataFrame:
    nodes = t("p_nodes").select("pid", "node_seq", "id", "type", "subtype", "tag", "service", "op_pressure")
    edges = validate.with_pid(t("g_edges"), t("g_nodes")).select("pid", "edge_seq", "id", "src", "dst", "kind")
    return lists.compact_entities(nodes, edges)


_SUBTYPES = [*S.SUBTYPE_CODES, "nozzle.inlet", "pump.x"]
#: Components with and without tags, references and spec breaks of drawings.
_PARTS = f"""SELECT 'd' || CAST(seq % 50 AS STRING) AS pid, seq, id || '_' || CAST(seq AS STRING) AS id, split_part('{",".join(_SUBTYPES)}', ',', CAST(1 + seq % {len(_SUBTYPES)} AS INT)) AS subtype,
    replace(tag, '-', ' - ') || CAST(seq % 3 AS STRING) AS tag, CASE WHEN seq % 4 > 0 THEN 'LO' END AS normal_position, CASE WHEN seq % 3 = 0 THEN '' ELSE CAST(seq % 70 AS STRING) END AS design_pressure FROM {{x_components}}"""
_REFS = "SELECT 'd' || CAST(s_suppkey % 50 AS STRING) AS pid, s_suppkey AS seq, 'To ' || s_name AS ref FROM {supplier}"
_BREAKS = "SELECT 'd' || CAST(p_partkey % 50 AS STRING) AS pid, p_partkey AS seq, p_brand AS from_spec, CASE WHEN p_partkey % 4 > 0 THEN p_type END AS to_spec FROM {part}"
_TYPES = " ".join(f"WHEN '{c}' THEN '{S.SUBTYPE_CODES[c].split('.')[0]}'" for c in S.SUBTYPE_CODES)


@query(
    "type_map",
    f"""WITH c AS (SELECT pid, seq, coalesce(replace(tag, ' ', ''), id) AS id, CASE subtype {_TYPES} WHEN 'nozzle.inlet' THEN 'nozzle' ELSE 'annotation' END AS type, subtype, tag,
    '{{{{' || array_to_string(list_filter([CASE WHEN normal_position IS NOT NULL THEN '"normal_position":"' || normal_position || '"' END, CASE WHEN design_pressure <> '' THEN '"design_pressure":"' || design_pressure || '"' END], lambda x: x IS NOT NULL), ',') || '}}}}' AS props FROM ({_PARTS}) u)
    SELECT pid, id, type, subtype, tag, NULL AS off_page_ref, props FROM c QUALIFY row_number() OVER (PARTITION BY pid, id ORDER BY seq) = 1
    UNION ALL SELECT pid, 'term_' || CAST(seq AS STRING), 'terminator', NULL, NULL, ref, '{{{{}}}}' FROM ({_REFS}) v
    UNION ALL SELECT pid, 'spec_break_' || CAST(seq AS STRING), 'junction', NULL, NULL, NULL, '{{{{"spec_change":true,"from_spec":"' || from_spec || '"' || coalesce(',"to_spec":"' || to_spec || '"', '') || '}}}}' FROM ({_BREAKS}) w""",
)
def type_map(t: Source) -> DataFrame:
    fields = F.create_map(*[x for c in ("normal_position", "design_pressure") for x in (F.lit(c), F.col(c))])
    return merge.graph_nodes(t.sql(_PARTS).withColumn("fields", fields), t.sql(_REFS), t.sql(_BREAKS))


@query(
    "check_schema",
    f"""SELECT id, 'bad type' AS issue FROM {{g_nodes}} WHERE CASE k % 40 WHEN 0 THEN 'line' WHEN 1 THEN 'nozzle' ELSE type END NOT IN ({_quoted(S.NODE_TYPES)})
    UNION ALL SELECT id, 'bad status' FROM {{g_nodes}} WHERE k % 6 = 5 UNION ALL SELECT id, 'bad layer' FROM {{g_nodes}} WHERE k % 8 = 7
    UNION ALL SELECT id, 'bad kind' FROM {{g_edges}} WHERE CASE kind WHEN 'impulse' THEN 'electrical' WHEN 'containment' THEN 'association' ELSE kind END NOT IN ({_quoted(S.EDGE_KINDS)})
    UNION ALL SELECT id, 'bad flow_dir' FROM {{g_edges}} WHERE kind = 'signal'
    UNION ALL SELECT id, 'no tag' FROM {{g_nodes}} WHERE tag IS NULL
    UNION ALL SELECT id, 'dangling end' FROM {{g_edges}} WHERE src NOT IN (SELECT id FROM {{g_nodes}} WHERE k % 50 <> 0) OR dst NOT IN (SELECT id FROM {{g_nodes}} WHERE k % 50 <> 0)""",
)
def check_schema(t: Source) -> DataFrame:
    k, kind = F.col("k"), F.col("kind")
    pick = lambda values, bad: F.get(F.array(*[F.lit(x) for x in (*values, bad)]), (k % (len(values) + 1)).cast("int"))
    nodes = t("g_nodes").withColumn("type", F.when(k % 40 == 0, "line").when(k % 40 == 1, "nozzle").otherwise(F.col("type")))
    nodes = nodes.withColumns({"status": pick(S.STATUSES, "lost"), "layer": pick(S.LAYERS, "air")})
    edges = t("g_edges").withColumns(
        {
            "flow_dir": F.when(kind == "process", "uni").when(kind == "impulse", "bi").when(kind == "signal", "tri"),
            "kind": F.when(kind == "impulse", "electrical").when(kind == "containment", "association").otherwise(kind),
        }
    )
    return (
        lists.check_nodes(nodes, S.NODE_TYPES, ("tag",))
        .unionByName(lists.check_values(nodes, {"status": S.STATUSES, "layer": S.LAYERS}))
        .unionByName(lists.check_values(edges, {"kind": S.EDGE_KINDS, "flow_dir": S.FLOW_DIRS}))
        .unionByName(lists.dangling(edges, nodes.filter("k % 50 <> 0")))
    )
