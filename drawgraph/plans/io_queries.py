"""Queries of readers and writers over rows that hold what the files would, and of the batch tools."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawgraph.operators import graph, tools
from drawgraph.operators.lineage import cut_lineage, tidy
from drawgraph.plans import validate_queries
from drawgraph.plans.registry import Source, query
from drawgraph.sources import corpus, readers, schemas, sinks


def _documents(t: Source) -> DataFrame:
    """Graph documents of about a hundred keys each, as JSON text."""
    pid = F.concat("pid", F.lit("-"), F.floor(F.col("k") / 100).cast("string"))
    nodes = t("g_nodes").withColumn("pid", pid).select("pid", "node_seq", "id", "type", "subtype", "tag", "service", "loop_id", "off_page_ref")
    edges = t("g_edges")
    owner = nodes.select("pid", F.col("id").alias("dst"))
    owned = cut_lineage(edges.join(owner, "dst").select("pid", "edge_seq", "id", "src", "dst", "kind"))
    return sinks.graph_json(nodes, owned)


def _folder(t: Source, name: str) -> str:
    """A new folder that all executors share, for a query that writes and reads back."""
    return f"{graph.shared_folder(t.spark)}/drawgraph-{name}-{uuid.uuid4().hex}"


@query("scan_graph", "SELECT pid || '-' || CAST(CAST(floor(k / 100) AS BIGINT) AS STRING) AS pid, id, type, subtype, tag FROM {g_nodes}")
def scan_graph(t: Source) -> DataFrame:
    nodes, _ = readers.explode_graphs(readers.parse_graphs(_documents(t)))
    return nodes.select("pid", "id", "type", "subtype", "tag")


@query("write_graph", "SELECT n.pid || '-' || CAST(CAST(floor(n.k / 100) AS BIGINT) AS STRING) AS pid, e.src, e.dst, e.kind FROM {g_edges} e JOIN {g_nodes} n ON e.dst = n.id")
def write_graph(t: Source) -> DataFrame:
    folder = _folder(t, "graphs")
    with tidy(t.spark):
        _documents(t).write.option("compression", "lz4").json(folder)
    _, edges = readers.explode_graphs(readers.parse_graphs(t.spark.read.schema("pid string, json string").json(folder)))
    return edges.select("pid", "src", "dst", "kind")


@query("scan_tile_extractions", "SELECT tile, pass, id, type, tag FROM {x_components}")
def scan_tile_extractions(t: Source) -> DataFrame:
    rows = t("x_components").select("tile", "pass", F.floor(F.col("seq") / 1000).alias("k"), F.struct("id", "type", "tag").alias("c"))
    files = rows.groupBy("tile", "pass", "k").agg(F.collect_list("c").alias("components")).select(F.to_json(F.struct("tile", "pass", "components")).alias("json"))
    return readers.tile_components(files.select(F.from_json("json", schemas.TILE).alias("d")).select("d.*")).select("tile", "pass", "id", "type", "tag")


@query("scan_tag_lists", "SELECT event_id, unnest(['T-' || event_type, 'U-' || CAST(user_id AS STRING)]) AS tag FROM {events}")
def scan_tag_lists(t: Source) -> DataFrame:
    a, b = F.concat(F.lit("T-"), "event_type"), F.concat(F.lit("U-"), F.col("user_id").cast("string"))
    objects = F.to_json(F.array(F.struct(a.alias("tag")), F.struct(b.alias("tag"))))
    scalars = F.to_json(F.array(a, b))
    k = F.col("event_id") % 4
    text = F.when(k == 0, objects).when(k == 1, scalars)
    for i, name in ((2, "tags"), (3, "items")):
        text = text.when(k == i, F.concat(F.lit('{"' + name + '":'), objects if i == 2 else scalars, F.lit("}")))
    return t("events").select("event_id", F.explode(readers.tag_list(text)).alias("tag"))


@query("scan_reference_sheets", "SELECT p_partkey AS tag, p_name AS name, p_size AS col_2 FROM {part} WHERE p_partkey % 5 <> 0")
def scan_reference_sheets(t: Source) -> DataFrame:
    some = lambda c: F.when(F.col("p_partkey") % 5 != 0, F.col(c))
    return readers.clean_sheet(t("part").select(some("p_partkey").alias(" tag "), some("p_name").alias("name"), some("p_size").alias("_c2")))


@query(
    "scan_yolo_labels",
    """SELECT stem, CAST(split_part(line, ' ', 1) AS INT) AS cls, TRY_CAST(split_part(line, ' ', 2) AS DOUBLE) AS cx, TRY_CAST(split_part(line, ' ', 3) AS DOUBLE) AS cy, TRY_CAST(split_part(line, ' ', 4) AS DOUBLE) AS bw, TRY_CAST(split_part(line, ' ', 5) AS DOUBLE) AS bh
    FROM {label_lines} WHERE len(string_split(line, ' ')) = 5""",
)
def scan_yolo_labels(t: Source) -> DataFrame:
    return readers.yolo_fields(t("label_lines"))


@query(
    "scan_graphml",
    """SELECT 'g' || CAST(l_orderkey % 32 AS STRING) AS stem, 'n' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '_' || CAST(l_partkey AS STRING) AS node, l_returnflag || '<&' AS label,
    CAST(l_partkey AS DOUBLE) AS xmin, CAST(l_suppkey AS DOUBLE) AS ymin, CASE WHEN l_partkey % 3 > 0 THEN CAST(l_partkey + 10 AS DOUBLE) END AS xmax, l_suppkey + 0.5 AS ymax FROM {lineitem}""",
)
def scan_graphml(t: Source) -> DataFrame:
    """The lines as nodes of 32 files, with a namespace, replaced and empty data and CDATA, which the reader takes back."""
    key = lambda i, a: f'<key id="{i}" for="node" attr.name="{a}"/>'
    head = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">' + key("k0", "label") + key("k1", "xmin") + key("k2", "ymin") + key("k3", "xmax") + key("k4", "ymax") + "<graph>"
    data = lambda i, v: F.concat(F.lit(f'<data key="{i}">'), v.cast("string"), F.lit("</data>"))
    node = F.concat(
        F.lit('<node id="n'), F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey"), F.lit('">'), data("k0", F.lit("old")), data("k0", F.concat(F.lit("<![CDATA["), "l_returnflag", F.lit("<&]]>"))),
        data("k1", F.col("l_partkey")), F.lit('<data key="k1"/>'), data("k2", F.col("l_suppkey")), F.when(F.col("l_partkey") % 3 > 0, data("k3", F.col("l_partkey") + 10)).otherwise(F.lit("")), data("k4", F.col("l_suppkey") + 0.5), F.lit("</node>"),
    )
    rows = t("lineitem").select((F.col("l_orderkey") % 32).alias("g"), F.lit(1).alias("o"), node.alias("value"))
    files = t.spark.range(32).select(F.col("id").alias("g"))
    rows = rows.unionByName(files.select("g", F.lit(0).alias("o"), F.lit(head).alias("value"))).unionByName(files.select("g", F.lit(2).alias("o"), F.lit("</graph></graphml>").alias("value")))
    folder = _folder(t, "graphml")
    rows.repartition(32, "g").sortWithinPartitions("g", "o").select("g", "value").write.partitionBy("g").text(folder)
    stem = F.concat(F.lit("g"), F.regexp_extract("file_path", r"/g=(\d+)/", 1))
    return readers.read_graphml(t.spark, folder, stem)


@query("scan_pixel_csv", "SELECT vec_id, list_sum(embedding::DOUBLE[]) > 0 AS positive, CAST(label AS STRING) AS label FROM {embeddings}")
def scan_pixel_csv(t: Source) -> DataFrame:
    line = F.concat_ws(",", F.array_join(F.col("embedding").cast("array<double>").cast("array<string>"), ","), F.col("label").cast("string"))
    rows = readers.pixel_rows(t("embeddings").select("vec_id", line.alias("line")), 64)
    return rows.select("vec_id", (F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x) > 0).alias("positive"), "label")


@query(
    "scan_text_corpus",
    "SELECT 'f' || CAST(doc_id % 64 AS STRING) AS name, md5(string_agg(text || chr(10), '' ORDER BY doc_id)) AS digest, CAST(sum(length(text) + 1) AS BIGINT) AS chars, 1 AS version FROM {documents} WHERE text IS NOT NULL GROUP BY doc_id % 64",
)
def scan_text_corpus(t: Source) -> DataFrame:
    """The texts in 64 files, which a stored corpus takes up; a second refresh reads none of them."""
    folder, store = _folder(t, "texts"), _folder(t, "corpus")
    texts = t("documents").filter("text is not null").select((F.col("doc_id") % 64).alias("f"), "doc_id", F.col("text").alias("value"))
    texts.repartition(64, "f").sortWithinPartitions("f", "doc_id").select("f", "value").write.partitionBy("f").text(folder)
    corpus.refresh(t.spark, folder, store, "*.txt")
    last = corpus.refresh(t.spark, folder, store, "*.txt")
    name = F.concat(F.lit("f"), F.regexp_extract("path", r"/f=(\d+)/", 1))
    return corpus.read(t.spark, store, last.version).select(name.alias("name"), F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("chars"), F.lit(last.version).alias("version"))


@query("scan_vector_index", "SELECT vec_id, label, CAST(len(embedding) AS INT) AS dims FROM {embeddings}")
def scan_vector_index(t: Source) -> DataFrame:
    return readers.read_index(t.spark, f"{t.sf_dir}/embeddings.parquet").select("vec_id", "label", F.size("embedding").alias("dims"))


@query("scan_splits", "SELECT image_id, ann_id, 'img' || CAST(ann_id AS STRING) AS stem FROM {boxes}")
def scan_splits(t: Source) -> DataFrame:
    line = F.concat(F.lit("/data/set/img"), F.col("ann_id").cast("string"), F.lit(".png "))
    return readers.split_stems(t("boxes").select("image_id", "ann_id", line.alias("line"))).select("image_id", "ann_id", "stem")


@query("write_index", "SELECT doc_id, source, pid_tag, n FROM {chunks}")
def write_index(t: Source) -> DataFrame:
    folder = _folder(t, "index")
    sinks.write_index(t("chunks").select("doc_id", "source", "pid_tag", F.col("n").cast("bigint").alias("n")), folder)
    return readers.read_index(t.spark, folder)


@query("write_manifest", "SELECT stem, dataset AS source, CASE WHEN ann_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS ann_count FROM {label_lines} GROUP BY ALL")
def write_manifest(t: Source) -> DataFrame:
    split = F.when(F.col("ann_id") % 10 == 0, "val").otherwise("train")
    folder = _folder(t, "manifest")
    sinks.write_manifest(t("label_lines").select("stem", F.col("dataset").alias("source"), split.alias("split")), folder)
    return t.spark.read.option("header", True).schema("stem string, source string, split string, ann_count long").csv(folder)


@query("write_report", """SELECT '{{"nodes":' || CAST((SELECT count(*) FROM {g_nodes}) AS STRING) || ',"edges":' || CAST((SELECT count(*) FROM {g_edges}) AS STRING) || '}}' AS report""")
def write_report(t: Source) -> DataFrame:
    folder = _folder(t, "report")
    sinks.write_report(folder, nodes=t("g_nodes"), edges=t("g_edges"))
    return t.spark.read.text(folder).select(F.col("value").alias("report"))


#: Calls of the tools that SQL can answer, and of one that doesn't exist.
_CALLS = """SELECT o_orderkey AS call_id, CASE o_orderkey % 5 WHEN 0 THEN 'get_node' WHEN 1 THEN 'list_nodes' WHEN 2 THEN 'graph_summary' WHEN 3 THEN 'search_nodes' ELSE 'other' END AS tool,
    '{{"tag":"PT-' || lpad(CAST(o_orderkey + o_orderkey % 3 AS STRING), 6, '0') || '","node_type":"' || CASE WHEN o_orderkey % 4 = 0 THEN 'valve' ELSE 'line' END || '","subtype_filter":"valve.s","pid_id":"d' || CAST(o_orderkey % 4 AS STRING)
    || '","query":"pt ' || lpad(CAST(o_orderkey AS STRING), 6, '0') || '"}}' AS args FROM {orders}"""
_TEXT = "coalesce(',\"{0}\":\"' || {1}{0} || '\"', '')"
_FIELDS = " || ".join(_TEXT.format(c, "n.") for c in ("tag", "subtype", "service"))


@query(
    "run_tool_calls",
    f"""WITH c AS (SELECT *, args ->> '$.tag' AS tag, args ->> '$.query' AS q, args ->> '$.pid_id' AS pid, args ->> '$.node_type' AS type FROM ({_CALLS}) u), s AS ({validate_queries.SUMMARY}),
    l AS (SELECT type, count(*) AS n FROM {{g_nodes}} WHERE starts_with(coalesce(subtype, ''), 'valve.s') GROUP BY type),
    f AS (SELECT replace(upper(tag), '-', '') AS t, arg_min(id, node_seq) AS id FROM {{g_nodes}} WHERE tag IS NOT NULL GROUP BY 1)
    SELECT call_id, tool, CAST(NULL AS BIGINT) AS n, CASE WHEN n.id IS NULL THEN '{{{{"error":"no node with tag ' || c.tag || '"}}}}' ELSE '{{{{"id":"' || n.id || '","type":"' || n.type || '"' || {_FIELDS} || '}}}}' END AS result
    FROM c LEFT JOIN f ON f.t = replace(c.tag, '-', '') LEFT JOIN {{g_nodes}} n ON n.id = f.id WHERE tool = 'get_node'
    UNION ALL SELECT call_id, tool, NULL, '{{{{"list":"' || c.type || '|valve.s","nodes":' || CAST(coalesce(l.n, 0) AS STRING) || '}}}}' FROM c LEFT JOIN l ON l.type = c.type WHERE tool = 'list_nodes'
    UNION ALL SELECT call_id, tool, NULL, CASE WHEN s.nodes IS NULL THEN '{{{{"error":"no graph for ' || c.pid || '"}}}}' ELSE '{{{{"pid":"' || s.pid || '","nodes":' || CAST(s.nodes AS STRING) || ',"edges":' || CAST(s.edges AS STRING) || coalesce(',"area":"' || s.area || '"', '') || '}}}}' END FROM c LEFT JOIN s ON s.pid = c.pid WHERE tool = 'graph_summary'
    UNION ALL SELECT call_id, tool, node_seq, CASE WHEN n.id IS NOT NULL THEN '{{{{"id":"' || n.id || '"' || {_TEXT.format("tag", "n.")} || ',"type":"' || n.type || '"' || {_TEXT.format("subtype", "n.")} || {_TEXT.format("service", "n.")} || '}}}}' END
    FROM c LEFT JOIN {{g_nodes}} n ON contains(replace(upper(n.tag), '-', ''), replace(upper(q), ' ', '')) OR contains(lower(coalesce(n.service, '')), q) OR contains(lower(coalesce(n.subtype, '')), q) WHERE tool = 'search_nodes' QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY node_seq) <= 20
    UNION ALL SELECT call_id, tool, NULL, '{{{{"error":"unknown tool: other"}}}}' FROM c WHERE tool = 'other'""",
)
def run_tool_calls(t: Source) -> DataFrame:
    return tools.run_tool_calls(t.sql(_CALLS), t("g_nodes"), t("g_edges"), validate_queries.info(t))


@query("run_graph_searches")
def run_graph_searches(t: Source) -> DataFrame:
    """The tools that walk the graph, which recursive SQL answers in ``find_path`` and ``impact_region``."""
    k = F.col("o_orderkey")
    tag = F.concat(F.lit("PT-"), F.lpad(k.cast("string"), 6, "0"))
    tool = F.when(k % 2 == 0, "find_path").otherwise("impact_region")
    customer = F.concat(F.lit("C:"), F.col("o_custkey").cast("string"))
    way = F.element_at(F.array(F.lit("both"), F.lit("upstream"), F.lit("downstream")), (k % 3 + 1).cast("int"))
    args = F.to_json(F.struct(tag.alias("tag"), tag.alias("from_tag"), customer.alias("to_tag"), (1 + k % 4).alias("depth"), way.alias("direction")))
    calls = t("orders").select(k.alias("call_id"), tool.alias("tool"), args.alias("args"))
    edges = t("g_edges").withColumns({"line_tag": F.concat(F.lit("LN-"), "edge_seq"), "diameter": F.when(F.col("kind") == "process", '6"')})
    return tools.run_tool_calls(calls, t("g_nodes"), edges)


@query(
    "scan_images",
    """WITH p AS (SELECT vec_id, unnest(embedding) AS e FROM {embeddings}), v AS (SELECT vec_id, floor((CAST(e AS DOUBLE) + 1) * 127) AS v FROM p)
    SELECT 'v' || CAST(vec_id AS STRING) AS origin, avg(CASE WHEN v < 128 THEN 1 ELSE 0 END) AS dark, avg(CASE WHEN v >= 150 THEN 1 ELSE 0 END) AS light FROM v GROUP BY vec_id""",
)
def scan_images(t: Source) -> DataFrame:
    """The rows that the image source gives, made from vectors; ``read_images`` itself is tested on files."""
    byte = lambda v: F.lpad(F.hex(F.floor((v.cast("double") + 1) * 127)), 2, "0")
    data = F.unhex(F.array_join(F.transform("embedding", byte), ""))
    images = t("embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("origin"), F.lit(1).alias("n_channels"), data.alias("data"))
    return readers.pixel_shares(images, 128, 150)
