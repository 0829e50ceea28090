"""Queries of the graph operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawgraph.operators import graph, validate
from drawgraph.plans.registry import Source, query


@query(
    "get_node",
    """WITH q AS (SELECT DISTINCT 'hv ' || lpad(CAST(l_partkey % 1600 AS STRING), 4, '0') AS query FROM {lineitem} UNION SELECT 'C:' || CAST(c_custkey AS STRING) FROM {customer}),
    f AS (SELECT regexp_replace(upper(tag), '[\\s\\-]', '', 'g') AS t, arg_min(id, node_seq) AS id FROM {g_nodes} WHERE tag IS NOT NULL GROUP BY 1)
    SELECT query, coalesce(f.id, n.id) AS id FROM q LEFT JOIN f ON f.t = regexp_replace(upper(query), '[\\s\\-]', '', 'g') LEFT JOIN {g_nodes} n ON n.id = query""",
)
def get_node(t: Source) -> DataFrame:
    tags = t("lineitem").select(F.concat(F.lit("hv "), F.lpad((F.col("l_partkey") % 1600).cast("string"), 4, "0")).alias("query"))
    ids = t("customer").select(F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("query"))
    return graph.get_node(t("g_nodes"), tags.unionByName(ids).distinct())


_INTER = """SELECT a.ref, a.pid AS src_pid, a.id AS src, b.pid AS dst_pid, b.id AS dst FROM (SELECT *, regexp_replace(upper(off_page_ref), '[\\s\\-_./]', '', 'g') AS ref FROM {g_nodes} WHERE off_page_ref IS NOT NULL) a
    JOIN (SELECT *, regexp_replace(upper(off_page_ref), '[\\s\\-_./]', '', 'g') AS ref FROM {g_nodes} WHERE off_page_ref IS NOT NULL) b ON a.ref = b.ref AND a.node_seq < b.node_seq AND a.pid <> b.pid"""


@query("match_off_page_refs", _INTER)
def match_off_page_refs(t: Source) -> DataFrame:
    return graph.match_off_page_refs(t("g_nodes"))


@query(
    "isolated_terminators",
    "SELECT regexp_replace(upper(off_page_ref), '[\\s\\-_./]', '', 'g') AS ref FROM {g_nodes} WHERE off_page_ref IS NOT NULL GROUP BY 1 HAVING count(DISTINCT pid) < 2",
)
def isolated_terminators(t: Source) -> DataFrame:
    return graph.isolated_terminators(t("g_nodes"))


@query("merge_graphs", "SELECT pid || ':' || id AS id, pid AS _pid, type FROM {g_nodes} UNION ALL SELECT 'd0:' || src, 'd0', 'd0:' || dst FROM {g_edges}")
def merge_graphs(t: Source) -> DataFrame:
    nodes, edges = graph.merge_graphs(t("g_nodes"), t("g_edges").withColumn("pid", F.lit("d0")))
    return nodes.select("id", "_pid", "type").unionByName(edges.select(F.col("src").alias("id"), "_pid", F.col("dst").alias("type")))


@query(
    "resolve_inter_edges",
    f"""WITH i AS ({_INTER}) SELECT src_pid || ':' || src AS src, dst_pid || ':' || dst AS dst FROM i WHERE CAST(split_part(src, ':', 2) AS BIGINT) % 5 <> 0""",
)
def resolve_inter_edges(t: Source) -> DataFrame:
    inter = graph.match_off_page_refs(t("g_nodes"))
    missing = F.split_part("src", F.lit(":"), F.lit(2)).cast("long") % 5 == 0
    text = lambda a, b: F.concat(a, F.lit("::"), b)
    rows = inter.select(F.when(missing, "none::none").otherwise(text("src_pid", "src")).alias("src"), text("dst_pid", "dst").alias("dst"))
    return graph.resolve_inter_edges(rows, t("g_nodes"))


@query(
    "supergraph",
    f"""WITH i AS ({_INTER}), n AS (SELECT pid, count(*) AS node_count FROM {{g_nodes}} GROUP BY pid), x AS (SELECT n.pid, e.* FROM {{g_edges}} e JOIN {{g_nodes}} n ON e.src = n.id), e AS (SELECT pid, count(*) AS edge_count FROM x GROUP BY pid)
    SELECT 'drawing' AS part, n.pid AS a, NULL AS b, NULL AS kind, node_count, edge_count, (SELECT count(*) FROM i WHERE src_pid = n.pid) AS links_out FROM n JOIN e ON n.pid = e.pid
    UNION ALL SELECT 'edge', pid || ':' || src, pid || ':' || dst, kind, NULL, NULL, NULL FROM x UNION ALL SELECT 'link', src_pid || ':' || src, dst_pid || ':' || dst, 'process', NULL, NULL, NULL FROM i""",
)
def supergraph(t: Source) -> DataFrame:
    nodes, links = t("g_nodes"), graph.match_off_page_refs(t("g_nodes"))
    edges = validate.with_pid(t("g_edges"), nodes)
    merged = graph.supergraph(nodes, edges, links)
    stats = validate.supergraph_stats(nodes, t("g_edges"), links).withColumns({"part": F.lit("drawing"), "a": F.col("pid")}).drop("pid")
    return stats.unionByName(merged.select("part", F.col("src").alias("a"), F.col("dst").alias("b"), "kind"), allowMissingColumns=True)


@query(
    "undirected_distinct",
    "SELECT least(src, dst) AS u, greatest(src, dst) AS v, arg_min(id, edge_seq) AS id FROM {g_edges} GROUP BY 1, 2",
)
def undirected_distinct(t: Source) -> DataFrame:
    return graph.undirected_distinct(t("g_edges")).select("u", "v", "id")


_LISTED = "SELECT DISTINCT 'C:' || CAST(o_custkey * 2 AS STRING) AS src, 'O:' || CAST(o_orderkey AS STRING) AS dst FROM {orders}"


@query(
    "inferred_edges",
    f"""SELECT src, dst, true AS inferred FROM ({_LISTED}) l WHERE src IN (SELECT id FROM {{g_nodes}})
    AND NOT EXISTS (SELECT 1 FROM {{g_edges}} e WHERE (e.src = l.src AND e.dst = l.dst) OR (e.src = l.dst AND e.dst = l.src))""",
)
def inferred_edges(t: Source) -> DataFrame:
    text = lambda k, c: F.concat(F.lit(k), c.cast("string"))
    listed = t("orders").select(text("C:", F.col("o_custkey") * 2).alias("src"), text("O:", F.col("o_orderkey")).alias("dst"))
    return graph.inferred_edges(t("g_edges"), listed, t("g_nodes"))


@query(
    "filter_known_ends",
    "SELECT id, src, dst FROM {g_edges} WHERE src IN (SELECT id FROM {g_nodes} WHERE k % 3 <> 0) AND dst IN (SELECT id FROM {g_nodes} WHERE k % 3 <> 0)",
)
def filter_known_ends(t: Source) -> DataFrame:
    return graph.filter_known_ends(t("g_edges"), t("g_nodes").filter("k % 3 <> 0"), True).select("id", "src", "dst")


@query("filter_known_targets", "SELECT id FROM {g_edges} WHERE dst IN (SELECT id FROM {g_nodes} WHERE k % 3 <> 0)")
def filter_known_targets(t: Source) -> DataFrame:
    return graph.filter_known_ends(t("g_edges"), t("g_nodes").filter("k % 3 <> 0"), False).select("id")


@query(
    "add_missing_nodes",
    "SELECT id, type FROM {g_nodes} WHERE k % 2 = 0 UNION ALL SELECT id, 'boundary' FROM {g_nodes} WHERE k % 2 = 1 AND type = 'equipment'",
)
def add_missing_nodes(t: Source) -> DataFrame:
    nodes = t("g_nodes")
    return graph.add_missing_nodes(nodes.filter("k % 2 = 0").select("id", "type"), nodes.filter("type = 'equipment'").select("id", F.lit("boundary").alias("type")))


_ADJ = "SELECT src AS u, dst AS v, edge_seq || 'a' AS pos FROM {g_edges} UNION ALL SELECT dst, src, edge_seq || 'b' FROM {g_edges} WHERE kind IN ('process', 'signal')"


@query("adjacency", _ADJ)
def adjacency(t: Source) -> DataFrame:
    return graph.adjacency(t("g_edges")).select("u", "v", "pos")


@query(
    "find_path",
    """WITH RECURSIVE adj AS (SELECT src AS u, dst AS v, edge_seq || 'a' AS pos FROM {g_edges} UNION ALL SELECT dst, src, edge_seq || 'b' FROM {g_edges} WHERE kind IN ('process', 'signal')),
    q AS (SELECT 'q' || CAST(c_custkey AS STRING) AS query, 'C:' || CAST(c_custkey AS STRING) AS start, 'S:' || CAST(1 + c_custkey % 9 AS STRING) AS goal FROM {customer}),
    walk(query, here, goal, path, key) USING KEY (query, here) AS (SELECT query, start AS here, goal, [start] AS path, CAST([] AS STRING[]) AS key FROM q UNION
    SELECT s.query, s.here, s.goal, s.p.path, s.p.key FROM (SELECT w.query, a.v AS here, any_value(w.goal) AS goal, arg_min({{'path': list_append(w.path, a.v), 'key': list_append(w.key, a.pos)}}, list_append(w.key, a.pos)) AS p
    FROM walk w JOIN adj a ON w.here = a.u WHERE NOT EXISTS (SELECT 1 FROM recurring.walk d WHERE d.query = w.query AND d.here = d.goal)
    AND NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r.query = w.query AND r.here = a.v) GROUP BY w.query, a.v) s),
    found AS (SELECT query, path, len(path) - 1 AS n FROM walk WHERE here = goal),
    steps AS (SELECT query, i, path[i] AS a, path[i + 1] AS b FROM (SELECT query, path, unnest(range(1, n + 2)) AS i FROM found) u),
    names AS (SELECT query, string_agg(coalesce(g.tag, s.a), '>' ORDER BY i) AS path FROM steps s LEFT JOIN {g_nodes} g ON g.id = s.a GROUP BY query),
    firsts AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, arg_min(kind, edge_seq) AS kind, min(edge_seq) AS ln FROM {g_edges} GROUP BY 1, 2),
    parts AS (SELECT query, string_agg(kind || ' LN-' || ln, ';' ORDER BY i) AS edges FROM steps JOIN firsts ON u = least(a, b) AND v = greatest(a, b) GROUP BY query)
    SELECT f.query, CAST(f.n AS BIGINT) AS hops, names.path, coalesce(parts.edges, '') AS edges FROM found f JOIN names ON names.query = f.query LEFT JOIN parts ON parts.query = f.query""",
)
def find_path(t: Source) -> DataFrame:
    k = F.col("c_custkey")
    queries = t("customer").select(
        F.concat(F.lit("q"), k.cast("string")).alias("query"), F.concat(F.lit("C:"), k.cast("string")).alias("start"), F.concat(F.lit("S:"), (1 + k % 9).cast("string")).alias("goal")
    )
    edges = t("g_edges").withColumn("line_tag", F.concat(F.lit("LN-"), "edge_seq"))
    found = graph.path_details(graph.find_path(edges, queries), t("g_nodes"), edges, ("kind", "line_tag"))
    shown = F.transform("edges", lambda e: F.concat_ws(" ", e["kind"], e["line_tag"]))
    return found.select("query", "hops", F.array_join("path", ">").alias("path"), F.array_join(shown, ";").alias("edges"))


@query(
    "impact_region",
    """WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {g_edges} WHERE kind IN ('process', 'signal', 'impulse')),
    walk AS (SELECT id AS origin, id AS here, 0 AS hops FROM {g_nodes} WHERE type = 'equipment' UNION SELECT w.origin, e.dst, w.hops + 1 FROM walk w JOIN e ON w.here = e.src WHERE w.hops < 3)
    SELECT origin, here AS id, CAST(min(hops) AS BIGINT) AS hops FROM walk GROUP BY origin, here HAVING min(hops) > 0""",
)
def impact_region(t: Source) -> DataFrame:
    origins = t("g_nodes").filter("type = 'equipment'").select(F.col("id").alias("origin"))
    return graph.impact_region(t("g_edges"), origins, 3, "down")


@query(
    "impact_region_up",
    """WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {g_edges} WHERE kind IN ('process', 'signal', 'impulse')),
    walk AS (SELECT id AS origin, id AS here, 0 AS hops FROM {g_nodes} WHERE type = 'valve' UNION SELECT w.origin, e.src, w.hops + 1 FROM walk w JOIN e ON w.here = e.dst WHERE w.hops < 2)
    SELECT origin, here AS id, CAST(min(hops) AS BIGINT) AS hops FROM walk GROUP BY origin, here HAVING min(hops) > 0""",
)
def impact_region_up(t: Source) -> DataFrame:
    origins = t("g_nodes").filter("type = 'valve'").select(F.col("id").alias("origin"))
    return graph.impact_region(t("g_edges"), origins, 2, "up")


_PAIRS = "SELECT DISTINCT 'P:' || CAST(l_partkey AS STRING) AS a, 'O:' || CAST(l_orderkey AS STRING) AS b FROM {lineitem}"


@query(
    "path_edges",
    f"""SELECT a, b, arg_min(e.id, e.edge_seq) AS edge_id FROM ({_PAIRS}) p JOIN {{g_edges}} e ON least(e.src, e.dst) = least(a, b) AND greatest(e.src, e.dst) = greatest(a, b) GROUP BY a, b""",
)
def path_edges(t: Source) -> DataFrame:
    return graph.path_edges(t("g_edges"), _pairs(t))


def _pairs(t: Source) -> DataFrame:
    text = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    return t("lineitem").select(text("P:", "l_partkey").alias("a"), text("O:", "l_orderkey").alias("b")).distinct()


@query(
    "get_edge",
    f"""SELECT a, b, e.id AS edge_id, e.kind FROM ({_PAIRS}) p JOIN {{g_edges}} e ON least(e.src, e.dst) = least(a, b) AND greatest(e.src, e.dst) = greatest(a, b)""",
)
def get_edge(t: Source) -> DataFrame:
    return graph.get_edge(t("g_edges"), _pairs(t))


@query(
    "search_nodes",
    """WITH q(query) AS (VALUES ('hv-00'), ('build'), ('PT 0001')) SELECT query, id, tag FROM q JOIN {g_nodes} ON contains(coalesce(regexp_replace(upper(tag), '[\\s\\-]', '', 'g'), ''), regexp_replace(upper(query), '[\\s\\-]', '', 'g'))
    OR contains(lower(coalesce(service, '')), lower(query)) OR contains(lower(coalesce(subtype, '')), lower(query)) QUALIFY row_number() OVER (PARTITION BY query ORDER BY node_seq) <= 20""",
)
def search_nodes(t: Source) -> DataFrame:
    queries = t.spark.createDataFrame([("hv-00",), ("build",), ("PT 0001",)], "query string")
    return graph.search_nodes(t("g_nodes"), queries)


@query(
    "connected_components",
    """WITH RECURSIVE e AS (SELECT src AS u, dst AS v FROM {g_edges} UNION SELECT dst, src FROM {g_edges}),
    walk(id, component) USING KEY (id) AS (SELECT id, id AS component FROM {g_nodes} UNION
    SELECT e.v AS id, min(w.component) AS component FROM walk w JOIN e ON w.id = e.u JOIN recurring.walk r ON r.id = e.v WHERE w.component < r.component GROUP BY e.v)
    SELECT id, component FROM walk""",
)
def connected_components(t: Source) -> DataFrame:
    return graph.connected_components(t("g_edges"), t("g_nodes"))


_DEGREE = """SELECT n.id, n.node_seq, coalesce(d, 0) AS degree, coalesce(d, 0) / ((SELECT count(*) FROM {g_nodes}) - 1) AS centrality FROM {g_nodes} n LEFT JOIN
    (SELECT id, count(*) AS d FROM (SELECT unnest([u, v]) AS id FROM (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM {g_edges}) p) x GROUP BY id) y ON n.id = y.id"""


@query("degree_centrality", f"SELECT id, degree, centrality FROM ({_DEGREE}) z")
def degree_centrality(t: Source) -> DataFrame:
    return graph.degree_centrality(t("g_edges"), t("g_nodes")).select("id", "degree", "centrality")


@query("top_central", f"SELECT id, degree FROM ({_DEGREE}) z ORDER BY centrality DESC, node_seq LIMIT 10")
def top_central(t: Source) -> DataFrame:
    return graph.degree_centrality(t("g_edges"), t("g_nodes")).orderBy(F.desc("centrality"), "node_seq").limit(10).select("id", "degree")


_BOTH = "SELECT src AS origin, dst AS id FROM {g_edges} UNION SELECT dst, src FROM {g_edges}"


@query("neighbors", f"SELECT origin, id FROM ({_BOTH}) b WHERE starts_with(origin, 'O:') AND id IN (SELECT id FROM {{g_nodes}} WHERE type = 'valve')")
def neighbors(t: Source) -> DataFrame:
    origins = t("g_nodes").filter("type = 'instrument'").select(F.col("id").alias("origin"))
    return graph.neighbors(t("g_edges"), t("g_nodes"), origins, "valve")


@query("isolation_valves", f"SELECT origin, id FROM ({_BOTH}) b WHERE starts_with(origin, 'S:') AND id IN (SELECT id FROM {{g_nodes}} WHERE type = 'valve')")
def isolation_valves(t: Source) -> DataFrame:
    origins = t("g_nodes").filter("type = 'terminator'").select(F.col("id").alias("origin"))
    return graph.neighbors(t("g_edges"), t("g_nodes"), origins, "valve")


@query("isolation_gaps", f"SELECT origin, id FROM ({_BOTH}) b WHERE starts_with(origin, 'O:') AND id NOT IN (SELECT id FROM {{g_nodes}} WHERE type = 'valve')")
def isolation_gaps(t: Source) -> DataFrame:
    origins = t("g_nodes").filter("type = 'instrument'").select(F.col("id").alias("origin"))
    return graph.isolation_gaps(t("g_edges"), t("g_nodes"), origins)


@query("alarm_instruments", "SELECT id, subtype FROM {g_nodes} WHERE type = 'instrument' AND contains(subtype, 'urgent')")
def alarm_instruments(t: Source) -> DataFrame:
    return t("g_nodes").filter((F.col("type") == "instrument") & F.contains("subtype", F.lit("urgent"))).select("id", "subtype")


@query("locked_valves", "SELECT id, normal_position FROM {p_nodes} WHERE type = 'valve' AND normal_position IN ('LO', 'LC')")
def locked_valves(t: Source) -> DataFrame:
    return t("p_nodes").filter("type = 'valve' and normal_position in ('LO', 'LC')").select("id", "normal_position")


@query("spec_breaks", "SELECT id, from_spec, to_spec FROM {p_nodes} WHERE spec_change")
def spec_breaks(t: Source) -> DataFrame:
    return t("p_nodes").filter("spec_change").select("id", "from_spec", "to_spec")


@query("blinds", "SELECT id, tag FROM {g_nodes} WHERE contains(coalesce(subtype, ''), 'promo')")
def blinds(t: Source) -> DataFrame:
    return t("g_nodes").filter(F.contains(F.coalesce("subtype", F.lit("")), F.lit("promo"))).select("id", "tag")
