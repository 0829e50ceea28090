"""Queries of the validation operators and of joins between lists."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawgraph.operators import evaluate, graph, validate
from drawgraph.plans.registry import Source, query


#: Areas and units of drawings; some lack either.
_INFO = "SELECT 'd' || CAST(n_nationkey AS STRING) AS pid, CASE n_nationkey WHEN 0 THEN n_name WHEN 1 THEN '' END AS area, CASE WHEN n_nationkey < 2 THEN 'U' || n_name END AS unit FROM {nation}"
SUMMARY = f"""SELECT s.pid, s.nodes, s.edges, i.area FROM (SELECT n.pid, n.nodes, e.edges FROM (SELECT coalesce(pid, 'all') AS pid, count(*) AS nodes FROM {{g_nodes}} GROUP BY ROLLUP (pid)) n
    JOIN (SELECT coalesce(pid, 'all') AS pid, count(*) AS edges FROM (SELECT n.pid FROM {{g_edges}} e JOIN {{g_nodes}} n ON n.id = e.src) x GROUP BY ROLLUP (pid)) e ON n.pid = e.pid) s
    LEFT JOIN (SELECT pid, CASE WHEN coalesce(area, '') <> '' THEN area WHEN coalesce(unit, '') <> '' THEN unit END AS area FROM ({_INFO}) j) i ON i.pid = s.pid"""


def info(t: Source) -> DataFrame:
    return t.sql(_INFO)


@query("graph_summary", SUMMARY)
def graph_summary(t: Source) -> DataFrame:
    return validate.graph_summary(t("g_nodes"), t("g_edges"), info(t))


@query("type_stats", "SELECT pid, type, count(*) AS n FROM {g_nodes} GROUP BY ALL")
def type_stats(t: Source) -> DataFrame:
    return validate.type_stats(t("g_nodes"))


def _missing(*fields: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN coalesce({f}, '') = '' THEN '{f}' END" for f in fields) + "], lambda x: x IS NOT NULL), ',')"


_FOUR = _missing("design_pressure", "design_temp", "op_pressure", "op_temp")
_TWO = _missing("set_pressure", "size_code")


@query("rule_vessel", f"SELECT pid, id, {_FOUR} AS missing, 'high' AS severity FROM {{p_nodes}} WHERE type = 'equipment' AND contains(lower(subtype), 'build') AND {_FOUR} <> ''")
def rule_vessel(t: Source) -> DataFrame:
    return validate.rule_vessel(t("p_nodes"), "build")


@query("rule_psv", f"SELECT pid, id, {_TWO} AS missing, 'high' AS severity FROM {{p_nodes}} WHERE (contains(upper(tag), 'HV-00') OR contains(coalesce(subtype, ''), 'small')) AND {_TWO} <> ''")
def rule_psv(t: Source) -> DataFrame:
    return validate.rule_psv(t("p_nodes"), "HV-00", ("small",))


def _heads(where: str, value: str, n: int) -> str:
    return (
        f"WITH b AS (SELECT pid, {value} AS v, node_seq, row_number() OVER (PARTITION BY pid ORDER BY node_seq) AS r FROM {{p_nodes}} WHERE {where}) "
        f"SELECT pid, count(*) AS n, string_agg(v, ',' ORDER BY node_seq) FILTER (r <= {n}) AS items FROM b GROUP BY pid"
    )


@query("rule_valve_position", _heads("type = 'valve' AND normal_position IS NULL AND fail_position IS NULL", "id", 30))
def rule_valve_position(t: Source) -> DataFrame:
    return validate.rule_valve_position(t("p_nodes"))


@query("rule_terminator", _heads("type = 'terminator' AND off_page_ref IS NULL", "id", 30))
def rule_terminator(t: Source) -> DataFrame:
    return validate.rule_terminator(t("p_nodes"))


@query("rule_spec_break", f"SELECT pid, id, {_missing('from_spec', 'to_spec')} AS missing, 'medium' AS severity FROM {{p_nodes}} WHERE spec_change AND (from_spec IS NULL OR to_spec IS NULL)")
def rule_spec_break(t: Source) -> DataFrame:
    return validate.rule_spec_break(t("p_nodes"))


@query(
    "rule_loop",
    "SELECT pid, loop_id, bool_or(type = 'valve') AS has_valve, bool_or(type = 'instrument') AS has_instrument FROM {g_nodes} WHERE loop_id IS NOT NULL GROUP BY ALL HAVING NOT (bool_or(type = 'valve') AND bool_or(type = 'instrument'))",
)
def rule_loop(t: Source) -> DataFrame:
    return validate.rule_loop(t("g_nodes"))


@query(
    "check_loop_wiring",
    """SELECT c.c_custkey AS loop, 'no input' AS issue FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o_orderkey % 5 = 0)
    UNION ALL SELECT c.c_custkey, 'no output' FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o_orderkey % 7 = 0)""",
)
def check_loop_wiring(t: Source) -> DataFrame:
    orders = t("orders").withColumn("loop", F.col("o_custkey"))
    return validate.loop_wiring(t("customer").select(F.col("c_custkey").alias("loop")), orders.filter("o_orderkey % 5 = 0"), orders.filter("o_orderkey % 7 = 0"))


_G = "SELECT DISTINCT 'O' || CAST(o_orderkey AS STRING) AS t FROM {orders} WHERE o_orderkey % 3 <> 0"
_L = "SELECT DISTINCT 'O' || CAST(l_orderkey AS STRING) AS t FROM {lineitem}"


def _tags(t: Source) -> tuple[DataFrame, DataFrame]:
    text = lambda c: F.concat(F.lit("o-"), F.col(c).cast("string")).alias("tag")
    return t("orders").filter("o_orderkey % 3 <> 0").select(text("o_orderkey")), t("lineitem").select(text("l_orderkey"))


@query(
    "coverage",
    f"""WITH g AS ({_G}), l AS ({_L}), s AS (SELECT (SELECT count(*) FROM g WHERE t IN (SELECT t FROM l)) AS confirmed, (SELECT count(*) FROM l WHERE t NOT IN (SELECT t FROM g)) AS missed,
    (SELECT count(*) FROM g WHERE t NOT IN (SELECT t FROM l)) AS extra) SELECT *, round(confirmed / (confirmed + missed) * 100, 1) AS pct FROM s""",
)
def coverage(t: Source) -> DataFrame:
    return validate.coverage(*_tags(t))


@query("tag_set_diff", f"WITH g AS ({_G}), l AS ({_L}) SELECT 'missed' AS side, t AS tag FROM l WHERE t NOT IN (SELECT t FROM g) UNION ALL SELECT 'extra', t FROM g WHERE t NOT IN (SELECT t FROM l)")
def tag_set_diff(t: Source) -> DataFrame:
    return validate.tag_set_diff(*_tags(t))


_REF = """SELECT s_suppkey AS ref_id, '0-0_0' || lpad(CAST(s_suppkey * 3 AS STRING), 5, '0') AS ref_tag, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE CAST(s_suppkey * 3 % 13 AS STRING) || ' in' END AS ref_size,
    CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN CAST(s_suppkey % 40 AS STRING) || ' barg' ELSE CAST(s_suppkey * 3 % 40 AS STRING) || '.5 barg' END AS ref_pressure,
    CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE '100' END AS ref_temp, CASE WHEN s_suppkey % 2 = 0 THEN 'equipment' ELSE 'manual_valve' END AS kind FROM {supplier}"""
_SIZE = "regexp_replace(lower({}), '[\\s\"''in]', '', 'g')"
_MATCH = f"""SELECT ref_id, id, size_ok, pressure_ok, CASE WHEN id IS NULL THEN kind || ' missing:high' WHEN kind = 'equipment' THEN
    array_to_string(list_filter([CASE WHEN ref_pressure <> '' AND design_pressure IS NULL THEN 'design_pressure missing:high' END, CASE WHEN NOT pressure_ok THEN 'design_pressure mismatch:medium' END,
    CASE WHEN ref_temp IS NOT NULL AND design_temp IS NULL THEN 'design_temp missing:high' END], lambda x: x IS NOT NULL), ',') WHEN NOT size_ok THEN 'size mismatch:medium' ELSE '' END AS issues FROM (
    SELECT *, {_SIZE.format("size_code")} = {_SIZE.format("nullif(ref_size, '')")} AS size_ok,
    CASE WHEN ref_pressure <> '' AND TRY_CAST(regexp_extract(ref_pressure, '[\\d.]+', 0) AS DOUBLE) <> 0 AND CAST(design_pressure AS DOUBLE) <> 0 THEN abs(TRY_CAST(regexp_extract(ref_pressure, '[\\d.]+', 0) AS DOUBLE) - CAST(design_pressure AS DOUBLE)) <= 1 END AS pressure_ok
    FROM (SELECT r.*, n.id, n.size_code, n.design_pressure, n.design_temp FROM (SELECT *, replace(replace(ref_tag, '-', ''), '_', '') AS t FROM ({_REF}) q) r
    LEFT JOIN (SELECT *, regexp_replace(upper(tag), '[\\s\\-_]', '', 'g') AS g FROM {{p_nodes}} WHERE type = 'equipment') n ON ends_with(g, t) OR ends_with(t, g)
    QUALIFY row_number() OVER (PARTITION BY r.ref_id ORDER BY n.node_seq) = 1) a) b"""


def _matched(t: Source) -> DataFrame:
    return validate.match_ground_truth(t("p_nodes").filter("type = 'equipment'"), t.sql(_REF))


@query("match_ground_truth", _MATCH)
def match_ground_truth(t: Source) -> DataFrame:
    return _matched(t).withColumn("issues", F.array_join("issues", ","))


@query("reference_coverage", f"WITH m AS ({_MATCH}) SELECT count(id) AS found, count(*) - count(id) AS missing, round(count(id) / count(*) * 100, 1) AS pct FROM m")
def reference_coverage(t: Source) -> DataFrame:
    return validate.reference_coverage(_matched(t))


@query(
    "confidence_score",
    """SELECT 'c' || CAST(o_custkey AS STRING) AS pid, greatest(0, least(100, 100 - 5 * count(*) FILTER (o_orderstatus = 'F') - 2 * count(*) FILTER (o_orderstatus = 'O'))) AS score FROM {orders} GROUP BY 1""",
)
def confidence_score(t: Source) -> DataFrame:
    severity = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "medium").otherwise("low")
    return validate.confidence_score(t("orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("pid"), severity.alias("severity")))


@query(
    "integrity_report",
    """WITH r AS (SELECT o_orderkey AS pid, (SELECT count(*) FROM {lineitem} WHERE l_orderkey = o_orderkey) AS files, 'v' || CAST(o_orderkey % 4 AS STRING) AS version, CAST(o_totalprice AS BIGINT) % 100 AS confidence FROM {orders})
    SELECT pid, 'missing files' AS issue FROM r WHERE files < 3 UNION ALL SELECT pid, 'wrong version' FROM r WHERE version <> 'v1' UNION ALL SELECT pid, 'low confidence' FROM r WHERE pid % 100 < 70""",
)
def integrity_report(t: Source) -> DataFrame:
    files = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("files"))
    runs = t("orders").join(files, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("pid"), F.coalesce("files", F.lit(0)).alias("files"), F.lit(3).alias("expected"),
        F.concat(F.lit("v"), (F.col("o_orderkey") % 4).cast("string")).alias("version"), (F.col("o_orderkey") % 100).alias("confidence"),
    )
    return validate.integrity_report(runs, "v1")


@query(
    "link_overview",
    """WITH e AS (SELECT pid, coalesce(tag, '') || ':' || coalesce(off_page_ref, '') AS t, node_seq, row_number() OVER (PARTITION BY pid ORDER BY node_seq) AS r FROM {g_nodes} WHERE type = 'terminator'),
    b AS (SELECT pid, tag, node_seq, row_number() OVER (PARTITION BY pid ORDER BY node_seq) AS r FROM {g_nodes} WHERE type = 'equipment' AND tag IS NOT NULL),
    t AS (SELECT *, regexp_replace(upper(off_page_ref), '[\\s\\-_./]', '', 'g') AS ref FROM {g_nodes} WHERE off_page_ref IS NOT NULL),
    l AS (SELECT a.ref, a.pid AS p, b.pid AS q, a.id AS i, b.id AS j FROM t a JOIN t b ON a.ref = b.ref AND a.node_seq < b.node_seq AND a.pid <> b.pid ORDER BY a.ref, a.pid, a.id, b.pid, b.id LIMIT 30)
    SELECT d.pid, (SELECT count(*) FROM e WHERE e.pid = d.pid) AS terminators, (SELECT string_agg(t, ',' ORDER BY node_seq) FROM e WHERE e.pid = d.pid AND r <= 20) AS ends,
    (SELECT string_agg(tag, ',' ORDER BY node_seq) FROM b WHERE b.pid = d.pid AND r <= 20) AS tags, coalesce((SELECT string_agg(p || '>' || q || ':' || ref, ',' ORDER BY ref, p, i, q, j) FROM l), '') AS links FROM (SELECT DISTINCT pid FROM {g_nodes}) d""",
)
def link_overview(t: Source) -> DataFrame:
    return validate.link_overview(t("g_nodes"), graph.match_off_page_refs(t("g_nodes")))


@query(
    "pair_labels",
    """SELECT d.doc_id AS image, l.doc_id AS label, CASE WHEN l.doc_id IS NULL THEN 'no label' WHEN d.doc_id IS NULL THEN 'no image' ELSE 'paired' END AS state
    FROM (SELECT doc_id FROM {documents} WHERE doc_id % 10 <> 3) d FULL JOIN (SELECT DISTINCT doc_id FROM {labels}) l ON d.doc_id = l.doc_id""",
)
def pair_labels(t: Source) -> DataFrame:
    return evaluate.pair_labels(t("documents").filter("doc_id % 10 <> 3").select("doc_id"), t("labels").select("doc_id").distinct())


@query(
    "stem_set_diff",
    "SELECT 'image' AS side, doc_id AS stem FROM (SELECT doc_id FROM {documents} EXCEPT SELECT doc_id FROM {labels}) a UNION ALL SELECT 'label', doc_id FROM (SELECT doc_id FROM {labels} WHERE doc_id % 2 = 0 EXCEPT SELECT doc_id FROM {documents} WHERE doc_id % 4 = 0) b",
)
def stem_set_diff(t: Source) -> DataFrame:
    images = t("documents").select("doc_id")
    labels = t("labels").select("doc_id")
    a = images.subtract(labels)
    b = labels.filter("doc_id % 2 = 0").subtract(images.filter("doc_id % 4 = 0"))
    return a.select(F.lit("image").alias("side"), F.col("doc_id").alias("stem")).unionByName(b.select(F.lit("label").alias("side"), F.col("doc_id").alias("stem")))


@query(
    "compare_runs",
    """WITH a AS (SELECT o_custkey AS id, max(CAST(o_totalprice / 1000 AS BIGINT) % 100) AS score FROM {orders} WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS id, max(CAST(o_totalprice / 1000 AS BIGINT) % 100) AS score FROM {orders} WHERE o_orderkey % 2 = 1 GROUP BY 1)
    SELECT a.id, a.score AS baseline, b.score AS current, b.score - a.score AS delta, CASE WHEN b.score - a.score > 5 THEN 'up' WHEN b.score - a.score < -5 THEN 'down' ELSE 'same' END AS arrow FROM a JOIN b ON a.id = b.id""",
)
def compare_runs(t: Source) -> DataFrame:
    score = F.max(F.expr("bround(o_totalprice / 1000)").cast("bigint") % 100).alias("score")
    runs = [t("orders").filter(f"o_orderkey % 2 = {k}").groupBy(F.col("o_custkey").alias("id")).agg(score) for k in (0, 1)]
    return evaluate.compare_runs(*runs)


@query(
    "validate_summaries",
    """SELECT d.doc_id, l.size IS NOT NULL AND l.size = length(d.text) AS cached, length(d.text) AS size FROM {documents} d LEFT JOIN (SELECT doc_id, n_chars + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS size FROM {documents} WHERE doc_id % 3 <> 0) l ON d.doc_id = l.doc_id""",
)
def validate_summaries(t: Source) -> DataFrame:
    docs = t("documents")
    stored = docs.filter("doc_id % 3 <> 0").select("doc_id", F.lit("x").alias("preview"), (F.col("n_chars") + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)).alias("size"))
    return evaluate.validate_summaries(docs, stored).select("doc_id", "cached", "size")


@query(
    "expected_vs_actual",
    """WITH g AS (SELECT r.r, c.c, p.p FROM range(1, 3) r(r), range(1, 4) c(c), range(1, 4) p(p)),
    f AS (SELECT l_orderkey AS pid, 1 + l_partkey % 2 AS r, 1 + l_suppkey % 3 AS c, 1 + l_linenumber % 3 AS p, bool_or(l_partkey % 5 = 0) AS bad, bool_or(l_suppkey % 2 = 0) AS again FROM {lineitem} GROUP BY ALL)
    SELECT d.pid, g.r AS row, g.c AS col, g.p AS pass, CASE WHEN f.pid IS NULL THEN 'missing' WHEN again THEN 'final' ELSE 'retry' END AS state
    FROM (SELECT DISTINCT l_orderkey AS pid FROM {lineitem}) d CROSS JOIN g LEFT JOIN f ON f.pid = d.pid AND f.r = g.r AND f.c = g.c AND f.p = g.p WHERE f.pid IS NULL OR bad""",
)
def expected_vs_actual(t: Source) -> DataFrame:
    lines = t("lineitem").withColumn("pid", F.col("l_orderkey"))
    files = lines.select(
        "pid", (1 + F.col("l_partkey") % 2).alias("row"), (1 + F.col("l_suppkey") % 3).alias("col"), (1 + F.col("l_linenumber") % 3).cast("long").alias("pass"),
        (F.col("l_partkey") % 5 == 0).alias("parse_error"), (F.col("l_suppkey") % 2 == 0).alias("retried"),
    )
    return evaluate.expected_vs_actual(lines.select("pid").distinct(), files, 2, 3, 3)


@query("filter_questions", "SELECT item_id FROM {benchmark} WHERE 'Q' || CAST(item_id AS STRING) IN ('Q1', 'Q5', 'Q7', 'Q11')")
def filter_questions(t: Source) -> DataFrame:
    rows = t("benchmark").select("item_id", F.concat(F.lit("Q"), F.col("item_id").cast("string")).alias("id"))
    return evaluate.filter_questions(rows, ["q1", "q5", "Q7", "q11"]).select("item_id")


@query("catalog_files", "SELECT d.doc_id, l.doc_id IS NOT NULL AS label_exists, b.item_id IS NOT NULL AS benchmark_exists FROM {documents} d LEFT JOIN (SELECT DISTINCT doc_id FROM {labels}) l ON d.doc_id = l.doc_id LEFT JOIN {benchmark} b ON b.item_id = d.doc_id")
def catalog_files(t: Source) -> DataFrame:
    found = {"label_exists": t("labels").select("doc_id").distinct(), "benchmark_exists": t("benchmark").select(F.col("item_id").alias("doc_id"))}
    return evaluate.catalog_files(t("documents").select("doc_id"), found, "doc_id")


@query(
    "benchmark_report",
    """WITH r AS (SELECT CASE WHEN s >= 80 THEN 'PASS' WHEN s >= 50 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict, s, sec FROM (SELECT o_orderkey % 101 AS s, o_custkey % 60 AS sec FROM {orders}) u)
    SELECT verdict, count(*) AS n, round(avg(s), 4) AS score, CAST(sum(sec) AS BIGINT) AS seconds FROM r GROUP BY 1 UNION ALL SELECT 'all', count(*), round(avg(s), 4), CAST(sum(sec) AS BIGINT) FROM r""",
)
def benchmark_report(t: Source) -> DataFrame:
    return evaluate.benchmark_report(t("orders").select((F.col("o_orderkey") % 101).alias("score"), (F.col("o_custkey") % 60).alias("seconds")))


@query("verdict_band", "SELECT o_orderkey, CASE WHEN o_orderkey % 101 >= 80 THEN 'PASS' WHEN o_orderkey % 101 >= 50 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM {orders}")
def verdict_band(t: Source) -> DataFrame:
    from drawgraph.functions.scalars import verdict_band as band

    return t("orders").select("o_orderkey", band(F.col("o_orderkey") % 101).alias("verdict"))


@query(
    "keyword_gate",
    """SELECT b.item_id, d.doc_id, array_to_string(list_filter(m, lambda x: NOT contains(lower(coalesce(d.text, '')), lower(x))), ',') AS gaps, array_to_string(list_filter(n, lambda x: contains(lower(coalesce(d.text, '')), lower(x))), ',') AS hallucinated
    FROM (SELECT item_id, string_split(text, ' ') AS m, ['the', 'ZZZ'] AS n FROM {benchmark}) b JOIN {documents} d ON d.doc_id % (SELECT max(item_id) + 1 FROM {benchmark}) = b.item_id""",
)
def keyword_gate(t: Source) -> DataFrame:
    """Every document answers one question, whose words it must hold."""
    items = t("benchmark").select("item_id", F.split("text", " ").alias("must"), F.array(F.lit("the"), F.lit("ZZZ")).alias("must_not"))
    last = t("benchmark").agg(F.max("item_id").alias("last"))
    answers = t("documents").join(F.broadcast(last)).select("doc_id", "text", (F.col("doc_id") % (F.col("last") + 1)).alias("item_id"))  # one row
    found = evaluate.keyword_gate(answers.join(items, "item_id"), "text")
    return found.select("item_id", "doc_id", F.array_join("gaps", ",").alias("gaps"), F.array_join("hallucinated", ",").alias("hallucinated"))


@query("source_attribution", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS tools, count(*) AS calls FROM {events} GROUP BY 1")
def source_attribution(t: Source) -> DataFrame:
    return evaluate.source_attribution(t("events"), "user_id", "event_type").select("user_id", F.array_join("tools", ",").alias("tools"), "calls")


@query(
    "chat_history",
    """SELECT conv_id, turn, coalesce(string_agg(role || ':' || text, '|') OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history, text FROM {conversations}""",
)
def chat_history(t: Source) -> DataFrame:
    return evaluate.chat_history(t("conversations")).select("conv_id", "turn", "history", "text")


@query(
    "usage_totals",
    """WITH x AS (SELECT l_partkey AS pid, count(*) AS calls, CAST(sum(CAST(l_quantity AS BIGINT) * 100) AS BIGINT) AS tokens_in, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens_out,
    CAST(coalesce(sum(CASE WHEN l_linenumber > 1 THEN CAST(l_quantity AS BIGINT) * 80 END), 0) AS BIGINT) AS cache_read FROM {lineitem} GROUP BY 1), y AS (SELECT o_custkey AS pid, round(count(*) * 5 * 15 / 1e6, 9) AS cost FROM {orders} GROUP BY 1)
    SELECT coalesce(x.pid, y.pid) AS pid, calls, tokens_in, tokens_out, cache_read, round((tokens_in * 3 + tokens_out * 15) / 1e6, 9) AS extract_cost, round(cache_read * 0.9 * 3 / 1e6, 9) AS saved, y.cost AS schema_cost,
    round(coalesce(round((tokens_in * 3 + tokens_out * 15) / 1e6, 9), 0) + coalesce(y.cost, 0), 9) AS total FROM x FULL JOIN y ON x.pid = y.pid""",
)
def usage_totals(t: Source) -> DataFrame:
    n = F.col("l_quantity").cast("bigint")
    calls = t("lineitem").select(F.col("l_partkey").alias("pid"), (n * 100).alias("tokens_in"), n.alias("tokens_out"), F.when(F.col("l_linenumber") > 1, n * 80).alias("cache_read"))
    later = t("orders").select(F.col("o_custkey").alias("pid"), F.lit(0).alias("tokens_in"), F.lit(5).alias("tokens_out"), F.lit(0).alias("cache_read"))
    extract, schema = (evaluate.usage_totals(c, (3.0, 15.0)) for c in (calls, later))
    return evaluate.step_costs(extract, schema).join(extract.drop("cost"), "pid", "left")


@query(
    "running_usage",
    """SELECT l_partkey AS pid, l_orderkey AS tile, l_linenumber AS part, l_suppkey AS s, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM {lineitem}""",
)
def running_usage(t: Source) -> DataFrame:
    rows = t("lineitem").select(
        F.col("l_partkey").alias("pid"), F.col("l_orderkey").alias("tile"), F.col("l_linenumber").alias("part"), F.col("l_suppkey").alias("s"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").cast("bigint").alias("tokens")
    )
    return evaluate.running_usage(rows, "pid", ["tile", "part", "s", "x"], "tokens").select("pid", "tile", "part", "s", "running")


@query(
    "truncate_lists",
    """WITH g AS (SELECT l_partkey, list(l_orderkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS l FROM {lineitem} GROUP BY 1)
    SELECT l_partkey, CAST(len(l) AS INT) AS n, array_to_string(CASE WHEN len(array_to_string(l, ',')) > 120 THEN l[1:20] ELSE l END, ',') AS items FROM g""",
)
def truncate_lists(t: Source) -> DataFrame:
    lists = t("lineitem").groupBy("l_partkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_suppkey"))), lambda x: x["l_orderkey"]).alias("l"))
    return evaluate.truncate_lists(lists, "l", 120, 20).select("l_partkey", F.size("l").alias("n"), F.array_join("short", ",").alias("items"))
