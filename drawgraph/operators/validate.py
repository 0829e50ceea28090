"""Validation: rules, coverage, confidence, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawgraph.functions.scalars import first_number, norm_size, norm_tag_strict


def with_pid(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the drawing of their source."""
    if "pid" in edges.columns:
        return edges
    return edges.join(nodes.groupBy(F.col("id").alias("src")).agg(F.min("pid").alias("pid")), "src", "left")


def graph_summary(nodes: DataFrame, edges: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """(pid, nodes, edges, area) of each drawing, and over all drawings under 'all'.

    ``info`` may hold (pid, area, unit): the area is shown, or the unit where there is no area.
    """
    n = nodes.groupBy("pid").agg(F.count("*").alias("nodes"))
    e = with_pid(edges, nodes).groupBy("pid").agg(F.count("*").alias("edges"))
    both = n.join(e, "pid", "full_outer").na.fill(0, ["nodes", "edges"])
    sums = both.rollup("pid").agg(F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"), F.grouping("pid").alias("_g"))
    sums = sums.select(F.when(F.col("_g") == 1, "all").otherwise(F.col("pid")).alias("pid"), "nodes", "edges")
    if info is None:
        return sums.withColumn("area", F.lit(None).cast("string"))
    named = info.groupBy("pid").agg(F.min(F.coalesce(F.nullif("area", F.lit("")), F.nullif("unit", F.lit("")))).alias("area"))
    return sums.join(named, "pid", "left")


def type_stats(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("pid", "type").agg(F.count("*").alias("n"))


def supergraph_stats(nodes: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """(pid, node_count, edge_count, links_out) of each drawing of a merged graph."""
    n = nodes.groupBy("pid").agg(F.count("*").alias("node_count"))
    e = edges.join(nodes.select("pid", F.col("id").alias("src")), "src").groupBy("pid").agg(F.count("*").alias("edge_count"))
    x = links.groupBy(F.col("src_pid").alias("pid")).agg(F.count("*").alias("links_out"))
    return n.join(e, "pid").join(x, "pid", "left").na.fill({"links_out": 0})


def _missing(fields: tuple[str, ...]) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(F.col(f), F.lit("")) == "", f) for f in fields])), ",")


CONDITIONS = ("design_pressure", "design_temp", "op_pressure", "op_temp")


def rule_vessel(nodes: DataFrame, word: str = "vessel") -> DataFrame:
    """Equipment of a subtype that lacks condition fields: high."""
    some = nodes.filter((F.col("type") == "equipment") & F.contains(F.lower(F.coalesce("subtype", F.lit(""))), F.lit(word)))
    return some.select("pid", "id", _missing(CONDITIONS).alias("missing"), F.lit("high").alias("severity")).filter("missing <> ''")


def rule_psv(nodes: DataFrame, tag_word: str = "PSV", subtypes: tuple[str, ...] = ("psv", "relief")) -> DataFrame:
    """Relief valves without set pressure or size: high."""
    subtype = F.lower(F.coalesce("subtype", F.lit("")))
    hit = F.contains(F.upper(F.coalesce("tag", F.lit(""))), F.lit(tag_word))
    for word in subtypes:
        hit = hit | F.contains(subtype, F.lit(word))
    return nodes.filter(hit).select("pid", "id", _missing(("set_pressure", "size_code")).alias("missing"), F.lit("high").alias("severity")).filter("missing <> ''")


def first_items(rows: DataFrame, by: str, value: str, order: str, n: int) -> DataFrame:
    """(by, n, items): the number of rows of each group and its first ``n`` values, from bounded partial lists."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    heads = rows.withColumn("_r", rank).filter(F.col("_r") <= n).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("_r", value))).alias("_l"))
    return counts.join(heads, by).select(by, "n", F.array_join(F.transform("_l", lambda x: x[value]), ",").alias("items"))


def rule_valve_position(nodes: DataFrame, n: int = 30) -> DataFrame:
    """One medium warning per drawing: valves with neither normal nor fail position."""
    bad = nodes.filter("type = 'valve' and normal_position is null and fail_position is null")
    return first_items(bad, "pid", "id", "node_seq", n)


def rule_terminator(nodes: DataFrame, n: int = 30) -> DataFrame:
    return first_items(nodes.filter("type = 'terminator' and off_page_ref is null"), "pid", "id", "node_seq", n)


def rule_spec_break(nodes: DataFrame) -> DataFrame:
    bad = nodes.filter("spec_change and (from_spec is null or to_spec is null)")
    return bad.select("pid", "id", _missing(("from_spec", "to_spec")).alias("missing"), F.lit("medium").alias("severity"))


def coverage(graph_tags: DataFrame, list_tags: DataFrame) -> DataFrame:
    """One row: confirmed, missed and extra tags, and the percentage of the list that the graph has (null without a list)."""
    a = graph_tags.select(norm_tag_strict(F.col("tag")).alias("t")).filter("t <> ''").distinct().withColumn("g", F.lit(1))
    b = list_tags.select(norm_tag_strict(F.col("tag")).alias("t")).filter("t <> ''").distinct().withColumn("l", F.lit(1))
    both = a.join(b, "t", "full_outer")
    sums = both.agg(
        F.count_if(F.col("g").isNotNull() & F.col("l").isNotNull()).alias("confirmed"),
        F.count_if(F.col("g").isNull()).alias("missed"),
        F.count_if(F.col("l").isNull()).alias("extra"),
    )
    listed = F.col("confirmed") + F.col("missed")
    return sums.withColumn("pct", F.when(listed > 0, F.round(F.col("confirmed") / listed * 100, 1)))


def tag_set_diff(graph_tags: DataFrame, list_tags: DataFrame) -> DataFrame:
    """(side, tag): tags of the list that the graph lacks ('missed'), and the other way round ('extra')."""
    a = graph_tags.select(norm_tag_strict(F.col("tag")).alias("tag")).filter("tag <> ''").distinct()
    b = list_tags.select(norm_tag_strict(F.col("tag")).alias("tag")).filter("tag <> ''").distinct()
    return b.join(a, "tag", "left_anti").select(F.lit("missed").alias("side"), "tag").unionByName(
        a.join(b, "tag", "left_anti").select(F.lit("extra").alias("side"), "tag")
    )


def match_ground_truth(nodes: DataFrame, reference: DataFrame) -> DataFrame:
    """(ref_id, id, size_ok, pressure_ok, issues): the first node whose strict tag equals the reference tag or one of which ends the other.

    ``reference`` has (ref_id, ref_tag, ref_size) and may have kind, ref_pressure and ref_temp. ``issues`` are
    rule:severity entries: a missing node; for equipment a design pressure or temperature that is expected and missing,
    or a pressure (first numbers compared) more than 1 off; for other kinds a size that differs. Empty values expect
    nothing. Suffixes of each side are joined with the whole of the other, so no pair is tried that doesn't match.
    """
    suffixes = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda n: F.substr(t, n, F.length(t)))
    has = lambda df, c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    values = F.struct("id", *[has(nodes, c).alias(c) for c in ("size_code", "design_pressure", "design_temp")])
    g = nodes.select("node_seq", values.alias("node"), norm_tag_strict(F.col("tag")).alias("g")).filter("g <> ''")
    r = reference.select("ref_id", norm_tag_strict(F.col("ref_tag")).alias("r")).filter("r <> ''")
    inside = g.select("node_seq", "node", F.explode(suffixes(F.col("g"))).alias("r")).join(r, "r")
    outside = r.select("ref_id", F.explode(suffixes(F.col("r"))).alias("g")).join(g, "g")
    columns = ["ref_id", "node_seq", "node"]
    best = inside.select(*columns).unionByName(outside.select(*columns)).groupBy("ref_id").agg(F.min_by("node", "node_seq").alias("m"))
    joined = reference.select(
        "ref_id", (has(reference, "kind") if "kind" in reference.columns else F.lit("equipment")).alias("kind"), *[has(reference, c).alias(c) for c in ("ref_size", "ref_pressure", "ref_temp")]
    ).join(best, "ref_id", "left")
    size = norm_size(F.col("m.size_code")) == norm_size(F.col("ref_size"))
    want, got = (F.nullif(first_number(F.col(c)), F.lit(0.0)) for c in ("ref_pressure", "m.design_pressure"))
    pressure = F.abs(want - got) <= 1
    vessel, known = F.col("kind") == "equipment", F.col("m.id").isNotNull()
    issues = F.array(
        F.when(~known, F.concat("kind", F.lit(" missing:high"))),
        F.when(vessel & known & F.col("ref_pressure").isNotNull() & F.col("m.design_pressure").isNull(), "design_pressure missing:high"),
        F.when(vessel & known & ~pressure, "design_pressure mismatch:medium"),
        F.when(vessel & known & F.col("ref_temp").isNotNull() & F.col("m.design_temp").isNull(), "design_temp missing:high"),
        F.when(~vessel & known & ~size, "size mismatch:medium"),
    )
    return joined.select("ref_id", F.col("m.id").alias("id"), size.alias("size_ok"), pressure.alias("pressure_ok"), F.array_compact(issues).alias("issues"))


def reference_coverage(matched: DataFrame) -> DataFrame:
    found = matched.agg(F.count("id").alias("found"), F.count_if(F.col("id").isNull()).alias("missing"))
    n = F.col("found") + F.col("missing")
    return found.withColumn("pct", F.when(n > 0, F.round(F.col("found") / n * 100, 1)))


def confidence_score(issues: DataFrame) -> DataFrame:
    """(pid, score): 100 less 5 for each high and 2 for each medium finding, from 0 to 100."""
    sums = issues.groupBy("pid").agg(F.count_if(F.col("severity") == "high").alias("h"), F.count_if(F.col("severity") == "medium").alias("m"))
    return sums.select("pid", F.greatest(F.lit(0), F.least(F.lit(100), 100 - 5 * F.col("h") - 2 * F.col("m"))).cast("long").alias("score"))


def rule_loop(nodes: DataFrame) -> DataFrame:
    has = lambda kind: F.bool_or(F.col("type") == kind)
    loops = nodes.filter("loop_id is not null").groupBy("pid", "loop_id").agg(has("valve").alias("has_valve"), has("instrument").alias("has_instrument"))
    return loops.filter(~F.col("has_valve") | ~F.col("has_instrument"))


def loop_wiring(controllers: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(loop, issue): controllers (loop) whose input or output is missing."""
    a = inputs.select("loop").distinct().withColumn("_i", F.lit(1))
    b = outputs.select("loop").distinct().withColumn("_o", F.lit(1))
    joined = controllers.select("loop").distinct().join(a, "loop", "left").join(b, "loop", "left")
    issues = F.array_compact(F.array(F.when(F.col("_i").isNull(), "no input"), F.when(F.col("_o").isNull(), "no output")))
    return joined.select("loop", F.explode(issues).alias("issue"))


def integrity_report(runs: DataFrame, version: str, least: int = 70) -> DataFrame:
    """(pid, issue) of drawings with missing files, a wrong version or a low confidence."""
    issues = F.array_compact(
        F.array(
            F.when(F.col("files") < F.col("expected"), "missing files"),
            F.when(F.coalesce(F.col("version"), F.lit("")) != version, "wrong version"),
            F.when(F.col("confidence") < least, "low confidence"),
        )
    )
    return runs.select("pid", F.explode(issues).alias("issue"))


def link_overview(nodes: DataFrame, links: DataFrame, n: int = 20, most_links: int = 30) -> DataFrame:
    """(pid, terminators, ends, tags, links): number of terminators, the first ``n`` of them as tag:reference, the first
    ``n`` equipment tags of each drawing, and the first ``most_links`` links of all drawings as drawing>drawing:reference.

    ``links`` has (ref, src_pid, src, dst_pid, dst) and is ordered by these.
    """
    shown = nodes.filter("type = 'terminator'").withColumn("end", F.concat(F.coalesce("tag", F.lit("")), F.lit(":"), F.coalesce("off_page_ref", F.lit(""))))
    ends = first_items(shown, "pid", "end", "node_seq", n).select("pid", F.col("n").alias("terminators"), F.col("items").alias("ends"))
    tags = first_items(nodes.filter("type = 'equipment' and tag is not null"), "pid", "tag", "node_seq", n).select("pid", F.col("items").alias("tags"))
    some = links.orderBy("ref", "src_pid", "src", "dst_pid", "dst").limit(most_links)
    text = F.concat("src_pid", F.lit(">"), "dst_pid", F.lit(":"), "ref")
    pairs = some.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ref", "src_pid", "src", "dst_pid", "dst", text.alias("t")))), lambda x: x["t"]), ",").alias("links"))
    return ends.join(tags, "pid", "full_outer").join(F.broadcast(pairs))  # one row
