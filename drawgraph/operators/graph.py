"""Property-graph operators. Node tables have (pid, node_seq, id, type, subtype, tag, …), edge tables (edge_seq, id, src, dst, kind)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawgraph.functions.scalars import norm_ref, norm_tag
from drawgraph.operators.lineage import cut_lineage, forget, shared_folder  # noqa: F401

#: Levels of a search after which it is tidied up.
LEVELS = 8
#: Edges that a task holds before it contracts them, and so many that one task may take to end the work.
CONTRACT_ROWS, TASK_ROWS = 1_000_000, 4_000_000
#: A counted side of a join of at most so many (vertex, key) rows is sent to every task; so are vertices that leave other rows out.
SMALL_ROWS, SMALL_KEYS = 200_000, 500_000
#: Origins of regions whose names are sent to every task, 64 in a row.
SENT_ORIGINS = 1_000_000
#: Pairs of references that meet in one task, and tasks at most.
PAIRS, MOST_TASKS = 4_000_000, 20_000
#: What a vertex of a frontier adds to the cost of its rows.
VERTEX_COST = 4
#: Characters by which search texts and nodes meet, at most, and different numbers of them.
GRAM, GRAMS = 24, 6
#: Edge kinds that are followed against their direction too, and kinds that carry an impact.
TWO_WAY = ("process", "signal")
IMPACT = ("process", "signal", "impulse")


def get_node(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id) of the first node in file order whose normalised tag fits, else of the node with that id, else null."""
    by_tag = nodes.filter("tag is not null").groupBy(norm_tag(F.col("tag")).alias("_t")).agg(F.min_by("id", "node_seq").alias("_by_tag"))
    by_id = nodes.select(F.col("id").alias("_by_id")).distinct()
    q = queries.withColumn("_t", norm_tag(F.col("query")))
    return (
        q.join(by_tag, "_t", "left")
        .join(by_id, F.col("query") == F.col("_by_id"), "left")
        .select(*queries.columns, F.coalesce("_by_tag", "_by_id").alias("id"))
    )


def match_off_page_refs(nodes: DataFrame) -> DataFrame:
    """(ref, src_pid, src, dst_pid, dst): terminators of one normalised reference on different drawings, earlier first."""
    refs = nodes.filter("type = 'terminator' and off_page_ref is not null").select(
        norm_ref(F.col("off_page_ref")).alias("ref"), "pid", "id", "node_seq"
    ).filter("ref <> ''")
    n = refs.groupBy("ref").agg(F.count("*").alias("n"))
    pairs = n.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0
    if pairs > PAIRS:  # rows of a frequent reference meet in parts, so that tasks get about as many pairs each
        n = n.withColumn("parts", F.ceil(F.col("n").cast("double") * F.col("n") / PAIRS).cast("int"))
        refs = refs.join(n.select("ref", "parts"), "ref")
    else:
        refs = refs.withColumn("parts", F.lit(1))
    a = refs.select("ref", F.pmod(F.xxhash64("pid", "id", "node_seq"), F.col("parts")).cast("int").alias("_p"), F.col("pid").alias("src_pid"), F.col("id").alias("src"), F.col("node_seq").alias("_a"))
    b = refs.select("ref", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_p"), F.col("pid").alias("dst_pid"), F.col("id").alias("dst"), F.col("node_seq").alias("_b"))
    if pairs > PAIRS:
        tasks = min(MOST_TASKS, 1 + int(pairs / PAIRS))
        a, b = a.repartition(tasks, "ref", "_p"), b.repartition(tasks, "ref", "_p")
    return a.join(b, ["ref", "_p"]).filter((F.col("_a") < F.col("_b")) & (F.col("src_pid") != F.col("dst_pid"))).drop("_a", "_b", "_p")


def isolated_terminators(nodes: DataFrame) -> DataFrame:
    refs = nodes.filter("type = 'terminator' and off_page_ref is not null").select(norm_ref(F.col("off_page_ref")).alias("ref"), "pid")
    return refs.groupBy("ref").agg(F.count_distinct("pid").alias("n")).filter("n < 2").select("ref")


def merge_graphs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All drawings in one graph: node ids and edge ends prefixed by their drawing; edges need a ``pid``."""
    prefixed = lambda c: F.concat("pid", F.lit(":"), F.col(c))
    return (
        nodes.withColumn("id", prefixed("id")).withColumn("_pid", F.col("pid")),
        edges.withColumn("src", prefixed("src")).withColumn("dst", prefixed("dst")).withColumn("_pid", F.col("pid")),
    )


def resolve_inter_edges(inter: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends ``pid::id`` of drawing links as node ids of the merged graph; links with an unknown end go."""
    ends = inter.select(F.explode(F.array("src", "dst")).alias("end")).distinct()
    ends = cut_lineage(ends.select("end", F.split_part("end", F.lit("::"), F.lit(1)).alias("pid"), F.split_part("end", F.lit("::"), F.lit(2)).alias("id")))
    known = ends.join(_of(nodes, ["pid", "id"], ends).select("pid", "id").distinct(), ["pid", "id"])
    known = cut_lineage(known.select("end", F.concat_ws(":", "pid", "id").alias("name")))
    if known.count() <= SMALL_KEYS:  # links are many more than their ends
        known = F.broadcast(known)
    a, b = known.toDF("src", "_a"), known.toDF("dst", "_b")
    return inter.join(a, "src").join(b, "dst").select(F.col("_a").alias("src"), F.col("_b").alias("dst"))


def supergraph(nodes: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """(part, src, dst, kind): the edges of all drawings in one graph ('edge'), and the links between drawings whose ends it has ('link')."""
    _, inside = merge_graphs(nodes, edges)
    text = lambda a, b: F.concat(a, F.lit("::"), b)
    between = resolve_inter_edges(links.select(text("src_pid", "src").alias("src"), text("dst_pid", "dst").alias("dst")), nodes)
    return inside.select(F.lit("edge").alias("part"), "src", "dst", "kind").unionByName(between.select(F.lit("link").alias("part"), "src", "dst", F.lit("process").alias("kind")))


def undirected_distinct(edges: DataFrame, precedence: str = "edge_seq") -> DataFrame:
    """One edge of each unordered pair of ends: the first by ``precedence``."""
    pair = edges.withColumn("u", F.least("src", "dst")).withColumn("v", F.greatest("src", "dst"))
    return pair.groupBy("u", "v").agg(F.min_by(F.struct(*edges.columns), precedence).alias("e")).select("u", "v", "e.*")


def inferred_edges(edges: DataFrame, listed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``listed`` (src, dst) pairs whose source exists and that no edge joins yet, marked as inferred."""
    pairs = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
    ids = nodes.select(F.col("id").alias("src"))
    new = listed.distinct().withColumn("u", F.least("src", "dst")).withColumn("v", F.greatest("src", "dst"))
    return new.join(ids, "src", "left_semi").join(pairs, ["u", "v"], "left_anti").select("src", "dst", F.lit(True).alias("inferred"))


def filter_known_ends(edges: DataFrame, nodes: DataFrame, both: bool) -> DataFrame:
    ids = nodes.select("id").distinct()
    known = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return known.join(ids.withColumnRenamed("id", "src"), "src", "left_semi") if both else known


def add_missing_nodes(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``nodes`` (id, type) and the wanted ones that they lack."""
    return nodes.unionByName(wanted.join(nodes, "id", "left_anti"))


def adjacency(edges: DataFrame, two_way: tuple[str, ...] = TWO_WAY) -> DataFrame:
    """(u, v, pos, edge_id, kind): edges forward, and backward for the kinds that flow both ways; ``pos`` is file order."""
    forward = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.concat("edge_seq", F.lit("a")).alias("pos"), F.col("id").alias("edge_id"), "kind")
    back = edges.filter(F.col("kind").isin(*two_way)).select(
        F.col("dst").alias("u"), F.col("src").alias("v"), F.concat("edge_seq", F.lit("b")).alias("pos"), F.col("id").alias("edge_id"), "kind"
    )
    return forward.unionByName(back)


def _sent(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` rows as a side of a join: sent to every task if it is small, shuffled if not."""
    return F.broadcast(df) if n <= SMALL_ROWS else df


def _of(df: DataFrame, on: list[str], keys: DataFrame) -> DataFrame:
    """``df`` without rows that ``keys`` lack, as far as these are few: the others then go before anything is shuffled."""
    some = keys.select(*on).distinct()
    return df.join(F.broadcast(some), on, "left_semi") if some.limit(SMALL_KEYS + 1).count() <= SMALL_KEYS else df


def _expanded(level: DataFrame, seen: list[DataFrame], n: int, hops: DataFrame, key: str, open_: DataFrame) -> DataFrame:
    """The next level of a search: (key, at, next) that ``seen`` lacks, for the keys of open queries.

    ``next`` is the vertex of ``level`` that the least edge joins it to.
    """
    last = level.join(open_.select(key).distinct(), key, "left_semi").select(key, F.col("at").alias("u"))
    near = hops if n <= SMALL_ROWS else _of(hops, ["u"], last)
    step = near.join(_sent(last, n), "u").select(key, F.col("v").alias("at"), F.col("u").alias("next"), "pos", F.lit(True).alias("new"))
    had = reduce(DataFrame.unionByName, [x.select(key, "at") for x in seen]).select(key, "at", F.lit(None).alias("next"), F.lit(None).alias("pos"), F.lit(False).alias("new"))
    return cut_lineage(step.unionByName(had).groupBy(key, "at").agg(F.bool_and("new").alias("new"), F.min_by("next", "pos").alias("next")).filter("new").drop("new"))


def find_path(edges: DataFrame, queries: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(query, hops, path): a shortest path from ``start`` to ``goal`` of each query; none gives no row.

    Of equal lengths the one that a breadth-first queue reaches first wins: vertices of a level are ordered by the
    positions of the edges that led to them, which is the path of the least edge positions, the first one first. The
    search ends when no query is open, or after ``max_depth`` hops if that is given.

    Two searches meet, one from each different start and one against the edges from each different goal; the smaller
    frontier grows. Rows are (start or goal, vertex, pointer): no paths are carried along. The second half of a path
    follows the pointers of the search from the goal. For the first half, vertices on a shortest path are marked from
    where the searches met back to the start, each with a pointer to the least edge's next marked vertex.
    """
    queries = cut_lineage(queries.select("query", "start", "goal").filter("start is not null and goal is not null").distinct())
    none = queries.select("query", F.lit(0).cast("long").alias("hops"), F.array("start").alias("path")).filter("false")
    if queries.isEmpty():
        return none
    # each edge is kept once, and turned as it is read; the least of parallel edges is found where a level is aggregated
    hops = adjacency(cut_lineage(edges.select("edge_seq", "id", "src", "dst", "kind").withColumn("id", F.lit("")))).select("u", "v", "pos")
    against = hops.select(F.col("v").alias("u"), F.col("u").alias("v"), "pos")
    ahead = [cut_lineage(queries.select("start", F.col("start").alias("at")).distinct())]
    back = [cut_lineage(queries.select("goal", F.col("goal").alias("at"), F.col("goal").alias("next")).distinct())]
    sides = {"start": (ahead, [*ahead], hops), "goal": (back, [*back], against)}
    # rows that a level has, and what they cost: edges of one vertex are read once for all its rows
    sizes, costs = {}, {}

    def measured(side: str, level: DataFrame) -> None:
        rows, vertices = level.agg(F.count("*"), F.approx_count_distinct("at")).first()
        sizes[side], costs[side] = rows, rows + VERTEX_COST * vertices

    measured("start", ahead[0])
    measured("goal", back[0])
    open_, met = queries, []
    while True:
        a, b = len(ahead) - 1, len(back) - 1
        meeting = ahead[a].select("start", "at").join(open_, "start").join(back[b].select("goal", "at"), ["goal", "at"])
        found = cut_lineage(meeting.select("query", "start", "goal", "at", F.lit(a).alias("a"), F.lit(a + b).alias("d")))
        if not found.isEmpty():
            met.append(found)
            open_ = cut_lineage(open_.join(found.select("query").distinct(), "query", "left_anti"))
            if open_.isEmpty():
                break
        if a + b == max_depth:
            break
        if (a + b) % LEVELS == LEVELS - 1:  # a query whose start or goal has no new vertex has no path
            live = open_.join(ahead[a].select("start").distinct(), "start", "left_semi")
            open_ = cut_lineage(live.join(back[b].select("goal").distinct(), "goal", "left_semi"))
        side = min(costs, key=costs.get)
        levels, seen, along = sides[side]
        levels.append(_expanded(levels[-1], seen, sizes[side], along, side, open_))
        measured(side, levels[-1])
        if not sizes[side]:
            break
        seen.append(levels[-1])
        if len(seen) > LEVELS:  # now and then what was seen becomes one table
            seen[:] = [cut_lineage(reduce(DataFrame.unionByName, [x.select(side, "at") for x in seen]))]
    if not met:
        return none
    found = reduce(DataFrame.unionByName, met)
    # pointers of the first half by their place, the last first; where the searches met, a vertex points to itself
    ends = found.select("query", "start", "at", "a")
    marks, first = ends, []
    for i in range(max(f.first()["a"] for f in met), 0, -1):
        came = marks.filter(F.col("a") >= i).select("query", "start", "a", F.col("at").alias("u"))
        n = came.count()
        step = (against if n <= SMALL_ROWS else _of(against, ["u"], came)).join(_sent(came, n), "u").select("query", "start", "a", F.col("v").alias("at"), F.col("u").alias("next"), "pos")
        step = step.join(ahead[i - 1].select("start", "at"), ["start", "at"], "left_semi").groupBy("query", "start", "a", "at").agg(F.min_by("next", "pos").alias("next"))
        step = cut_lineage(step)
        ended = ends.filter(F.col("a") < i)
        first.insert(0, step.select("query", "at", "next").unionByName(ended.select("query", "at", F.col("at").alias("next"))))
        marks = step.drop("next").unionByName(ended)
    solved = cut_lineage(found.select("query", "start", "goal", "a", "d").distinct())
    here = solved.select("query", "goal", "a", "d", F.col("start").alias("at"), F.array("start").alias("path"))
    n, longest = solved.agg(F.count("*"), F.max(F.col("d") - F.col("a"))).first()
    behind = cut_lineage(reduce(DataFrame.unionByName, back))
    for k, (pointers, keys, on) in enumerate([(p, ["query", "at"], F.col("a") > i) for i, p in enumerate(first)] + [(behind, ["goal", "at"], F.col("d") - F.col("a") > i) for i in range(longest)]):
        moved = pointers.join(_sent(here, n), keys)
        here = moved.select("query", "goal", "a", "d", F.col("next").alias("at"), F.when(on, F.array_append("path", F.col("next"))).otherwise(F.col("path")).alias("path"))
        if k % LEVELS == LEVELS - 1:
            here = cut_lineage(here)
    return here.select("query", F.col("d").cast("long").alias("hops"), "path")


def path_details(paths: DataFrame, nodes: DataFrame, edges: DataFrame, details: tuple[str, ...]) -> DataFrame:
    """(query, hops, tags, edges): the tags (or ids) of a path's nodes and ``details`` of the first edge of each hop."""
    paths = cut_lineage(paths)
    steps = paths.select("query", F.posexplode("path").alias("k", "id"))
    names = _of(nodes, ["id"], steps).groupBy("id").agg(F.first("tag", ignorenulls=True).alias("tag"))
    tags = steps.join(names, "id", "left").groupBy("query").agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce("tag", "id").alias("tag")))).alias("t"))
    ends = paths.select("query", F.posexplode(F.arrays_zip(F.expr("slice(path, 1, size(path) - 1)").alias("a"), F.expr("slice(path, 2, size(path) - 1)").alias("b"))).alias("k", "e"))
    ends = ends.select("query", "k", F.least("e.a", "e.b").alias("u"), F.greatest("e.a", "e.b").alias("v"))
    pairs = edges.withColumns({"u": F.least("src", "dst"), "v": F.greatest("src", "dst")})
    first = _of(pairs, ["u", "v"], ends).groupBy("u", "v").agg(F.min_by(F.struct(*details), "edge_seq").alias("edge"))
    hops = ends.join(first, ["u", "v"]).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("k", "edge"))).alias("h"))
    joined = paths.join(tags, "query").join(hops, "query", "left")
    none = F.array().cast(hops.select(F.transform("h", lambda x: x["edge"])).schema[0].dataType)
    return joined.select("query", "hops", F.transform("t", lambda x: x["tag"]).alias("path"), F.coalesce(F.transform("h", lambda x: x["edge"]), none).alias("edges"))


def impact_region(edges: DataFrame, origins: DataFrame, depth: int = 3, direction: str = "down", kinds: tuple[str, ...] = IMPACT) -> DataFrame:
    """(origin, id, hops) of what lies up to ``depth`` hops down or up from each origin, itself excluded.

    Where ``origins`` has a column ``depth``, each origin goes as far as its own says, and ``depth`` is the most of them.

    64 origins search as one: a row is a vertex that some of them have reached, with a bit for each. A level is a join
    with the edges and one aggregation that ors the bits and takes away those that the vertex has had already.
    """
    a, b = ("src", "dst") if direction == "down" else ("dst", "src")
    own = F.max("depth") if "depth" in origins.columns else F.lit(depth)
    # ids of a partition are consecutive, so that 64 of them are a block; origins of one depth each
    numbered = origins.filter("origin is not null").groupBy("origin").agg(own.cast("int").alias("most"))
    numbered = cut_lineage(numbered.repartitionByRange("most", "origin").withColumn("_k", F.monotonically_increasing_id()))
    seen = numbered.select(F.shiftright("_k", 6).alias("block"), "most", F.col("origin").alias("at"), F.expr("shiftleft(1L, cast(_k & 63 as int))").alias("bits"))
    n = numbered.count()
    if not n:
        return numbered.select("origin", F.col("origin").alias("id"), F.lit(0).cast("long").alias("hops"))
    hops = cut_lineage(edges.filter(F.col("kind").isin(*kinds)).select(F.col(a).alias("u"), F.col(b).alias("v")))
    frontier, size, levels = seen, n, []
    for k in range(1, depth + 1):
        last = frontier.filter(F.col("most") >= k)
        near = hops if size <= SMALL_ROWS else _of(hops, ["u"], last.withColumnRenamed("at", "u"))
        step = near.join(_sent(last, size), F.col("at") == F.col("u"))
        step = step.select("block", "most", F.col("v").alias("at"), F.col("bits").alias("new"), F.lit(0).cast("long").alias("old"))
        had = seen.select("block", "most", "at", F.lit(0).cast("long").alias("new"), F.col("bits").alias("old"))
        both = step.unionByName(had).groupBy("block", "most", "at").agg(F.bit_or("new").alias("new"), F.bit_or("old").alias("old"))
        frontier = both.select("block", "most", "at", F.expr("new & ~old").alias("bits")).filter("bits <> 0")
        if k < depth:  # the last level, the largest, is read once
            frontier = cut_lineage(frontier)
            size = frontier.count()
            if not size:
                break
        levels.append(frontier.withColumn("hops", F.lit(k).cast("long")))
        seen = seen.unionByName(frontier)
    none = seen.filter("false").withColumn("hops", F.lit(0).cast("long"))
    reached = reduce(DataFrame.unionByName, levels or [none])
    # a row of a block has the names of its origins, so that only blocks meet what they reached
    names = numbered.groupBy(F.shiftright("_k", 6).alias("block")).agg(F.sort_array(F.collect_list(F.struct("_k", "origin"))).alias("names"))
    met = reached.join(F.broadcast(names) if n <= SENT_ORIGINS else names, "block")
    own = F.explode(F.expr("transform(filter(sequence(0, 63), i -> getbit(bits, i) = 1), i -> get(names, i).origin)"))
    return met.select(own.alias("origin"), F.col("at").alias("id"), "hops")


def path_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, edge_id): the first edge in file order between two nodes, in either direction, of any kind."""
    first = edges.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.min_by("id", "edge_seq").alias("edge_id"))
    keyed = pairs.withColumn("u", F.least("a", "b")).withColumn("v", F.greatest("a", "b"))
    return keyed.join(first, ["u", "v"]).select("a", "b", "edge_id")


def get_edge(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, edge_id, kind) of every edge between two nodes."""
    ends = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), F.col("id").alias("edge_id"), "kind")
    keyed = pairs.withColumn("u", F.least("a", "b")).withColumn("v", F.greatest("a", "b"))
    return keyed.join(ends, ["u", "v"]).select("a", "b", "edge_id", "kind")


def search_nodes(nodes: DataFrame, queries: DataFrame, n: int = 20) -> DataFrame:
    """(query, id): normalised query inside the normalised tag, or the query inside service or subtype; first ``n`` each.

    Any number of texts: nodes are cut into all their grams of a few lengths, those that the texts have, up to ``GRAM``
    characters. A text meets the nodes that hold the one of its own grams that the fewest nodes hold, and these are
    compared whole; a text as long as a gram has only that one, and so meets what it finds. An empty text finds nothing.
    """
    text = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))

    def pieces(value: Column, n: Column | int, kind: str) -> Column:
        """Characters in a row, ``n`` each, after the kind of text that they stand for."""
        n = F.lit(n) if isinstance(n, int) else n
        starts = F.when(F.length(value) >= n, F.sequence(F.lit(1), F.length(value) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(kind), F.substr(value, i, n)))

    asked = queries.filter("query is not null").select("query").distinct().withColumns({"as_tag": norm_tag(F.col("query")), "as_word": F.lower("query")})
    asked = asked.select("*", F.explode(F.array(F.struct(F.lit("t:").alias("kind"), F.col("as_tag").alias("whole")), F.struct(F.lit("w:").alias("kind"), F.col("as_word").alias("whole")))).alias("x"))
    asked = asked.select("query", "x.*").filter("whole <> ''")
    lengths = asked.select("kind", F.least(F.lit(GRAM), F.length("whole")).alias("n")).distinct().collect()  # GRAM of each kind at most
    chosen = {kind: sorted({x.n for x in lengths if x.kind == kind}) for kind in ("t:", "w:")}
    chosen = {kind: sorted({ns[i * (len(ns) - 1) // (GRAMS - 1)] for i in range(GRAMS)}) if len(ns) > GRAMS else ns for kind, ns in chosen.items()}
    # the longest chosen gram that a text holds
    fit = lambda value, kind: F.greatest(*[F.lit(0)] * 2, *[F.when(F.length(value) >= n, n).otherwise(0) for n in chosen[kind]])
    own = lambda value, kind: pieces(value, fit(value, kind), kind)
    every = lambda value, kind: F.concat(F.array().cast("array<string>"), *[pieces(value, n, kind) for n in chosen[kind]])
    held = F.array_distinct(F.concat(every(norm_tag(F.col("tag")), "t:"), every(text("service"), "w:"), every(text("subtype"), "w:")))
    parts = asked.select("*", F.explode(F.array_distinct(F.when(F.col("kind") == "t:", own(F.col("whole"), "t:")).otherwise(own(F.col("whole"), "w:")))).alias("gram"))
    grams = _of(nodes.select("node_seq", "id", "tag", "service", "subtype", F.explode(held).alias("gram")), ["gram"], parts)
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = parts.join(counts, "gram", "left").groupBy("query", "kind", "whole").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.bool_and(F.col("n").isNotNull()).alias("known"))
    fits = F.when(F.col("kind") == "t:", F.contains(norm_tag(F.col("tag")), F.col("whole"))).otherwise(
        F.contains(text("service"), F.col("whole")) | F.contains(text("subtype"), F.col("whole"))
    )
    found = grams.join(rarest.filter("known"), "gram").filter(fits).dropDuplicates(["query", "node_seq", "id"])
    rank = F.row_number().over(Window.partitionBy("query").orderBy("node_seq"))
    return found.withColumn("_r", rank).filter(F.col("_r") <= n).select("query", "id", "tag")


def _contracted(u: pa.Array, v: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(vertex, smallest vertex that these edges join it to), for the vertices that aren't the smallest themselves."""
    both = pa.concat_arrays([u, v]).dictionary_encode()
    names = both.dictionary
    order = pc.sort_indices(names).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ends = place[both.indices.to_numpy()].reshape(2, -1)
    label = np.arange(len(order))
    while True:
        ends = label[ends]
        ends = ends[:, ends[0] != ends[1]]
        if not ends.shape[1]:
            break
        np.minimum.at(label, ends.max(axis=0), ends.min(axis=0))  # a root gets the least root that it meets
        while (label[label] != label).any():
            label = label[label]
    some = np.flatnonzero(label != np.arange(len(label)))
    return names.take(pa.array(order[some])), names.take(pa.array(order[label[some]]))


def contract(pairs: DataFrame) -> DataFrame:
    """A forest of stars (u, v) for each task, which joins what its pairs (u, v) join: at most one row for each vertex."""
    kind = pairs.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[pa.Array, pa.Array]] = []
        held = kept = 0

        def all_of() -> tuple[pa.Array, pa.Array]:
            return _contracted(*(pa.concat_arrays([p[i] for p in parts]) for i in (0, 1)))

        for batch in batches:
            parts.append((batch.column(0), batch.column(1)))
            held += batch.num_rows
            if held > kept + CONTRACT_ROWS:
                parts = [all_of()]
                held = kept = len(parts[0][0])
        if parts:
            yield pa.RecordBatch.from_arrays(list(all_of()), names=["u", "v"])

    return pairs.select("u", "v").mapInArrow(run, f"u {kind}, v {kind}")


def connected_components(edges: DataFrame, nodes: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(id, component): the smallest id that is reachable without regard to direction; single nodes are their own.

    Each task contracts its edges to stars around smallest vertices, at most one row for each of its vertices. What is
    left goes to one task if it is at most ``TASK_ROWS``; otherwise large-star and small-star rounds join the stars of
    different tasks, until it is, or nothing changes.
    """
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).filter("u <> v")
    pairs = cut_lineage(contract(both))
    n, state = pairs.count(), None
    while n > task_rows:
        sides = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = sides.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "m").toDF("u", "v").unionByName(least.toDF("u", "v"))
        old, pairs = pairs, cut_lineage(small.filter("u <> v").distinct())
        forget(old)
        n, total = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, total) == state:
            break
        state = (n, total)
    else:
        pairs = contract(pairs.coalesce(1))  # at most ``task_rows`` pairs
    return nodes.select("id").join(pairs.toDF("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def degree_centrality(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, degree, centrality) on distinct unordered pairs; a loop counts twice."""
    pairs = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    ends = pairs.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    n = nodes.agg(F.count("*").alias("n"))
    joined = nodes.join(ends, "id", "left").join(F.broadcast(n)).withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    return joined.withColumn("centrality", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(F.lit(0.0))).drop("n")


def neighbors(edges: DataFrame, nodes: DataFrame, origins: DataFrame, node_type: str) -> DataFrame:
    """(origin, id) of the nodes of a type that an edge of any direction joins to an origin."""
    both = edges.select(F.col("src").alias("origin"), F.col("dst").alias("id")).unionByName(edges.select(F.col("dst").alias("origin"), F.col("src").alias("id")))
    typed = nodes.filter(F.col("type") == node_type).select("id")
    return both.join(origins, "origin", "left_semi").join(typed, "id", "left_semi").distinct().select("origin", "id")


def isolation_gaps(edges: DataFrame, nodes: DataFrame, origins: DataFrame) -> DataFrame:
    """(origin, id) of neighbours of an origin that are no valves."""
    both = edges.select(F.col("src").alias("origin"), F.col("dst").alias("id")).unionByName(edges.select(F.col("dst").alias("origin"), F.col("src").alias("id")))
    valves = nodes.filter("type = 'valve'").select("id")
    return both.join(origins, "origin", "left_semi").join(valves, "id", "left_anti").distinct().select("origin", "id")


