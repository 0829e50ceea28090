"""What iterated jobs leave on disk."""

import glob
import os

from pyspark.sql import functions as F

from drawgraph.operators import graph, tags
from drawgraph.operators.lineage import cut_lineage, forget, shared_folder
from drawgraph.plans import io_queries
from drawgraph.plans.registry import Source


def _bytes(folder):
    return sum(os.path.getsize(f) for f in glob.glob(f"{folder}/**/*", recursive=True) if os.path.isfile(f))


def test_a_cut_is_compressed_and_can_be_forgotten(spark):
    folder = shared_folder(spark).removeprefix("file:")
    before = _bytes(folder)
    rows = cut_lineage(spark.range(50_000).select("id", F.concat(F.lit("an edge of a drawing "), F.lpad(F.col("id").cast("string"), 40, "0")).alias("e")))
    assert rows.count() == 50_000 and rows.agg(F.max("id")).first()[0] == 49_999
    assert _bytes(folder) - before < 500_000  # rows as they are take more than 4 MB
    forget(rows)
    assert _bytes(folder) == before


def test_edges_are_not_read_where_no_path_is_asked_for(spark):
    edges = spark.range(1).select(*[F.raise_error(F.lit("read")).cast("string").alias(c) for c in ("edge_seq", "id", "src", "dst", "kind")])
    asked = spark.createDataFrame([("q", None, "b")], "query string, start string, goal string")
    assert graph.find_path(edges, asked).collect() == []


def test_references_meet_in_parts_and_links_keep_known_ends(spark, monkeypatch):
    nodes = spark.range(90).selectExpr("concat('d', id % 3) as pid", "id as node_seq", "concat('S:', id) as id", "'terminator' as type", "if(id < 80, 'To A-1', 'to b') as off_page_ref")
    plain = sorted(map(tuple, graph.match_off_page_refs(nodes).collect()))
    monkeypatch.setattr(graph, "PAIRS", 50)
    dealt = graph.match_off_page_refs(nodes)
    assert sorted(map(tuple, dealt.collect())) == plain and len(plain) > 2000
    counts = [len(rows) for rows in dealt.rdd.glom().collect()]
    assert len(counts) > 100 and max(counts) < len(plain) / 8  # in one task of a key they are nearly all
    links = dealt.selectExpr("concat(src_pid, '::', src) as src", "concat(dst_pid, '::', dst) as dst")
    unknown = spark.createDataFrame([("d0::none", "d1::S:1"), ("d1::S:1", None), ("d9::S:1", "d1::S:1")], "src string, dst string")
    got = sorted(map(tuple, graph.resolve_inter_edges(links.unionByName(unknown), nodes.unionByName(nodes)).collect()))
    assert got == sorted((f"{a}:{b}", f"{c}:{d}") for _, a, b, c, d in plain)
    monkeypatch.setattr(graph, "SMALL_KEYS", 5)
    assert sorted(map(tuple, graph.resolve_inter_edges(links.unionByName(unknown), nodes).collect())) == got


def test_a_search_text_meets_only_what_holds_it(spark):
    nodes = spark.range(300).selectExpr("id as node_seq", "concat('n', id) as id", "concat('PT-', lpad(id, 6, '0')) as tag", "cast(null as string) as service", "'a long word of more than twenty-four characters' as subtype")
    texts = ["pt 000123", "T-0002", "7", "twenty-four characters", "long word of more than twenty-four char", "long word of less than twenty-four char", "-", "", *("pt0000001234567890"[:k] for k in range(1, 18))]
    got = graph.search_nodes(nodes, spark.createDataFrame([(x,) for x in texts], "query string"), 1000).collect()
    word, want = "a long word of more than twenty-four characters", set()
    for x in texts:
        bare = x.upper().replace(" ", "").replace("-", "")
        for k in range(300):
            if x and (bare and bare in f"PT{k:06d}" or x.lower() in word):
                want.add((x, f"n{k}"))
    assert {(r.query, r.id) for r in got} == want and len(got) == len(want)


def test_rounds_of_the_proximity_choice_leave_only_what_they_kept(spark):
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    rows = spark.range(2_000).selectExpr("id % 3 as page", "id as pos", "'HV-1' as tag", "(id * 37) % 400 - 90 as x", "(id * 53) % 300 as y", "id % 11 as conf")
    kept = tags.dedup_proximity(rows, 50).count()
    left = [spark.read.parquet(f"{folder}/{name}").count() for name in set(os.listdir(folder)) - before if name.startswith("cut-")]
    assert kept == sum(left) and len([n for n in left if n]) > 1


def test_written_graphs_are_compressed(spark):
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    io_queries.write_graph(Source(spark, "/root/testdata/sf0.001"))
    (name,) = [x for x in set(os.listdir(folder)) - before if x.startswith("drawgraph-graphs-")]
    whole = spark.read.text(f"{folder}/{name}").agg(F.sum(F.octet_length("value"))).first()[0]
    assert _bytes(f"{folder}/{name}") < whole / 3


def test_regions_of_more_than_one_block_keep_their_origins(spark, monkeypatch):
    edges = spark.range(200).selectExpr("concat('a', id) as src", "concat('b', id % 7) as dst", "'process' as kind")
    origins = spark.range(200).selectExpr("concat('a', id) as origin")
    want = sorted((f"a{k}", f"b{k % 7}", 1) for k in range(200))
    assert sorted(map(tuple, graph.impact_region(edges, origins).collect())) == want
    monkeypatch.setattr(graph, "SENT_ORIGINS", 10)
    assert sorted(map(tuple, graph.impact_region(edges, origins).collect())) == want


def test_rounds_of_components_leave_one_table(spark):
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    edges = spark.range(0, 60, 1, 4).selectExpr("lpad((id * 7) % 61, 3, '0') as src", "lpad((id * 7 + 7) % 61, 3, '0') as dst")
    nodes = spark.range(61).selectExpr("lpad(id, 3, '0') as id")
    got = graph.connected_components(edges, nodes, task_rows=0).collect()
    assert {r.component for r in got} == {"000"} and len(got) == 61
    assert len([x for x in set(os.listdir(folder)) - before if x.startswith("cut-")]) == 1
