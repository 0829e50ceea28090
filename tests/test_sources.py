import json
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from drawgraph.sources import corpus, readers, schemas, sinks
from drawgraph.streaming import incremental


def png(path, width, height, gray):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\x00" + bytes([gray if y < height // 2 else 255]) * width for y in range(height))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def test_graph_files_and_broken_ones(spark, tmp_path):
    doc = {"schema_version": "pid.graph.v0.1.1", "nodes": [{"id": "a:1", "type": "valve", "props": {"x": [1]}}, {"id": "b", "type": "line"}], "edges": [{"id": "e", "from": "a:1", "to": "b", "kind": "process"}]}
    (tmp_path / "p1.graph.json").write_text(json.dumps(doc))
    (tmp_path / "p2.graph.json").write_text("Here is the graph.\n\n" + json.dumps(doc))
    nodes, edges = readers.read_graphs(spark, str(tmp_path))
    assert sorted((r.pid, r.node_seq, r.id, r.props and json.loads(r.props)) for r in nodes.collect()) == [("p1", 0, "a:1", {"x": [1]}), ("p1", 1, "b", None)]
    assert [(r.src, r.dst, r.edge_seq) for r in edges.collect()] == [("a:1", "b", 0)]
    bad = readers.graph_documents(spark, str(tmp_path)).filter("_corrupt_record is not null")
    assert [r.pid for r in bad.select("pid").collect()] == ["p2"]


def test_graphs_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("d1", 1, "x", "valve"), ("d1", 0, "y", "line"), ("d2", 0, "z", None)], "pid string, node_seq long, id string, type string")
    edges = spark.createDataFrame([("d1", "0", "e", "x", "y")], "pid string, edge_seq string, id string, src string, dst string")
    sinks.write_graphs(nodes, edges, str(tmp_path / "out"))
    back = readers.parse_graphs(spark.read.text(str(tmp_path / "out")).select("pid", F.col("value").alias("json")))
    n, e = readers.explode_graphs(back)
    assert sorted((r.pid, r.node_seq, r.id) for r in n.collect()) == [("d1", 0, "y"), ("d1", 1, "x"), ("d2", 0, "z")]
    assert [(r.src, r.dst) for r in e.collect()] == [("x", "y")]


def test_tag_lists(spark, tmp_path):
    forms = {"a": '["X-1", "X-2"]', "b": '{"tags": [{"tag": "X-3"}, {"tag": "X-4"}]}', "c": '{"items": ["X-5"]}', "d": "no json", "e": '{"other": 1}'}
    for name, text in forms.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = sorted((r.pid, r.tag) for r in readers.read_tag_lists(spark, str(tmp_path)).collect())
    assert got == [("a", "X-1"), ("a", "X-2"), ("b", "X-3"), ("b", "X-4"), ("c", "X-5")]


def test_label_sheet_split_and_pixel_files(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "img1.txt").write_text("1 0.5 0.5 0.1 0.2\n\n2 0.5 0.5\nx 1 1 1 1\n")
    assert sorted((r.stem, r.cls, r.bh) for r in readers.read_yolo_labels(spark, str(tmp_path / "l")).filter("cls is not null").collect()) == [("img1", 1, 0.2)]
    (tmp_path / "s.csv").write_text(" Tag ,,Size\nA,1,2\n,,\nB,,3\n")
    sheet = readers.read_sheets(spark, str(tmp_path), ["s"])["s"]
    assert sheet.columns == ["Tag", "col_1", "Size"] and sheet.count() == 2
    lines = spark.createDataFrame([("1,2,3,ok",), ("1,2",)], "line string")
    assert [(r.pixels, r.label) for r in readers.pixel_rows(lines, 3).collect()] == [([1.0, 2.0, 3.0], "ok")]


def test_graphml_later_data_win(spark, tmp_path):
    head = '<?xml version="1.0"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="k0" attr.name="label"/><key id="k1" attr.name="xmin" for="node"><default>0</default></key><graph>'
    nodes = '<node id="n1"><data key="k0">a</data><data key="k0"><![CDATA[b<&]]></data><data key="k1">3.5</data><data key="k1"/></node><node id="n2"/>\n<node id="n3"><data key="k9">x</data></node>'
    (tmp_path / "g.graphml").write_text(head + nodes + "</graph></graphml>")
    many = "".join(f'<node id="m{i}"><data key="k0">{"long " * 20}</data><data key="k1">{i}</data></node>\n' for i in range(30_000))
    (tmp_path / "h.graphml").write_text(head.replace('"k0"', '"k1_"').replace('"k1"', '"k0"').replace('"k1_"', '"k1"') + many + "</graph></graphml>")  # other names for its keys
    (tmp_path / "bad.graphml").write_text("<graphml><graph><node id=")
    got = readers.read_graphml(spark, str(tmp_path)).collect()
    assert sorted((r.node, r.label, r.xmin, r.xmax) for r in got if r.stem == "g") == [("n1", "b<&", 3.5, None), ("n3", None, None, None)]
    assert sorted(int(r.label) for r in got if r.stem == "h") == list(range(30_000)) and {r.xmin for r in got if r.stem == "h"} == {None}


def test_corpus_is_carried_forward(spark, tmp_path):
    folder, store = tmp_path / "md", str(tmp_path / "store")
    (folder / "sub").mkdir(parents=True)
    names = ["a.md", "b [1].md", "c{x}.md", "sub/d e%.md"]
    for n in names:
        (folder / n).write_text(f"text of {n} é")
    (folder / "no.txt").write_text("no")
    state = lambda: {r.path.rsplit("/", 1)[1]: r.text for r in corpus.read(spark, store).collect()}
    with pytest.raises(FileNotFoundError):
        corpus.read(spark, store)
    assert corpus.refresh(spark, str(folder), store) == corpus.Refresh(1, 4, 0, 0)
    assert state() == {n.split("/")[-1]: f"text of {n} é" for n in names}
    assert corpus.refresh(spark, str(folder), store) == corpus.Refresh(1, 0, 4, 0)
    # a file that is changed behind an unchanged time and size isn't read; one is changed, one added, one gone
    stat = (folder / "a.md").stat()
    (folder / "a.md").write_text("TEXT of a.md é")
    os.utime(folder / "a.md", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    (folder / "b [1].md").write_text("new b")
    (folder / "c{x}.md").unlink()
    (folder / "f.md").write_text("f")
    (folder / "empty.md").write_text("")
    assert corpus.refresh(spark, str(folder), store) == corpus.Refresh(2, 2, 2, 1)
    assert state() == {"a.md": "text of a.md é", "b [1].md": "new b", "d e%.md": "text of sub/d e%.md é", "f.md": "f"}
    # a version without its mark doesn't count
    (tmp_path / "store" / "version=3").mkdir()
    assert corpus.versions(spark, store) == [1, 2] and corpus.read(spark, store, 1).count() == 4
    for p in folder.rglob("*.md"):
        p.unlink()
    assert corpus.refresh(spark, str(folder), store) == corpus.Refresh(3, 0, 0, 4) and state() == {}


def test_corpus_and_images(spark, tmp_path):
    (tmp_path / "a.md").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("no")
    assert [r.text for r in readers.read_corpus(spark, str(tmp_path)).collect()] == ["one\ntwo"]
    (tmp_path / "i").mkdir()
    png(tmp_path / "i" / "x.png", 8, 6, 10)
    row = readers.read_images(spark, str(tmp_path / "i")).first()
    assert (row.height, row.width) == (6, 8)
    share = readers.pixel_shares(readers.read_images(spark, str(tmp_path / "i"))).first()
    assert (share.dark, share.light) == (0.5, 0.5)


def test_manifest_index_and_report(spark, tmp_path):
    labels = spark.createDataFrame([("s1", "d", "train"), ("s1", "d", "train"), ("s2", "d", "val")], "stem string, source string, split string")
    sinks.write_manifest(labels, str(tmp_path / "m"))
    assert sorted((r.stem, r.ann_count) for r in spark.read.option("header", True).csv(str(tmp_path / "m")).collect()) == [("s1", "2"), ("s2", "1")]
    sinks.write_index(labels, str(tmp_path / "i"))
    assert readers.read_index(spark, str(tmp_path / "i")).count() == 3
    sinks.write_report(str(tmp_path / "r"), labels=labels)
    assert spark.read.text(str(tmp_path / "r")).first()[0] == '{"labels":3}'


def test_streams_take_each_file_once(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    event = lambda i: json.dumps({"event_id": i, "event_type": "a"})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(event(1))
    incremental.stream_json(spark, source, schemas.EVENT, sink, checkpoint)
    (tmp_path / "in" / "2.json").write_text(event(2))
    incremental.stream_json(spark, source, schemas.EVENT, sink, checkpoint)
    assert sorted((r.event_id, r.file) for r in spark.read.parquet(sink).collect()) == [(1, "1.json"), (2, "2.json")]


def test_stream_counts_by_hour(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(source).schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(source).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    incremental.stream_counts(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "check"))
    events = spark.read.parquet(source)
    want = {(r.h, r.event_type): r["count"] for r in events.groupBy(F.date_trunc("hour", "ts").alias("h"), "event_type").count().collect()}
    got = {(r.hour, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got and all(want[k] == n for k, n in got.items())
