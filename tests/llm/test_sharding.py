import random
import zlib
from collections import Counter, defaultdict

from drawgraph.llm.sharding import shard_by_bytes


def test_every_row_once_gapless_and_near_equal(spark):
    rng = random.Random(3)
    rows = [(i, "é" * rng.randint(0, 200)) for i in range(3000)]
    rows += [(10_000 + i, "copy " * 20) for i in range(1500)]  # a third in one group of copies
    rows += [(7, None), (7, None), (None, "x"), (8, "same"), (8, "same")]
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 40).collect()
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) == set(range(40))
    for r in by.values():
        assert sorted(x.slot for x in r) == list(range(len(r)))
    sums = [sum(x["size"] for x in r) for r in by.values()]
    assert max(sums) <= 1.06 * sum(sums) / 40 and min(sums) >= 0.94 * sum(sums) / 40
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_small_groups_stay_whole(spark):
    rows = [(i, f"text {i // 2} " * 10) for i in range(4000)]
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    shard = {r.doc_id: r.shard for r in got}
    assert all(shard[i] == shard[i + 1] for i in range(0, 4000, 2))


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, shard int, size string")
    assert shard_by_bytes(empty, 40).collect() == []
    one = spark.createDataFrame([(1, "a", 5, "x")], "doc_id long, text string, shard int, size string")
    assert [(r.shard, r.slot) for r in shard_by_bytes(one, 40).collect()] == [(20, 0)]


def test_rows_of_one_id_and_text_are_dealt_in_parts(spark):
    """A third of all rows are one row, another third one text of null id; ids are strings."""
    rows = [("one", "same text " * 9)] * 900 + [(None, "other " * 11)] * 900 + [(f"s{i}", f"text {i}") for i in range(900)]
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id string, text string").repartition(7), 10).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((d, len(t) + 16) for d, t in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and set(by) == set(range(10))


def test_very_long_texts(spark):
    rows = [(i, "x" * (3_000_000 if i == 7 else 50)) for i in range(50)]
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert {r.doc_id: r["size"] for r in got} == {i: len(t) + 16 for i, t in rows}
