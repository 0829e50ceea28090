"""Two-level ranks against plain windows, and the operators that use them on keys of half the rows."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from drawgraph.operators import boxes, ranks, retrieval


def rows_of(rng, n):
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None, "c"]), i, rng.choice([None, 1, 2, 30])) for i in range(n)]
    rng.shuffle(rows)
    return rows


def test_ranks_and_sums_of_hot_keys(spark):
    rows = rows_of(random.Random(1), 3000)
    df = spark.createDataFrame(rows, "k string, o long, v int").repartition(5)
    by = defaultdict(list)
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        by[k].append((o, v))
    want = set()
    for k, x in by.items():
        total, some = 0, False
        for i, (o, v) in enumerate(x):
            total, some = total + (v or 0), some or v is not None
            want.add((k, o, i + 1, total if some else None, len(x), sum(v or 0 for _, v in x)))
    for most in (10, 100, 5000):
        got = ranks.ranked(df, ["k"], [F.col("o")], {"run": F.col("v")}, totals=True, most=most)
        assert {(r.k, r.o, r["rank"], r.run, r.rows, r.all_run) for r in got.collect()} == want


def test_no_task_holds_a_hot_key(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    dealt = ranks.ranked(df, ["k"], [F.col("id")], most=500)
    assert dealt.filter("k = 'hot'").agg(F.max("rank")).first()[0] == 10_000
    sizes = Counter(r[0] for r in df.repartitionByRange(40, "k", "id").select(F.spark_partition_id()).collect())
    assert max(sizes.values()) <= 3 * sorted(sizes.values())[len(sizes) // 2]


def test_operators_give_the_same_rows_for_hot_keys(spark, monkeypatch):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "en").otherwise(F.concat(F.lit("l"), (F.col("id") % 5).cast("string"))).alias("lang"))
    docs = docs.withColumns({"text": F.repeat(F.lit("word "), (F.col("doc_id") % 17).cast("int")), "source": F.concat("lang", F.lit(".docx"))})
    calls = {
        "split": lambda: boxes.stratified_split(docs, "lang", "doc_id"),
        "number": lambda: boxes.number_rows(docs, "lang", ["doc_id"]),
        "batch": lambda: retrieval.batch_rows(docs, "lang", "doc_id", 7),
        "pack": lambda: retrieval.pack_context(docs, "lang", "doc_id"),
    }
    plain = {k: sorted(map(tuple, f().collect()), key=str) for k, f in calls.items()}
    ranked = ranks.ranked
    for module in (boxes, retrieval):
        monkeypatch.setattr(module, "ranked", lambda *a, **k: ranked(*a, **k, most=20))
    assert {k: sorted(map(tuple, f().collect()), key=str) for k, f in calls.items()} == plain
    assert len(plain["split"]) == 900 and max(r[-1] for r in plain["batch"]) >= 0


def test_draws_go_on_until_the_target_and_count_for_later_classes(spark):
    tiles = [(t, c, n) for t, c, n in [(1, 1, 3), (2, 1, 1), (2, 2, 5), (3, 2, 2), (4, 3, 9), (5, 1, 0)]]
    targets = {1: 1003, 2: 300, 7: 50, 3: 5}
    got = boxes.oversample_minority(spark.createDataFrame(tiles, "tile long, cls int, n int"), targets).collect()
    have, order = Counter(), defaultdict(list)
    for t, c, n in tiles:
        have[c] += n
    hash_of = {(r.t, r.c): r.h for r in spark.createDataFrame([(t, c) for t, c, _ in tiles], "t long, c int").select("*", boxes.seeded("t", "c").alias("h")).collect()}
    held = {(t, c): n for t, c, n in tiles if n}
    for t, c in sorted(held, key=lambda x: (hash_of[x], x[0])):
        order[c].append(t)
    want = Counter()
    for c, target in targets.items():
        i = 0
        while order[c] and have[c] < target:
            t = order[c][i % len(order[c])]
            want[c, t] += 1
            for d in (1, 2, 3):
                have[d] += held.get((t, d), 0)
            i += 1
    assert Counter((r.cls, r.tile) for r in got) == want and want[1, 1] > 200
    assert {(r.cls, r.tile, r.copy) for r in got} == {(c, t, i) for (c, t), n in want.items() for i in range(1, n + 1)}


def test_chunks_keep_the_type_of_ids(spark):
    df = spark.createDataFrame([("a", "x" * 300), (None, None)], "doc_id string, text string")
    assert [(r.doc_id, r.start) for r in retrieval.chunk_text(df).collect()] == [("a", 0)]
