import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from drawgraph.llm.clustering import clusters, dots, ints_of, nearest, planes_of, squares
from drawgraph.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=40, rounds=5):
    rows = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(rows, key=lambda r: hashlib.sha256(f"2:{r[0]}".encode()).hexdigest())
    x, c = np.array([v for _, v in rows], np.int64), np.array([v for _, v in order[:k]], np.int64)

    def assign():
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        a, _ = assign()
        for j in range(len(c)):
            if (a == j).any():
                c[j] = x[a == j].sum(axis=0) // (a == j).sum()
    a, d = assign()
    sha = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.tolist()]
    return sorted((rows[i][0], int(a[i]), int(d[i]), int(d[a == a[i]].sum()), int(d.sum()), sha[a[i]]) for i in range(len(rows)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**27) + 1, 2**27 - 1), min_size=64, max_size=64), min_size=2, max_size=4), st.integers(0, 26))
def test_planes_give_exact_products(vectors, shift):
    x = np.array(vectors, np.int64) >> shift
    planes = planes_of(x)
    assert (ints_of(planes) == x).all()
    assert (dots(planes, planes_of(x[:1])) == x @ x[:1].T).all()
    assert (squares(planes) == (x * x).sum(axis=1)).all()
    cluster, distance = nearest(planes, x[:2])
    want = ((x[:, None] - x[None, :2]) ** 2).sum(axis=2)
    assert (cluster == want.argmin(axis=1)).all() and (distance == want.min(axis=1)).all()


def test_against_brute_force_with_copies_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(64) * (20 if i % 50 == 0 else 0.2)).tolist()) for i in range(700)]
    rows += [(2000 + i, rows[4][1]) for i in range(350)]  # a third are copies of one
    rows += [(3000 + i, [0.0] * 64) for i in range(60)]  # and some tie
    odd = [(9000, None), (9001, [1.0] * 63), (9002, [1.0] * 65), (9003, [None] + [1.0] * 63), (9004, [float("nan")] * 64), (9005, [float("inf")] + [0.0] * 63), (9006, [])]
    got = clusters(spark.createDataFrame(rows + odd, SCHEMA).repartition(6)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_whole_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, [float(v) for v in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op13_centroid_clustering"](spark, sf).collect()) == brute(rows)


def test_few_vectors_null_and_equal_ids_empty_table_and_columns(spark):
    schema = "vec_id string, embedding array<float>, cluster string, planes int"
    assert clusters(spark.createDataFrame([], schema)).collect() == []
    assert clusters(spark.createDataFrame([("a", None, "", 1), ("b", [1.0], "", 1)], schema)).collect() == []
    one = [float(i % 2) for i in range(64)]
    rows = [("a", one, "", 1), ("a", one, "", 1), (None, [0.5] * 64, "", 1), ("huge", [1e30] + [0.0] * 63, "", 1)]
    got = clusters(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.vec_id), r.distance) for r in got) == [("None", 0), ("a", 0), ("a", 0)]
    assert {r.cluster for r in got if r.vec_id == "a"} == {0} and {r.inertia for r in got} == {0}
