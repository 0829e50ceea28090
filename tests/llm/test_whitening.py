import numpy as np
import pytest

from drawgraph.llm import whitening
from drawgraph.llm.queries import QUERIES
from drawgraph.llm.whitening import leading, whiten

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows):
    """(ids, n, deviations, whitened up to sign, shares) of rows (id, vector), by numpy's own eigenvalues."""
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([np.floor(64 * np.array(v)) + 1_000_000 for _, v in rows]).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    values, directions = np.linalg.eigh(y.T @ y / n)
    values, directions = values[::-1][:16], directions[:, ::-1][:, :16]
    deviations = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    return [i for i, _ in rows], n, deviations, (x - s / n) @ directions / np.sqrt(values), values / np.trace(y.T @ y / n)


def compare(got, rows):
    ids, n, deviations, want, shares = brute(rows)
    assert len(got) == want.size
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
        assert r.n == n and r.identity_error <= 1e-4
    for k in range(want.shape[1]):
        mine = sorted(by[k + 1], key=lambda r: (r.vec_id, r.deviation, r.whitened))
        assert sorted((r.vec_id, r.deviation) for r in mine) == sorted(zip(ids, deviations, strict=True))
        value = {}
        for i, w in zip(ids, want[:, k], strict=True):
            value.setdefault(i, []).append(w)
        first = np.array([r.whitened for r in mine if len(value[r.vec_id]) == 1])
        other = np.array([value[r.vec_id][0] for r in mine if len(value[r.vec_id]) == 1])
        assert min(np.abs(first - other).max(), np.abs(first + other).max()) < 1e-7
        assert mine[0].explained == pytest.approx(shares[k], rel=1e-9)


@pytest.mark.parametrize(
    "matrix",
    [
        np.eye(5),
        np.ones((6, 6)),
        np.diag([3.0, 3, 3, 1, 1, 0]),
        np.zeros((3, 3)),
        np.array([[2.0]]),
        np.array([[2.0, 1], [1, 2]]),
        np.diag([1e8, 1e8 - 1, 1e8 - 2, 1e-3]),
        (lambda a: a @ a.T)(np.random.default_rng(1).standard_normal((64, 64))),
        (lambda a: a @ a.T)(np.random.default_rng(2).standard_normal((90, 20))),  # most eigenvalues are zero
        np.kron(np.eye(8), (lambda a: a @ a.T)(np.random.default_rng(3).standard_normal((4, 4)))),  # each one eight times
        np.diag(np.abs(np.arange(-10, 11.0))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1),  # pairs that differ by rounding only
    ],
)
def test_leading_eigenvectors(matrix):
    values, vectors = leading(matrix, 16)
    size = max(1.0, np.abs(matrix).max())
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:16], atol=1e-12 * size * len(matrix), rtol=0)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-11 * size * len(matrix)


def test_sturm_counts():
    rng = np.random.default_rng(5)
    d, e = rng.standard_normal(30), rng.standard_normal(29)
    e[7] = 0.0
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.concatenate([values - 1e-9, values + 1e-9, [-100, 100]])
    assert (whitening.below(d, e, at) == [(values < x).sum() for x in at]).all()


def test_against_numpy_with_copies_and_odd_rows(spark):
    rng = np.random.default_rng(7)
    mix = rng.standard_normal((24, 24))
    rows = [(i, (mix @ rng.standard_normal(24)).tolist()) for i in range(900)]
    rows += [(5000 + i, rows[3][1]) for i in range(500)]  # a third are copies of one
    rows += [(10, rows[10][1]), (7000, [v + 1e-9 for v in rows[20][1]])]
    odd = [(8000, None), (8001, [None] + [1.0] * 23), (8002, [float("nan")] + [1.0] * 23), (8003, [float("-inf")] + [1.0] * 23)]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(7)
    compare(whiten(df).collect(), rows)


def test_whole_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, [float(v) for v in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compare(QUERIES["op11_whitening"](spark, sf).collect(), rows)


def test_large_numbers_keep_exact_deviations(spark):
    rows = [(i, [float(i % 7) * 2**30, float(i)]) for i in range(40)]
    got = {r.vec_id: r.deviation for r in whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    ids, _, deviations, _, _ = brute(rows)
    assert got == {i: d if d < 2**63 else None for i, d in zip(ids, deviations, strict=True)}


def test_no_direction_no_component(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)
    assert whiten(same).collect() == []
    line = spark.createDataFrame([(i, [float(i), 5.0, 2.0 * i]) for i in range(9)], SCHEMA)
    assert {r.component for r in whiten(line).collect()} == {1}


def test_empty_table_other_lengths_ids_and_columns(spark):
    extra = "vec_id string, embedding array<float>, n int, x string, component string"
    assert whiten(spark.createDataFrame([], extra)).collect() == []
    assert whiten(spark.createDataFrame([("a", [], 1, "", ""), ("b", None, 1, "", "")], extra)).collect() == []
    rows = [(f"v{i}", [float(i), float(i * i % 11)], 1, "", "") for i in range(20)]
    rows += [(None, [3.0, 4.0], 2, "", ""), ("long", [1.0, 2.0, 3.0], 2, "", ""), ("huge", [1e30, 0.0], 2, "", "")]
    got = whiten(spark.createDataFrame(rows, extra)).collect()
    assert sorted({str(r.vec_id) for r in got}) == sorted({str(r[0]) for r in rows} - {"long", "huge"})
    assert {r.component for r in got} == {1, 2} and {r.n for r in got} == {21}
