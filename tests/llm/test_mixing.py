import random

import numpy as np
import pytest

from drawgraph.llm import mixing


def corpus():
    rng = random.Random(11)
    words = {d: [f"{d}{i}" for i in range(60)] for d in mixing.DOMAINS}
    rows, truth = [], {}
    for i in range(900):
        d = rng.choice(["good", "good", "good", "poor", "toxic"])
        other = rng.choice(mixing.DOMAINS)
        text = " ".join(rng.choice(words[d] if rng.random() < 0.8 else words[other]) for _ in range(rng.randint(5, 120)))
        rows.append((i, text, 1))
        truth[i] = d
    return rows, truth


def test_classifier_is_right_on_held_out_rows_and_totals_match_targets(spark):
    rows, truth = corpus()
    docs = spark.createDataFrame([*rows, (5000, None, 1), (None, "good1 good2", 1), rows[0]], "doc_id long, text string, rate int")
    labelled = spark.createDataFrame([(i, d) for i, d in truth.items() if i < 400], "doc_id long, domain string")
    targets = {"good": 0.5, "poor": 0.3, "toxic": 0.2}
    out = mixing.rates(docs, labelled, targets, budget=1.2)
    got = out.toPandas()
    assert len(got) == len(rows) + 3 and (got.rate >= 0).all()
    held_out = got[got.doc_id.between(400, 899)]
    best = held_out[[f"p_{d}" for d in targets]].to_numpy().argmax(axis=1)
    right = np.mean([list(targets)[b] == truth[i] for b, i in zip(best, held_out.doc_id.astype(int), strict=True)])
    assert right >= 0.95
    total = got.tokens.sum()
    for d, t in targets.items():
        assert (got.rate * got.tokens * got[f"p_{d}"]).sum() == pytest.approx(1.2 * t * total, rel=1e-3)
    assert (abs(got.copies - got.rate) < 1).all()


def test_rates_match_a_plain_solver(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.5, 0.5, 0.5], 200)
    n = rng.integers(1, 500, 200)
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "tokens long, p array<double>")
    got = mixing.solve(df, [0.6, 0.1, 0.3]).toPandas()
    a = n[:, None] * p
    goal, natural, r = np.array([0.6, 0.1, 0.3]) * n.sum(), a.sum(axis=0), np.ones(200)
    for _ in range(10_000):
        gap = r @ a - goal
        if (abs(gap) <= mixing.TOLERANCE * goal).all():
            break
        r = np.maximum(0, r - p @ (gap / natural))
    key = lambda rate, tokens: sorted(zip(tokens, np.round(rate, 9), strict=True))
    assert key(got.rate, got.tokens) == key(r, n)


def test_mixture_repeats_and_drops_rows(spark):
    rows, truth = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate int")
    labelled = spark.createDataFrame(list(truth.items()), "doc_id long, domain string")
    targets = {"good": 0.9, "poor": 0.05, "toxic": 0.05}
    out = mixing.mixture(docs, labelled, targets, 1.5)
    assert out.columns == docs.columns
    copies = {r.doc_id: r.copies for r in mixing.rates(docs, labelled, targets, 1.5).collect()}
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {d: c for d, c in copies.items() if c}


def test_no_labels_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, domain string")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = mixing.rates(docs, none, {"good": 0.5, "poor": 0.5}).collect()
    assert [r.rate for r in got] == [1.0, 1.0] and got[0].p_good == 0.5
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert mixing.mixture(empty, none, {"good": 0.5, "poor": 0.5}).collect() == []


def test_label_domains(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 1), (4, None, None), (None, 1, 0), (5, 1, None)], "doc_id long, quality int, toxic int")
    assert sorted(tuple(r) for r in mixing.label_domains(labels).collect()) == [(1, "good"), (2, "poor"), (3, "toxic"), (5, "good")]


def test_targets_out_of_reach_end_with_a_residual(spark):
    """Every document is half one domain, half the other: no rates give 90 to 10."""
    df = spark.createDataFrame([(10, [0.5, 0.5])] * 20, "tokens long, p array<double>")
    got = mixing.solve(df, [0.9, 0.1]).select("rate", "residual").distinct().collect()
    assert len(got) == 1 and abs(got[0].rate - 1.0) < 1e-6 and abs(got[0].residual - 0.4) < 1e-6
    near = mixing.solve(spark.createDataFrame([(10, [0.8, 0.2]), (10, [0.2, 0.8])], "tokens long, p array<double>"), [0.6, 0.4]).first()
    assert near.residual <= 1e-4
