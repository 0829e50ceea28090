"""Soft-membership mixing: document rates whose expected domain totals match target weights."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawgraph.llm.common import cut
from drawgraph.llm.shingles import slices, word_hashes

#: Hashed word features of the classifier.
FEATURES = 1024
#: Labelled rows on which the classifier is fitted.
FIT_ROWS = 8_000
#: The descent ends when every domain total is within this share of its target, or when the largest distance from a
#: target has not fallen by a tenth in so many rounds: then no rates come closer by much.
TOLERANCE, PATIENCE = 1e-4, 25
#: Rounds between cuts of the rates' lineage.
CUT_EVERY = 8
DOMAINS = ("good", "poor", "toxic")


def label_domains(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, domain) of a quality and toxicity table: toxic, else poor, else good; rows without a label go."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    return labels.select(id_col, domain.alias("domain")).filter(F.col("domain").isNotNull() & F.col(id_col).isNotNull())


def _features(text: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of word frequencies by hash, and the words of each text."""
    with np.errstate(over="ignore"):
        words, first = word_hashes(text)
    slot = (words % np.uint64(FEATURES)).astype(np.int64)
    n = np.diff(first)
    row = np.repeat(np.arange(len(text)), n)
    counts = np.bincount(row * FEATURES + slot, minlength=len(text) * FEATURES).reshape(len(text), FEATURES)
    return np.sqrt(counts / np.maximum(n, 1)[:, None]), n


def _blocks(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for some in slices(texts):
        for k in range(0, len(some), 2000):
            yield _features(some[k : k + 2000])


def fit(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...], id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a softmax regression on at most ``FIT_ROWS`` labelled documents, taken by hash of the id."""
    numbers = F.create_map(*[x for k, d in enumerate(domains) for x in (F.lit(d), F.lit(float(k)))])
    some = (
        labelled.filter(F.col("domain").isin(*domains))
        .select(F.col(id_col).alias("_id"), F.get(F.array(numbers[F.col("domain")]), F.lit(0)).alias("label"))
        .dropDuplicates(["_id"])
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(FIT_ROWS)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            labels = batch.column(0)
            for x, n in _blocks(batch.column(1).cast(pa.binary()).to_pylist()):
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * FEATURES, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([labels.slice(at, len(n)), flat], names=["label", "x"])
                at += len(n)

    rows = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
        .join(F.broadcast(some), "_id")
        .select("label", "text")
        .mapInArrow(run, "label double, x array<double>")
        .select("label", array_to_vector("x").alias("features"))
    )
    rows = cut(rows)
    weights, bias = np.zeros((FEATURES, len(domains))), np.zeros(len(domains))
    seen = sorted(int(r["label"]) for r in rows.select("label").distinct().collect())  # one row for each domain at most
    bias[[k for k in range(len(domains)) if k not in seen]] = -50.0 if seen else 0.0
    if len(seen) > 1:
        model = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=40).fit(rows)
        w, b = model.coefficientMatrix.toArray().T, model.interceptVector.toArray()
        weights[:, seen], bias[seen] = w[:, seen], b[seen]
    return weights, bias


def posteriors(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str, text_col: str) -> DataFrame:
    """Rows (id, h, tokens, p): words of each document and its posterior over the domains."""
    kind = docs.schema[id_col].dataType.simpleString()
    weights, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x, n in _blocks(batch.column(2).cast(pa.binary()).to_pylist()):
                z = x @ weights + bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * len(bias), pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(n)), batch.column(1).slice(at, len(n)), pa.array(n, pa.int64()), flat],
                    names=["id", "h", "tokens", "p"],
                )
                at += len(n)

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), text.alias("text")).mapInArrow(
        run, f"id {kind}, h long, tokens long, p array<double>"
    )


def solve(rows: DataFrame, targets: list[float], budget: float = 1.0) -> DataFrame:
    """``rows`` (tokens, p, …) with ``rate`` >= 0 such that sums of rate * tokens * p match the targets.

    Projected gradient on the sum over domains of (total - target)^2 / (2 natural total), from rates of 1, with the
    tokens as metric; in it a step of 1 never overshoots, as posteriors sum to 1. Each round sends one number for each
    domain to the driver. A domain without natural tokens is left out, and the other targets are scaled up.

    ``residual``, the same in all rows, is the largest distance of a total from its target, as a share of all natural
    tokens. Targets that no rates reach give the nearest totals that the descent finds, and a residual that tells so.
    """
    k = len(targets)
    sums = lambda df: [float(x or 0.0) for x in df.agg(*[F.sum(F.col("rate") * F.col("tokens") * F.get("p", F.lit(i))) for i in range(k)]).first()]
    rows = rows.withColumn("rate", F.lit(1.0))
    natural = sums(rows)
    whole = sum(natural)
    share = [t if s > 0 else 0.0 for t, s in zip(targets, natural, strict=True)]
    goal = [budget * whole * t / (sum(share) or 1.0) for t in share]
    total = natural
    distance = lambda total: max((abs(a - g) for a, g, s in zip(total, goal, natural, strict=True) if s > 0), default=0.0) / (whole or 1.0)
    mark, marked = distance(total), 0
    for step in itertools.count(1):
        if all(abs(a - g) <= TOLERANCE * max(g, whole * 1e-6) for a, g, s in zip(total, goal, natural, strict=True) if s > 0):
            break
        pull = [(a - g) / s if s > 0 else 0.0 for a, g, s in zip(total, goal, natural, strict=True)]
        change = sum((F.get("p", F.lit(i)) * pull[i] for i in range(k)), F.lit(0.0))
        rows = rows.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - change))
        if step % CUT_EVERY == 0:
            rows = cut(rows)
        total = sums(rows)
        if distance(total) < 0.9 * mark:
            mark, marked = distance(total), step
        elif step - marked >= PATIENCE:
            break
    return rows.withColumn("residual", F.lit(distance(total)))


def rates(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    budget: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Posterior, rate and number of copies of every document.

    ``labelled`` (id, domain) trains the classifier; ``targets`` gives each domain's weight; ``budget`` scales the
    tokens of the mixture. ``copies`` rounds the rate to a whole number by a fixed draw from the id and text.

    Returns id, h (hash of the text), tokens, p_<domain>, rate, residual (see ``solve``), copies. Null and empty texts have no tokens and the
    posterior of the biases; null ids and repeated rows are kept; without labels all posteriors are equal; an empty
    table gives no rows; other columns are not read.
    """
    domains = tuple(targets)
    model = fit(docs, labelled, domains, id_col, text_col)
    rows = cut(posteriors(docs, model, id_col, text_col))
    rows = solve(rows, [targets[d] for d in domains], budget)
    draw = F.pmod(F.xxhash64(F.lit("copies"), "id", "h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.select(
        F.col("id").alias(id_col),
        "h",
        "tokens",
        *[F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(domains)],
        "rate",
        "residual",
        F.floor(F.col("rate") + draw).cast("int").alias("copies"),
    )


def mixture(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    budget: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with each row repeated ``copies`` times (see ``rates``); rows of 0 copies go."""
    found = rates(docs, labelled, targets, budget, id_col, text_col)
    found = found.select(F.col(id_col).alias("_mix_id"), F.col("h").alias("_mix_h"), F.col("copies").alias("_mix_n"))
    found = found.dropDuplicates(["_mix_id", "_mix_h"])
    h = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    joined = docs.join(found, (h == F.col("_mix_h")) & F.col(id_col).eqNullSafe(F.col("_mix_id")))
    return joined.withColumn("_mix_k", F.explode(F.array_repeat(F.lit(0), F.col("_mix_n")))).select(*[docs[c] for c in docs.columns])
