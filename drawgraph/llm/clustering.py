"""Centroid clustering on bit planes: AND-popcounts give exact dot products, distances and assignments.

The integer components of a vector are written in two's complement. Plane k holds bit k of all 64 components in one
64-bit word, so a vector is a short list of words, and a dot product is a weighted sum of the ones that two planes share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawgraph.llm.common import cut

#: Components of a vector: the bits of a word.
WIDTH = 64
#: Components are below this in size, so that a squared distance of 64 of them fits a long.
LIMIT = 1 << 27
#: Distances that a task holds at once.
BLOCK = 1 << 20


def planes_of(ints: np.ndarray) -> np.ndarray:
    """Bit planes (rows, bits) of whole numbers (rows, 64), with as many bits as the largest needs, sign included."""
    most = int(np.where(ints < 0, ~ints, ints).max(initial=0))
    bits = (ints[:, None, :] >> np.arange(most.bit_length() + 1, dtype=np.int64)[None, :, None]) & 1
    return np.packbits(bits.astype(bool), axis=2, bitorder="little").view("<u8")[:, :, 0]


def ints_of(planes: np.ndarray) -> np.ndarray:
    """The numbers (rows, 64) of planes (rows, bits)."""
    raw = np.ascontiguousarray(planes.astype("<u8")).view(np.uint8).reshape(*planes.shape, 8)
    bits = np.unpackbits(raw, axis=2, bitorder="little").astype(np.int64)
    return np.einsum("nkc,k->nc", bits, weights(planes.shape[1]))


def weights(bits: int) -> np.ndarray:
    """What a bit of each plane is worth; the last one is the sign."""
    out = np.int64(1) << np.arange(bits, dtype=np.int64)
    out[-1] = -out[-1]
    return out


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products (rows of a, rows of b) of vectors given as planes."""
    out = np.zeros((len(a), len(b)), np.int64)
    for k, w in enumerate(weights(a.shape[1]).tolist()):
        shared = np.zeros(out.shape, np.int64)
        for m, v in enumerate(weights(b.shape[1]).tolist()):
            shared += np.bitwise_count(a[:, k, None] & b[None, :, m]) * np.int64(v)
        out += shared * np.int64(w)
    return out


def squares(a: np.ndarray) -> np.ndarray:
    """Dot product of each vector with itself."""
    out = np.zeros(len(a), np.int64)
    w = weights(a.shape[1])
    for k in range(a.shape[1]):
        out += w[k] * (np.bitwise_count(a[:, k, None] & a).astype(np.int64) @ w)
    return out


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smallest) and the squared distance, for planes and numbers."""
    own = planes_of(centroids)
    lengths = squares(own)
    cluster, distance = np.zeros(len(planes), np.int32), np.zeros(len(planes), np.int64)
    step = max(1, BLOCK // len(own))
    for at in range(0, len(planes), step):
        some = planes[at : at + step]
        d = squares(some)[:, None] + lengths[None, :] - 2 * dots(some, own)
        cluster[at : at + step] = d.argmin(axis=1)
        distance[at : at + step] = d.min(axis=1)
    return cluster, distance


def _planes_in(column: pa.ListArray) -> np.ndarray:
    """Planes of a batch; rows with fewer bits repeat their sign."""
    length = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    first = np.cumsum(length) - length
    at = np.minimum(np.arange(length.max(initial=1))[None, :], length[:, None] - 1)
    return flat[first[:, None] + at].view(np.uint64)


def pack(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """Rows (id, planes) of the vectors that take part."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
            planes = planes_of(ints)
            offsets = np.arange(len(planes) + 1, dtype=np.int32) * planes.shape[1]
            packed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(planes.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["id", "planes"])

    whole = F.forall("v", lambda c: F.coalesce(F.abs(c.cast("double")) * scale < LIMIT, F.lit(False)))  # not for NaN either
    ints = F.transform("v", lambda c: F.floor(c.cast("double") * scale))
    return (
        vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
        .filter(F.size("v") == WIDTH)
        .filter(whole)
        .select("id", ints.alias("x"))
        .mapInArrow(run, f"id {kind}, planes array<bigint>")
    )


def _starts(held: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors of the smallest hashes of ``seed:id``, in that order; null ids come last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = held.select(order.alias("o"), "planes").orderBy(F.col("o").asc_nulls_last(), "planes").limit(k).collect()  # k rows
    found = [ints_of(np.array([r["planes"]], np.int64).view(np.uint64)) for r in rows]
    return np.concatenate(found) if found else np.zeros((0, WIDTH), np.int64)


def _moved(held: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of its vectors' mean; one without vectors stays."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, WIDTH), np.int64)
        for batch in batches:
            planes = _planes_in(batch.column(0))
            for at in range(0, len(planes), BLOCK // WIDTH):
                some = planes[at : at + BLOCK // WIDTH]
                cluster, _ = nearest(some, centroids)
                one = (cluster[None, :] == np.arange(k)[:, None]).astype(np.float64)
                total += (one @ ints_of(some).astype(np.float64)).astype(np.int64)  # below 2 ** 53
                count += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], names=["cluster", "n", "total"]
        )

    # k x 64 numbers, whatever the input
    sums = (
        held.select("planes")
        .mapInArrow(run, "cluster int, n bigint, total array<bigint>")
        .select("cluster", "n", F.posexplode("total").alias("at", "v"))
        .groupBy("cluster", "at")
        .agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        .collect()
    )
    out = centroids.copy()
    for r in sums:
        out[r["cluster"], r["at"]] = int(r["v"]) // r["n"]
    return out


def clusters(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    seed: str = "2",
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per kept vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly 64 components, none null, NaN or infinite; a component x counts as floor(``scale`` x).
    The first centroids are the ``k`` kept vectors with the smallest SHA-256 of ``seed:id``, in that order. Each round
    assigns every vector to the nearest centroid (ties: the smaller number) and moves a centroid with vectors to the
    floor of their mean; afterwards vectors are assigned once more. All numbers are exact. ``centroid_sha256`` is of
    the final centroid's components as decimal numbers joined by commas.

    Only centroids and their sums, k x 64 numbers, pass through the driver. Vectors are read from a checkpoint of their
    planes in each round and never shuffled.

    A vector with a component whose number reaches 2 ** 27 in size has no exact distance in a long and isn't kept.
    Null ids are kept but start no centroid before others; repeated rows count each; of equal ids the smaller planes
    come first. Fewer than ``k`` kept vectors make fewer centroids. A sum of distances beyond a long is null. An empty
    table gives no rows; other columns are not read.
    """
    held = cut(pack(vectors, id_col, vector_col, scale))
    kind = vectors.schema[id_col].dataType.simpleString()
    centroids = _starts(held, k, seed)
    if not len(centroids):
        none = "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, {none}")
    for _ in range(rounds):
        centroids = _moved(held, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(_planes_in(batch.column(1)), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array(distance)], names=["id", "cluster", "distance"])

    placed = cut(held.mapInArrow(run, f"id {kind}, cluster int, distance bigint"))
    inertia = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))  # k rows at most
    inertia = inertia.join(F.broadcast(inertia.agg(F.sum("own").alias("all"))))
    digests = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids.tolist()])
    return placed.join(F.broadcast(inertia), "cluster").select(
        F.col("id").alias(id_col),
        "cluster",
        "distance",
        F.col("own").try_cast("bigint").alias("cluster_inertia"),
        F.col("all").try_cast("bigint").alias("inertia"),
        F.get(digests, F.col("cluster")).alias("centroid_sha256"),
    )
