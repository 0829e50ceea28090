"""Merkle trees over the sections and paragraphs of a text."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges of ids for each shuffle partition, and ids that are drawn for each range to find its ends.
RANGES_PER_PARTITION, DRAWN = 4, 32
#: A leaf ends where a hash of the last four bytes divides by the first number; none is longer than the second.
LEAF, LONGEST = 32, 256
#: A section ends after a paragraph whose digest divides by this.
SECTION = 4
#: Bytes of the digests that a fingerprint lists; inner nodes hash whole digests.
SHOWN = 6
_BYTES = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))

# A leaf is (shown digest, code points); a node is (shown digest, code points, children).
Leaf = tuple[str, int]
Node = tuple[str, int, list]


def _digest(parts: list[bytes]) -> bytes:
    return blake2b(b"".join(parts), digest_size=16).digest()


def _leaf_ends(raw: bytes) -> tuple[list[int], list[int], list[bool]]:
    """Ends of the leaves of a text in bytes and in code points, and whether a line ends there."""
    data = np.frombuffer(raw, np.uint8)
    n = len(data)
    wide = np.zeros(n, np.uint32)
    for k, odd in enumerate(_BYTES):
        wide[k:] += data[: n - k].astype(np.uint32) * odd
    wide ^= wide >> np.uint32(15)
    wide *= np.uint32(0x2C1B3C6D)
    starts = (data & 0xC0) != 0x80  # bytes that begin a code point
    whole = np.append(starts[1:], True)
    line = data == 10
    ends = np.flatnonzero((((wide >> np.uint32(12)) % np.uint32(LEAF) == 0) & whole) | line) + 1
    if not len(ends) or ends[-1] < n:
        ends = np.append(ends, n)
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > LONGEST:  # cut at even distances, moved back to where a code point begins
        more = np.concatenate([np.arange(e - g + LONGEST, e, LONGEST) for e, g in zip(ends[gaps > LONGEST], gaps[gaps > LONGEST], strict=True)])
        for _ in range(3):
            more = more - ~starts[more]
        ends = np.unique(np.concatenate((ends, more)))
    points = np.cumsum(starts)[ends - 1]
    return ends.tolist(), np.diff(points, prepend=0).tolist(), line[ends - 1].tolist()


def tree(text: str) -> tuple[str, list[Node]]:
    """Root (32 hex digits) and sections of a text.

    Paragraphs are its lines with their line ends. Their leaves end where the last bytes hash to it, in any script and
    with or without blanks; a run of paragraphs up to one whose digest divides by ``SECTION`` is a section. All cuts
    depend on what stands there, so an edit changes the branches that hold it and no others.
    """
    raw = text.encode("utf-8", "surrogatepass")
    tops: list[bytes] = []
    sections: list[Node] = []
    digests: list[bytes] = []
    nodes: list[Node] = []
    parts: list[bytes] = []
    leaves: list[Leaf] = []
    size = at = 0
    if raw:
        for end, points, line in zip(*_leaf_ends(raw), strict=True):
            d = blake2b(raw[at:end], digest_size=16).digest()
            parts.append(d)
            leaves.append((d[:SHOWN].hex(), points))
            size += points
            at = end
            if line or end == len(raw):
                whole = _digest(parts)
                digests.append(whole)
                nodes.append((whole[:SHOWN].hex(), size, leaves))
                parts, leaves, size = [], [], 0
                if whole[0] % SECTION == 0 or end == len(raw):
                    tops.append(_digest(digests))
                    sections.append((tops[-1][:SHOWN].hex(), sum(x[1] for x in nodes), nodes))
                    digests, nodes = [], []
    return _digest(tops).hex(), sections


def write(root: str, sections: list[Node]) -> str:
    """``root|section:paragraph=leaf.length,…/paragraph=…;section:…``"""
    body = ";".join(
        s[0] + ":" + "/".join(p[0] + "=" + ",".join(f"{d}.{n}" for d, n in p[2]) for p in s[2]) for s in sections
    )
    return f"{root}|{body}"


def read(fingerprint: str) -> tuple[str, list[Node]]:
    root, _, body = fingerprint.partition("|")
    sections = []
    for s in body.split(";") if body else []:
        name, _, rest = s.partition(":")
        paragraphs = []
        for p in rest.split("/"):
            head, _, leaves = p.partition("=")
            pairs = [(d, int(n)) for d, _, n in (x.partition(".") for x in leaves.split(","))]
            paragraphs.append((head, sum(n for _, n in pairs), pairs))
        sections.append((name, sum(p[1] for p in paragraphs), paragraphs))
    return root, sections


def _match(a: list, b: list) -> tuple[int, list, list]:
    """Code points in nodes of equal digest, and the nodes that differ, which alone are descended."""
    left = Counter(x[0] for x in b)
    shared, only_a = 0, []
    for x in a:
        if left[x[0]] > 0:
            left[x[0]] -= 1
            shared += x[1]
        else:
            only_a.append(x)
    only_b = []
    for x in reversed(b):
        if left[x[0]] > 0:
            left[x[0]] -= 1
            only_b.append(x)
    return shared, only_a, only_b[::-1]


def likeness(a: tuple[str, list[Node]], b: tuple[str, list[Node]]) -> float:
    """Shared code points over all, from 0 to 1, found from the roots down; equal roots give 1."""
    if a[0] == b[0]:
        return 1.0
    total = sum(x[1] for x in a[1]) + sum(x[1] for x in b[1])
    shared, x, y = _match(a[1], b[1])
    for _ in range(2):
        more, x, y = _match([c for s in x for c in s[2]], [c for s in y for c in s[2]])
        shared += more
    return min(1.0, 2.0 * shared / total) if total else 1.0


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """Spans (code points) of the text of fingerprint ``a`` whose leaves ``b`` doesn't hold."""
    other = Counter(leaf[0] for s in read(b)[1] for p in s[2] for leaf in p[2])
    out: list[tuple[int, int]] = []
    at = 0
    for s in read(a)[1]:
        for p in s[2]:
            for d, n in p[2]:
                if other[d] > 0:
                    other[d] -= 1
                elif out and out[-1][1] == at:
                    out[-1] = (out[-1][0], at + n)
                else:
                    out.append((at, at + n))
                at += n
    return out


def _above(value: Column, cuts: list) -> Column:
    """How many of the ascending ``cuts`` are greater; a row is compared with about two square roots of them."""
    if not cuts:
        return F.lit(0)
    size = math.isqrt(len(cuts)) + 1
    blocks = [cuts[k : k + size] for k in range(0, len(cuts), size)]
    begun = F.size(F.filter(F.lit([b[0] for b in blocks]), lambda c: c <= value))  # blocks that begin at or below it
    table = F.array(*[F.lit(b) for b in blocks])
    inner = F.size(F.filter(F.get(table, begun - 1), lambda c: c > value))
    return F.lit(len(cuts)) - F.least(begun * size, F.lit(len(cuts))) + F.when(begun > 0, inner).otherwise(0)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (range, last, id, text) sorted so that each row's next document follows it.

    Ids are dealt out to ranges by quantiles; the first row of a range is sent to the range before as well, with
    ``last`` = 1. Order: id descending (null last), then hash of the text descending. Rows of one id share a range.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, parts * RANGES_PER_PARTITION)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"),
    )
    # the ends of the ranges come from a draw of ids of fixed size, as a sort would take them; any type of id will do
    drawn = rows.select("id").filter("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(n * DRAWN).collect()
    some = sorted(r["id"] for r in drawn)
    cuts = sorted({some[k] for k in range(0, len(some), max(1, len(some) // n))})
    rows = rows.withColumn("range", F.when(F.col("id").isNull(), len(cuts)).otherwise(_above(F.col("id"), cuts)).cast("int"))
    # one row for each range: at most n + 1
    heads = [(r["range"], r["m"]["id"], r["m"]["h"]) for r in rows.groupBy("range").agg(F.max(F.struct("id", "h")).alias("m")).collect()]
    heads.sort()
    before = {r[0]: heads[k - 1][0] for k, r in enumerate(heads)}
    kind = docs.schema[id_col].dataType.simpleString()
    sent = spark.createDataFrame([(i, h, before[r]) for r, i, h in heads], f"head_id {kind}, head_h long, to int")
    own = F.struct(F.col("range"), F.lit(0).alias("last"))
    extra = F.struct(F.col("to").alias("range"), F.lit(1).alias("last"))
    joined = rows.join(F.broadcast(sent), (F.col("h") == F.col("head_h")) & F.col("id").eqNullSafe(F.col("head_id")), "left")
    return (
        joined.select("id", "text", "h", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, extra))).alias("x"))
        .select("x.range", "x.last", "id", "h", "text")
        .repartition(parts, "range")
        .sortWithinPartitions("range", "last", F.desc_nulls_last("id"), F.desc("h"))
    )


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every document and of its edited text.

    The edited text has the last floor(n / 2) code points replaced by the first as many (or all) of the next
    document in descending order of ids; after the last comes the first. Returns id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    Null text counts as empty; a null id comes after all others; rows of equal id are ordered by a hash of their
    text, and repeated rows follow each other; a single row is its own next; an empty table gives no rows; other
    columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (id, text, tree) that waits for its next
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            ids, texts, lasts = (batch.column(i).to_pylist() for i in (2, 4, 1))
            for i, text, last in zip(ids, texts, lasts, strict=True):
                own = tree(text)
                if held is not None:
                    half = len(held[1]) // 2
                    edited = held[1][: len(held[1]) - half] + text[:half]
                    other = tree(edited)
                    row = (
                        held[0], len(held[1]), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                        write(*held[2]), write(*other), likeness(held[2], other), likeness(held[2], own),
                    )
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                held = None if last else (i, text, own)
            kinds = (batch.schema.field(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=list(NAMES))

    schema = (
        f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return with_next(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


NAMES = ("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
