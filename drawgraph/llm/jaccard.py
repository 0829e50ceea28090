"""Exact n-gram Jaccard join: segments of a partitioned universe, one-deletion neighbourhoods, verification.

Two sets of sizes a and b with similarity of at least p % differ in at most (a + b)(100 - p) / (100 + p) shingles.
Sizes are dealt into bands. In a band whose sets and partners differ in at most H shingles, the hashes are split into
m > H ranges, so that any partner agrees on whole segments: with an allowance of 0, 1 or 2 for each segment (skip it;
demand it equal; allow one shingle more or less) whose sum exceeds H, at least one segment keeps its allowance. Every
set is indexed by its segments, and by the one-deletion neighbours of the first few. A set that looks for partners
skips the segments that cost most (those with frequent shingles only, or none), and pays with neighbourhoods.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawgraph.llm.common import bit_table, cut, has_bit
from drawgraph.llm.components import connected
from drawgraph.llm.shingles import mix, shingle_sets, slices

#: Ratio of the ends of a band of sizes.
BAND = 1.5
#: One in so many segments of a band has its one-deletion neighbours indexed.
RESERVE = 32
#: Slots of the table of frequent shingles; its size does not depend on the input.
SKETCH_BITS = 18
#: A task reports the slots in which it counted at least so many documents.
REPORTED = 16
#: Bits of the filter of sets that take part in a pair; a full filter lets more through, nothing is lost.
FILTER_BITS = 26
#: Leaders that each row of a shared key is compared with before components are known; each key draws its own.
LEADERS = 2
#: Words of 64 parity bits that a join can compare.
QUAD = 4
#: Leading segments of a band by which a pair is told to have met already; later ones only repeat what these find.
AHEAD = 6
#: Bits that a key does without: 48 are left, which meet by chance too seldom to cost and make rows smaller on disk.
SPARED = np.uint64(16)
# roles of a row; above them it carries its band and its segment (``BEYOND`` for one-deletion neighbours)
INDEX, INDEX_LESS, PROBE, PROBE_WIDE, PROBE_LESS = 1, 2, 4, 8, 16
BAND_SHIFT, SEGMENT_SHIFT, BEYOND = 5, 11, (1 << 20) - 1
_A, _B, _C = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def bands(percent: int, limit: int) -> list[tuple[int, int, int]]:
    """(lowest size, highest size, most shingles in which a set and a partner within the band differ)."""
    out, low = [], 1
    while low <= limit:
        high = max(low, int(low * BAND))
        out.append((low, high, 2 * high * (100 - percent) // (100 + percent)))
        low = high + 1
    return out


class Signatures:
    """Signature rows of sets, for one similarity."""

    def __init__(self, percent: int, sketch: np.ndarray | None) -> None:
        self.percent = percent
        self.sketch = sketch  # documents by slot, 0 where few
        self.bands: list[tuple[int, int, int]] = []

    def band_of(self, size: int) -> int:
        while not self.bands or self.bands[-1][1] < size:
            self.bands = bands(self.percent, max(64, 2 * size))
        lows = [b[0] for b in self.bands]
        return int(np.searchsorted(lows, size, side="right")) - 1

    def rows(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and roles (with band and segment) of a sorted set."""
        size = len(s)
        own = self.band_of(size)
        largest = size * 100 // self.percent
        last = self.band_of(largest)
        weight = mix(s ^ _A)
        keys, roles = [], []
        for b in range(own, last + 1):
            low, high, most = self.bands[b]
            if most == 0:
                continue  # only equal sets can be partners, and those are one class already
            differ = (size + min(high, largest)) * (100 - self.percent) // (100 + self.percent)
            k, r = self.in_band(s, weight, b, most + 1, differ, b == own)
            keys.append(k)
            roles.append(r)
        if not keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int32)
        return np.concatenate(keys), np.concatenate(roles)

    def in_band(
        self, s: np.ndarray, weight: np.ndarray, band: int, m: int, differ: int, own: bool
    ) -> tuple[np.ndarray, np.ndarray]:
        where = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # ranges of the hash: sorted
        first = np.searchsorted(where, np.arange(m + 1, dtype=np.uint64))
        held = np.diff(first)
        sums = np.zeros(len(s) + 1, np.uint64)
        np.cumsum(weight, out=sums[1:])
        total = sums[first[1:]] - sums[first[:-1]]
        base = mix(np.arange(m, dtype=np.uint64) * _B + np.uint64(band + 1) * _C)
        keys = mix(total + base) >> SPARED
        reserve = -(-m // RESERVE)
        # cost: the rarest shingle bounds the list; an empty segment is held by any set
        cost = np.where(held == 0, np.inf, 1.0 / np.maximum(held, 1))
        rare = held
        if self.sketch is not None:
            often = self.sketch[(s & np.uint64(len(self.sketch) - 1)).astype(np.int64)]
            seen = np.zeros(len(s) + 1, np.int64)
            np.cumsum(often == 0, out=seen[1:])
            rare = seen[first[1:]] - seen[first[:-1]]
            if (rare < held).any():
                least = np.minimum.reduceat(np.append(often, 0), np.minimum(first[:-1], len(s)))
                cost = np.where((held > 0) & (rare == 0), 1.0 + least, cost)
        allowed = np.ones(m, np.uint8)
        skip = m - (differ + 1)
        order = np.argsort(-cost, kind="stable")
        allowed[order[:skip]] = 0
        wanted = [i for i in order[skip:].tolist() if cost[i] > 1.0]
        wide: list[int] = []
        if wanted:
            wide = [i for i in range(reserve) if allowed[i] == 1 and rare[i] >= 2 and cost[i] <= 1.0]
            n = min(len(wide), len(wanted))
            wide = wide[:n]
            allowed[wanted[:n]] = 0
            allowed[wide] = 2
        role = np.where(allowed > 0, PROBE, 0).astype(np.uint8) | np.where(allowed == 2, PROBE_WIDE, 0).astype(np.uint8)
        if own:
            role |= INDEX
        use = role > 0
        mark = np.int32(band << BAND_SHIFT)
        at = np.minimum(np.arange(m, dtype=np.int32), BEYOND - 1)
        out_keys, out_roles = [keys[use]], [role[use] | mark | (at[use] << SEGMENT_SHIFT)]
        less = [(range(reserve), INDEX_LESS)] if own else []
        less += [(wide, PROBE_LESS)] if wide else []
        for segments, kind in less:
            which = np.isin(where, np.fromiter(segments, np.uint64))
            at = where[which].astype(np.int64)
            out_keys.append(mix(total[at] - weight[which] + base[at]) >> SPARED)
            out_roles.append(np.full(len(at), kind | mark | (BEYOND << SEGMENT_SHIFT), np.int32))
        return np.concatenate(out_keys), np.concatenate(out_roles)


def _identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed numbers."""
    with np.errstate(over="ignore"):
        a, b = mix(s ^ _B).sum(dtype=np.uint64), mix(s ^ _C).sum(dtype=np.uint64)
        return tuple(int(x) for x in mix(np.array([a + np.uint64(len(s)), b], np.uint64)).view(np.int64))


def parity(s: np.ndarray, size: int = 0) -> bytes:
    """Parity bits of a set: ``size``, or half as many as it has shingles (a power of two, 64 at least)."""
    size = size or max(64, 1 << (len(s) // 2).bit_length())
    ones = np.bincount((mix(s ^ _A) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(ones.astype(bool), bitorder="little").tobytes()


def parity_gap(a: bytes, b: bytes) -> int:
    """Bits in which two sets' parities differ, the longer one folded; never more than shingles in which they differ."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())


def _sets_of(batch: pa.RecordBatch, column: int, words: int) -> Iterator[np.ndarray]:
    texts = batch.column(column).cast(pa.binary()).to_pylist()
    with np.errstate(over="ignore"):
        for some in slices(texts):
            yield from shingle_sets(some, words)


NAMES = ["id", "h", "n", "a", "b", "bits", "quad", "slot", "count"]


def summaries(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Rows (id, h, n, a, b, bits, quad) of all documents, and rows (slot, count) of frequent shingles of each task."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(1 << SKETCH_BITS, np.int64)
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            n, a, b, bits, quad = [], [], [], [], []
            for s in _sets_of(batch, 2, words):
                x, y = _identity(s)
                bits.append(parity(s))
                quad.append(np.frombuffer(parity(s, 64 * QUAD), np.int64))
                n.append(len(s))
                a.append(x)
                b.append(y)
                slots[np.unique(s & np.uint64(len(slots) - 1)).astype(np.int64)] += 1
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bits, pa.binary()), pa.array(quad, pa.list_(pa.int64())), none, none],
                names=NAMES,
            )
        if id_type is not None:
            high = np.flatnonzero(slots >= REPORTED)
            none = pa.nulls(len(high), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(high), id_type), none, none, none, none, pa.nulls(len(high), pa.binary()), pa.nulls(len(high), pa.list_(pa.int64())), pa.array(high, pa.int64()), pa.array(slots[high], pa.int64())],
                names=NAMES,
            )

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), text.alias("text")).mapInArrow(
        run, f"id {kind}, h long, n long, a long, b long, bits binary, quad array<bigint>, slot long, count long"
    )


def _sketch(found: DataFrame) -> np.ndarray | None:
    """Frequent slots with their documents: at most 2 ** SKETCH_BITS rows."""
    slots = found.filter("slot is not null").groupBy("slot").agg(F.sum("count").alias("c")).collect()
    if not slots:
        return None
    n = found.filter("slot is null").count()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    out[[r["slot"] for r in slots]] = [r["c"] for r in slots]
    # what chance puts into a slot doesn't make its shingles frequent
    typical = np.median(out[out > 0]) if len(slots) > len(out) // 2 else 0
    out[out < max(REPORTED * 2, n // 2000, 4 * typical)] = 0
    return out


def signatures(docs: DataFrame, text_col: str, words: int, percent: int, sketch: np.ndarray | None) -> DataFrame:
    """Rows (key, node, role); equal sets of one task give theirs once."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # 2 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Signatures(percent, shared.value)
        for batch in batches:
            done: set[int] = set()
            parts: list[tuple[np.ndarray, np.ndarray, int]] = []
            held = 0

            def flush(parts: list) -> pa.RecordBatch:
                lengths = [len(p[0]) for p in parts]
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([p[0] for p in parts]).view(np.int64)),
                        pa.array(np.repeat(np.array([p[2] for p in parts], np.int64), lengths)),
                        pa.array(np.concatenate([p[1] for p in parts]).astype(np.int32)),
                    ],
                    names=["key", "node", "role"],
                )

            with np.errstate(over="ignore"):
                for s in _sets_of(batch, 0, words):
                    node = _identity(s)[0]
                    if len(s) == 0 or node in done:
                        continue
                    done.add(node)
                    keys, roles = maker.rows(s)
                    parts.append((keys, roles, node))
                    held += len(keys)
                    if held > 200_000:
                        yield flush(parts)
                        parts, held = [], 0
            if parts:
                yield flush(parts)

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "key long, node long, role int")


def filter_bits(keys: DataFrame) -> np.ndarray:
    """Bitmap of the numbers in column ``h``: at most 2 ** FILTER_BITS bits reach the driver, as words of 64."""
    slot = F.pmod(F.xxhash64("h"), F.lit(1 << FILTER_BITS))
    words = (
        keys.select(F.shiftright(slot, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(pmod(xxhash64(h), 64) as int))").alias("bit"))
        .groupBy("w")
        .agg(F.bit_or("bit").alias("bits"))
        .toPandas()
    )
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy()
    return out


def sets(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Rows (node, b, n, items) of the documents (id, h) in ``keys``, and perhaps of a few others."""
    number = F.xxhash64("h", "id").alias("h")
    bits = docs.sparkSession.sparkContext.broadcast(filter_bits(keys.select(number)))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text")).select(number, "text")
    rows = rows.select(
        F.shiftright(F.pmod(F.xxhash64("h"), F.lit(1 << FILTER_BITS)), 6).cast("int").alias("w"),
        F.pmod(F.xxhash64("h"), F.lit(64)).cast("int").alias("bit"),
        "text",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            w, bit = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            batch = batch.filter(pa.array((table[w] >> bit) & 1 == 1))
            node, b, n, items = [], [], [], []
            for s in _sets_of(batch, 2, words):
                key = _identity(s)
                node.append(key[0])
                b.append(key[1])
                n.append(len(s))
                items.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(items, pa.list_(pa.int64()))],
                names=["node", "b", "n", "items"],
            )

    return rows.mapInArrow(run, "node long, b long, n long, items array<bigint>")


def _plausible(pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """The pairs (p, q) whose sizes and parity bits don't rule the similarity out; none that reaches it is lost."""
    one = groups.select(F.col("node").alias("p"), F.col("n").alias("np"), F.col("bits").alias("bp"))
    two = groups.select(F.col("node").alias("q"), F.col("n").alias("nq"), F.col("bits").alias("bq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most, bp, bq = (batch.column(i).to_pylist() for i in (2, 3, 4))
            ok = [parity_gap(x, y) <= m for m, x, y in zip(most, bp, bq, strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_())).select([0, 1])

    sized = 100 * F.least("np", "nq") >= percent * F.greatest("np", "nq")
    most = F.floor((F.col("np") + F.col("nq")) * (100 - percent) / (100 + percent)).cast("long")
    return pairs.join(one, "p").join(two, "q").filter(sized).select("p", "q", most.alias("most"), "bp", "bq").mapInArrow(run, "p long, q long")


def _verified(docs: DataFrame, pairs: DataFrame, groups: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """Links (x, y), structs of 128 bits, of the candidate pairs (p, q) that reach the similarity."""
    pairs = cut(_plausible(pairs, groups, percent).distinct())
    ends = pairs.select(F.col("p").alias("node")).unionByName(pairs.select(F.col("q").alias("node"))).distinct()
    table = cut(sets(docs, groups.join(ends, "node", "left_semi").select("rep.id", "rep.h"), id_col, text_col, words))
    one = table.select(F.col("node").alias("q"), F.struct("node", "b").alias("y"), F.col("n").alias("ny"), F.col("items").alias("iy"))
    two = table.select(F.col("node").alias("p"), F.struct("node", "b").alias("x"), F.col("n").alias("nx"), F.col("items").alias("ix"))
    same = F.size(F.array_intersect("ix", "iy"))
    return (
        pairs.join(one, "q")
        .join(two, "p")
        .filter(100 * same >= percent * (F.col("nx") + F.col("ny") - same))
        .select("x", "y")
        .distinct()
    )


def _compatible(probe: Column, index: Column) -> Column:
    """Whether a probing role and an indexed role of one key may meet."""
    whole = index.bitwiseAND(F.lit(INDEX)) > 0
    less = index.bitwiseAND(F.lit(INDEX_LESS)) > 0
    return (whole & (probe.bitwiseAND(F.lit(PROBE | PROBE_LESS)) > 0)) | (less & (probe.bitwiseAND(F.lit(PROBE_WIDE)) > 0))


def _with_ahead(rows: DataFrame) -> DataFrame:
    """``rows`` with ``probed`` and ``indexed``: the node's whole keys among the leading segments before the row's own.

    A pair meets under each segment in which it agrees. Where a leading segment before this one has let it meet
    already (a probed key of one is an indexed key of the other), it need not meet here again; a pair's first meeting
    is never left out, so no pair is lost and near copies aren't joined once for each segment they share.
    """
    band = F.shiftright("role", BAND_SHIFT).bitwiseAND(F.lit((1 << (SEGMENT_SHIFT - BAND_SHIFT)) - 1))
    rows = rows.withColumn("band", band).withColumn("segment", F.shiftright("role", SEGMENT_SHIFT))
    leading = F.struct("segment", "key")
    has = lambda role: F.col("role").bitwiseAND(F.lit(role)) > 0
    ahead = (
        rows.filter(F.col("segment") < AHEAD)
        .groupBy("node", "band")
        .agg(F.collect_list(F.when(has(PROBE), leading)).alias("probes"), F.collect_list(F.when(has(INDEX), leading)).alias("indexes"))
    )
    before = lambda name: F.transform(F.filter(name, lambda x: x["segment"] < F.col("segment")), lambda x: x["key"])
    none = F.array().cast("array<bigint>")
    return rows.join(ahead, ["node", "band"], "left").select(
        *[c for c in rows.columns if c not in ("band", "segment")],
        F.coalesce(before("probes"), none).alias("probed"),
        F.coalesce(before("indexes"), none).alias("indexed"),
    )


def classes(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, h (hash of its text), n (size of its set), component (smallest id reachable) and label.

    ``label`` names the component whatever its ids are, and is null for documents without words.

    A document's set holds its distinct shingles of ``words`` words (A-Z lower-cased, cut at ASCII blanks); two
    documents link when 100 * intersection >= ``percent`` * union, and links are followed transitively.

    Equal sets form one class first. Signature keys that two classes share give candidate pairs: each class with
    leaders that its key draws, which is linear in the size of a hot key, then, once these links are followed, all
    pairs of a key whose components still differ and which sizes, roles and parity bits leave possible. Every candidate
    is verified on whole sets.

    Null, empty and blank texts link with nothing and are their own component; null ids are no component's name unless
    all of its ids are null; repeated rows are equal texts; an empty table gives no rows; other columns are not read.
    """
    found = cut(summaries(docs, id_col, text_col, words))
    slim = found.filter("slot is null").select("id", "h", "n", "a", "b", "bits", "quad")
    groups = cut(
        slim.filter("n > 0")
        .groupBy(F.col("a").alias("node"), "b")
        .agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("quad").alias("quad"), F.min(F.struct("id", "h")).alias("rep"), F.min("id").alias("id"))
    )
    rows = signatures(docs, text_col, words, percent, _sketch(found))
    key_ = "partition by key"
    probing = f"(role & {PROBE | PROBE_LESS}) > 0"
    leaders = [
        f"min(case when {probing} then struct(xxhash64(node, key, {k}) as o, node as v) end) over ({key_}).v as l{k}"
        for k in range(LEADERS)
    ]
    shared = cut(
        rows.repartition("key")  # first, or what the window reads would be shuffled with the rows
        .selectExpr("*", f"min(node) over ({key_}) as low", f"max(node) over ({key_}) as high", *leaders)
        .filter("low < high and l0 is not null")
        .drop("low", "high")
    )
    stars = (
        shared.select("node", F.explode(F.array_distinct(F.array(*[f"l{k}" for k in range(LEADERS)]))).alias("leader"))
        .filter("node <> leader")
        .select(F.least("node", "leader").alias("p"), F.greatest("node", "leader").alias("q"))
        .distinct()
    )
    links = cut(_verified(docs, stars, groups, id_col, text_col, words, percent))
    label = connected(links)
    # pairs of a key that may be partners and are not connected yet
    named = groups.select("node", "n", "quad", F.struct("node", "b").alias("x")).join(label, "x", "left")
    named = named.select("node", "n", F.coalesce("label", "x").alias("label"), *[F.get("quad", F.lit(k)).alias(f"q{k}") for k in range(QUAD)])
    mixed = (
        shared.select("key", "node", "role")
        .distinct()
        .join(named, "node")
        .selectExpr("*", f"min(label) over ({key_}) as low", f"max(label) over ({key_}) as high")
        .filter("low < high")
        .drop("low", "high")
    )
    mixed = _with_ahead(cut(mixed))
    names = ("node", "n", "role", "label", *(f"q{k}" for k in range(QUAD)))
    probe = mixed.filter(probing).select("key", "probed", *[F.col(c).alias(f"{c}_p") for c in names])
    gap = sum((F.bit_count(F.col(f"q{k}").bitwiseXOR(F.col(f"q{k}_p"))) for k in range(QUAD)), F.lit(0))
    rest = (
        probe.join(mixed.drop("probed"), "key")
        .filter(gap <= (F.col("n") + F.col("n_p")) * (100 - percent) / (100 + percent))
        .filter((F.col("label") != F.col("label_p")) & (F.col("node") != F.col("node_p")))
        .filter((F.col("n_p") <= F.col("n")) & (100 * F.col("n_p") >= percent * F.col("n")))
        .filter(_compatible(F.col("role_p"), F.col("role")))
        .filter(~F.arrays_overlap("probed", "indexed"))
        .select(F.least("node_p", "node").alias("p"), F.greatest("node_p", "node").alias("q"))
        .distinct()
        .join(stars, ["p", "q"], "left_anti")
    )
    more = cut(_verified(docs, rest, groups, id_col, text_col, words, percent))
    label = connected(links.unionByName(more))
    named = (
        groups.select(F.struct("node", "b").alias("x"), "id")
        .join(label, "x", "left")
        .select("x", F.coalesce("label", "x").alias("label"), "id")
    )
    lowest = named.groupBy("label").agg(F.min("id").alias("component"))
    of_group = named.join(lowest, "label").select(F.col("x.node").alias("a"), F.col("x.b").alias("b"), "component", "label")
    return slim.join(of_group, ["a", "b"], "left").select(
        F.col("id").alias(id_col), "h", "n", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component")).alias("component"), "label"
    )


def report(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_shingles, component_id."""
    found = classes(docs, words, percent, id_col, text_col)
    return found.select(id_col, F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def representatives(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component; the others go. Documents without words all stay.

    The row of the smallest id stays (null ids come last; of texts with one id, the one of the smallest hash; of
    repeated rows, any), so components of null ids and of repeated rows keep one row too, and a text whose id is also
    that of another text is judged by its own component.
    """
    found = classes(docs, words, percent, id_col, text_col).filter("n > 0").withColumnRenamed(id_col, "id")
    order = F.struct(F.col("id").isNull().alias("o"), "id", "h")
    rows = cut(found.groupBy("label", "id", "h").agg(F.count("*").alias("c")))
    best = rows.groupBy("label").agg(F.min(order).alias("best"))
    judged = rows.join(best, "label").select(
        F.col("id").alias("_dup_id"), F.col("h").alias("_dup_h"), (order == F.col("best")).alias("_dup_kept"), F.col("c").alias("_dup_c")
    )
    # rows without words, and those that are alone and stay, need no mark
    marked = cut(judged.filter("not _dup_kept or _dup_c > 1").select("_dup_id", "_dup_h", "_dup_kept"))
    h = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    # texts that nothing marks go on as they are; only the others are shuffled
    bits = bit_table(marked.select(F.xxhash64("_dup_h", "_dup_id").alias("h")))
    met = has_bit(bits.scalar(), F.xxhash64(h, F.col(id_col)))
    some = docs.filter(met)
    joined = some.join(marked, (h == F.col("_dup_h")) & F.col(id_col).eqNullSafe(F.col("_dup_id")), "left")
    kept = docs.filter(~met).unionByName(joined.filter("_dup_kept is null").select(*[some[c] for c in docs.columns]))
    if marked.filter("_dup_kept").isEmpty():
        return kept
    once = joined.filter("_dup_kept").dropDuplicates(["_dup_id", "_dup_h"]).select(*[some[c] for c in docs.columns])
    return kept.unionByName(once)
