"""Chunking, retrieval and packing of context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawgraph.operators.lineage import cut_lineage
from drawgraph.operators.ranks import ranked


def windows(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of windows of ``size``. One that ends inside the text is cut after the first character of its last
    blank line or sentence end, if that lies beyond half of it; the next window starts ``overlap`` before the cut."""
    n, at = len(text), 0
    while at < n:
        end = at + size
        mark = max(text.rfind(m, at, end) for m in ("\n\n", ". ")) if end < n else -1
        if mark - at > size // 2:
            end = mark + 1
        yield at, end
        at = end - overlap


def chunks_of(text: str, size: int = 1500, overlap: int = 200, least: int = 100) -> list[tuple[int, str]]:
    """(start, chunk) of each window, stripped; those of ``least`` characters or fewer are dropped."""
    stripped = ((a, text[a:b].strip()) for a, b in windows(text, size, overlap))
    return [(a, c) for a, c in stripped if len(c) > least]


def chunk_text(docs: DataFrame, size: int = 1500, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk_index, start, text): sequential in a document, parallel over documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, k, s, c) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for k, (s, c) in enumerate(chunks_of(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "start", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, chunk_index int, start int, text string")


def tag_chunks(docs: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """``pid_tags`` of each document by its source; sources without a mapping are global."""
    lists = mapping.groupBy(key).agg(F.sort_array(F.collect_set("pid")).alias("pid_tags"))
    return docs.join(lists, key, "left").withColumn("pid_tags", F.coalesce("pid_tags", F.array(F.lit("global"))))


def batch_rows(rows: DataFrame, by: str, order: str, n: int = 100) -> DataFrame:
    """``batch`` of ``n`` rows in order within each group, and the approximate tokens of each text."""
    placed = ranked(rows, [by], [F.col(order)])
    return placed.select(*rows.columns, F.floor((F.col("rank") - 1) / n).alias("batch"), F.floor(F.length("text") / 4).alias("tokens"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1.0)


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Middles of at most ``cells`` cells of unit vectors; any middles give exact results, near ones fewer comparisons."""
    x = _unit(np.unique(sample, axis=0))
    middle = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        at = (x @ middle.T).argmax(axis=1)
        sums = np.zeros_like(middle)
        np.add.at(sums, at, x)
        middle = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), middle)
    return middle


def vector_index(chunks: DataFrame, sample: int = 20_000, most_cells: int = 1024) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, embedding, tag, cell, far) of every vector and the middles of the cells.

    Cells are fitted on the ``sample`` vectors of the least hashes (bounded, whatever the table holds); every vector
    lies in the cell of the nearest middle, ``far`` being its distance as a unit vector.
    """
    some = chunks.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not some:
        return chunks.select("vec_id", "embedding", "tag", F.lit(0).alias("cell"), F.lit(0.0).alias("far")), np.zeros((0, 0))
    n = chunks.count()
    middle = fit_cells(np.array([r["embedding"] for r in some], np.float64), min(most_cells, max(1, int(n**0.5))))
    kinds = {c: chunks.schema[c].dataType.simpleString() for c in ("vec_id", "embedding", "tag")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1))
            cell = (x @ middle.T).argmax(axis=1) if batch.num_rows else np.zeros(0, np.int64)
            far = np.linalg.norm(x - middle[cell], axis=1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=[*kinds, "cell", "far"])

    schema = ", ".join(f"{c} {k}" for c, k in kinds.items())
    return cut_lineage(chunks.select(*kinds).mapInArrow(run, f"{schema}, cell int, far double")), middle


def rag_topk(chunks: DataFrame, queries: DataFrame, k: int = 5, epsilon: float = 1e-10) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``k`` most alike chunks of the query's drawing or of all drawings.

    ``chunks`` has (vec_id, embedding, tag), ``queries`` (query_id, embedding, pid). A query without a drawing is
    compared with all chunks' tags that are 'global'. Vectors are of one length, without nulls.

    Exact, by an index of cells: no vector of a cell is more alike to a query than the cell's middle plus the cell's
    radius. A query meets its best cells first, until they hold ``k`` chunks; then only the cells whose bound reaches
    its k-th score. The best of each task go into the shuffle, not all scores.
    """
    index, middle = vector_index(chunks)
    norm = lambda c: F.sqrt(_dot(F.col(c), F.col(c))) + epsilon
    c = index.select("vec_id", "tag", "cell", F.col("embedding").alias("_c"), norm("embedding").alias("_cn"))
    q = cut_lineage(queries.select("query_id", "pid", F.col("embedding").alias("_q"), norm("embedding").alias("_qn")))
    middles = q.sparkSession.sparkContext.broadcast(middle)  # at most most_cells vectors
    kinds = {x: q.schema[x].dataType.simpleString() for x in ("query_id", "pid")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1))
            alike = x @ middles.value.T if middles.value.size else np.zeros((batch.num_rows, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(list(alike), pa.list_(pa.float64()))], names=["query_id", "pid", "alike"])

    near = q.select("query_id", "pid", "_q").mapInArrow(run, ", ".join(f"{x} {t}" for x, t in kinds.items()) + ", alike array<double>")
    near = near.select("query_id", "alike", F.explode(F.array_compact(F.array_distinct(F.array("pid", F.lit("global"))))).alias("tag"))
    cells = index.groupBy("tag", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far"))
    bounds = near.join(cells, "tag").select("query_id", "tag", "cell", "n", (F.get("alike", F.col("cell")) + F.col("far") + 1e-9).alias("bound"))
    before = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "tag", "cell").rowsBetween(Window.unboundedPreceding, -1))
    bounds = cut_lineage(bounds.withColumn("first", F.coalesce(before, F.lit(0)) < k))

    def best(some: DataFrame) -> DataFrame:
        met = some.select("query_id", "tag", "cell").join(q.select("query_id", "_q", "_qn"), "query_id").join(c, ["tag", "cell"])
        return top(met.select("query_id", "vec_id", (_dot(F.col("_c"), F.col("_q")) / (F.col("_cn") * F.col("_qn"))).alias("score")))

    def top(scored: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return scored.withColumn("rank", rank).filter(F.col("rank") <= k)

    early = cut_lineage(best(bounds.filter("first")))
    least = early.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    late = bounds.filter("not first").join(least, "query_id", "left").filter(F.coalesce(F.col("bound") >= F.col("least"), F.lit(True)))
    return top(early.drop("rank").unionByName(best(late).drop("rank")))


def pack_context(chunks: DataFrame, by: str, order: str, most: int = 3000) -> DataFrame:
    """(by, context, n): ``[source]\\ntext`` entries in order while their sum is within ``most``; the first overflow ends it."""
    entry = F.concat(F.lit("["), F.regexp_replace("source", r"\.docx$", ""), F.lit("]\n"), F.coalesce("text", F.lit("")))
    sized = ranked(chunks.select(by, order, entry.alias("_e")), [by], [F.col(order)], {"_run": F.length("_e")}).filter(F.col("_run") <= most)
    lists = sized.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_e").alias("e")))).alias("_l"))
    return lists.select(by, F.array_join(F.transform("_l", lambda x: x["e"]), "\n\n").alias("context"), F.size("_l").cast("long").alias("n"))


def assemble_context(docs: DataFrame, requests: DataFrame, notes: DataFrame | None = None, most: int = 200_000) -> DataFrame:
    """(request, context): what a question is asked with.

    ``docs`` has (doc_id, source, text), ``requests`` (request, doc_id, question). A request with a document gets it
    under its name, or a line that it is unknown; one without (null) gets all documents, numbered in the order of ids
    and joined, as far as ``most`` characters (a model's window) reach, under their number. ``notes`` (request, k, text)
    follow in order, then the question.
    """
    text = F.coalesce("text", F.lit(""))
    numbered = ranked(docs.select("doc_id", F.lit(1).alias("_all"), F.concat(F.lit("source "), "source", F.lit("\n"), text, F.lit("\n\n")).alias("_e")), ["_all"], [F.col("doc_id")], {"_run": F.length("_e")}, totals=True)
    held = numbered.filter(F.col("_run") <= most).select("rank", "rows", F.concat(F.lit("# "), F.col("rank").cast("string"), F.lit(" "), "_e").alias("_e"))
    whole = held.agg(F.max("rows").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "_e"))), lambda x: x["_e"]), "").alias("t"))
    whole = whole.select(F.when(F.col("n").isNotNull(), F.concat(F.col("n").cast("string"), F.lit(" documents\n\n"), F.col("t"))).otherwise(F.lit("")).alias("_whole"))
    one = docs.select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n"), text, F.lit("\n\n")).alias("_one"))
    joined = requests.join(one, "doc_id", "left").join(F.broadcast(whole))  # one row of at most ``most`` characters
    body = F.when(F.col("doc_id").isNull(), F.col("_whole")).otherwise(F.coalesce("_one", F.concat(F.lit("No document "), F.col("doc_id").cast("string"), F.lit(".\n\n"))))
    after = F.lit("")
    if notes is not None:
        lists = notes.groupBy("request").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "\n").alias("_notes"))
        joined = joined.join(lists, "request", "left")
        after = F.coalesce(F.concat(F.lit("Notes:\n"), "_notes", F.lit("\n\n")), F.lit(""))
    return joined.select("request", F.concat(body, after, F.lit("Question: "), "question").alias("context"))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def assemble_documents(lines: DataFrame, by: str, order: str, rows: DataFrame | None = None) -> DataFrame:
    """(by, text): the non-blank paragraphs of each document in order, then its table rows, joined by blank lines.

    ``rows`` has (by, order, cells); a row is its non-blank cells with ' | ' between them, and none without.
    """
    kept = lines.select(by, F.lit(0).alias("_k"), F.col(order).alias("_o"), _stripped(F.col("text")).alias("_t"))
    if rows is not None:
        cells = F.filter(F.transform("cells", _stripped), lambda c: c.isNotNull() & (c != ""))
        kept = kept.unionByName(rows.select(by, F.lit(1).alias("_k"), F.col(order).alias("_o"), F.array_join(cells, " | ").alias("_t")))
    lists = kept.filter("_t <> ''").groupBy(by).agg(F.sort_array(F.collect_list(F.struct("_k", "_o", "_t"))).alias("_l"))
    return lists.select(by, F.array_join(F.transform("_l", lambda x: x["_t"]), "\n\n").alias("text"))
