"""Quality rules: repetition counts and a hashed n-gram likelihood ratio."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawgraph.llm.common import BLANKS, bit_table, cut, has_bit, let, words_of

#: Hash buckets of the two multinomials: one for so many bytes of text, between these powers of two. The larger one
#: bounds the table of weights that goes to the executors (8 bytes each).
BUCKET_BYTES, LEAST_BITS, MOST_BITS = 16384, 14, 20
#: Share of trusted documents that may score below the threshold.
TRUSTED_LOSS = 0.002
#: Width of the windows in which repeated words are found.
WINDOW = 8
#: Pseudo-count of each bucket.
ALPHA = 1.0


def _hashed(text_col: str) -> Column:
    """The hash of each word."""
    return F.transform(words_of(F.col(text_col)), lambda w: F.xxhash64(w))


def _grams(words: Column, buckets: int) -> Column:
    """The bucket of each 1-gram and 2-gram of an array of word hashes."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b))
    return F.transform(F.concat(words, pairs), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def bucket_count(docs: DataFrame, text_col: str = "text") -> int:
    """Buckets for a corpus: they grow with its bytes."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col))).alias("b")).first()["b"] or 0
    return 1 << min(MOST_BITS, max(LEAST_BITS, (size // BUCKET_BYTES).bit_length()))


def _with_ids(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_text`` of the documents whose id ``ids`` (_id) holds; a table of bits keeps the others out of the join."""
    bits = bit_table(ids.select(F.xxhash64("_id").alias("h")))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), bits.scalar().alias("_bits"))
    return rows.filter(has_bit(F.col("_bits"), F.xxhash64("_id"))).select("_id", "_text").join(ids, "_id", "left_semi").select("_text")


def fit_ratio(docs: DataFrame, trusted: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: ``weights``, the log ratio of each bucket, trusted target against the raw corpus.

    The raw counts cover every document, the target counts every document whose id ``trusted`` (_id) holds.
    """

    def counted(texts: DataFrame, name: str) -> DataFrame:
        grams = let(_hashed("_text"), lambda words: _grams(words, buckets))
        return texts.select(F.explode(grams).alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))

    raw = counted(docs.select(F.col(text_col).alias("_text")), "raw")
    counts = cut(raw.join(counted(_with_ids(docs, trusted, id_col, text_col), "target"), "bucket", "left"))
    spark = docs.sparkSession
    sums = counts.agg(F.sum("raw").alias("raw_all"), F.sum("target").alias("target_all"))
    whole = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    ratio = F.log((F.coalesce("target", F.lit(0)) + ALPHA) / (F.coalesce("target_all", F.lit(0)) + ALPHA * buckets)) - F.log(
        (F.coalesce("raw", F.lit(0)) + ALPHA) / (F.coalesce("raw_all", F.lit(0)) + ALPHA * buckets)
    )
    in_order = lambda key, value: F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda x: x[value])
    blocks = (
        whole.join(F.broadcast(sums))
        .select("bucket", F.shiftright("bucket", 10).alias("block"), ratio.alias("w"))
        .groupBy("block")
        .agg(in_order("bucket", "w").alias("ws"))
    )
    return blocks.agg(F.flatten(in_order("block", "ws")).alias("weights"))


def _score(words: Column, weights: Column, buckets: int) -> Column:
    """Mean log ratio of the grams; no words score 0."""

    def mean(grams: Column) -> Column:
        total = F.aggregate(grams, F.lit(0.0), lambda acc, b: acc + F.get(weights, b))
        return F.when(F.size(grams) > 0, total / F.size(grams)).otherwise(F.lit(0.0))

    return let(_grams(words, buckets), mean)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The ids that are labelled good and not toxic; nulls don't count."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col(id_col).isNotNull()
    return labels.filter(good).select(id_col).distinct()


def repeat_words(words: Column, size: int = WINDOW) -> Column:
    """Words inside windows of ``size`` whose hash occurs twice or more in an array of word hashes."""
    n = F.size(words)
    windows = F.when(
        n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    )

    def twice(ranked: Column) -> Column:
        same = lambda x, j: (x["h"] == F.get(ranked, j - 1)["h"]) | (x["h"] == F.get(ranked, j + 1)["h"])
        return F.sort_array(F.transform(F.filter(ranked, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(size), F.coalesce(F.get(at, k + 1) - p, F.lit(size))))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    def count(win: Column) -> Column:
        ranked = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = F.size(F.array_distinct(win)) < F.size(win)
        return F.when(repeated, let(let(ranked, twice), covered)).otherwise(F.lit(0))

    return F.coalesce(let(windows, count), F.lit(0))


def judge(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Score every document and decide which to keep.

    A document fails the base rules with under 20 words, or when over 30 % of its
    words lie in 8-word windows that repeat in it. Others are kept if the mean log
    ratio of their 1- and 2-grams reaches the threshold. Half of the trusted
    documents, by hash of their id, fit the target multinomial; the threshold is
    the exact ``TRUSTED_LOSS`` quantile of the other half's scores (minus infinity
    without any).

    Returns id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, score, then the columns named in ``keep``.

    Null, empty and blank texts have no words and fail; null ids are kept as rows;
    repeated rows get equal verdicts; an empty table gives no rows. 64-bit hashes
    stand for words and windows inside one document. The buckets of the n-grams grow with the corpus (``bucket_count``).
    """
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("_id")), F.lit(2))
    ids = cut(trusted.select(F.col(id_col).alias("_id")).distinct())
    buckets = bucket_count(docs, text_col)
    weights = cut(fit_ratio(docs, ids.filter(fold == 0), buckets, id_col, text_col))
    held_out = _with_ids(docs, ids.filter(fold == 1), id_col, text_col)
    scores = held_out.select(_hashed("_text").alias("_wh"), weights.scalar().alias("_w")).filter(F.size("_wh") > 0)
    bound = scores.select(_score(F.col("_wh"), F.col("_w"), buckets).alias("s")).agg(F.percentile("s", F.lit(TRUSTED_LOSS)).alias("t"))
    bound = bound.first()["t"]
    threshold = -math.inf if bound is None else bound

    text = F.col("_text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, BLANKS, "")) > 0)
    from_words = let(
        F.transform(words_of(text), lambda w: F.xxhash64(w)),
        lambda wh: F.struct(
            F.size(wh).cast("long").alias("n_words"),
            repeat_words(wh).cast("long").alias("n_repeat_words"),
            _score(wh, F.col("_w"), buckets).alias("score"),
        ),
    )
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        F.struct(*[F.col(c) for c in keep] or [F.lit(0)]).alias("_rest"),
        weights.scalar().alias("_w"),
    )
    measures = F.struct(
        F.length(F.regexp_replace(text, BLANKS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        from_words.alias("w"),
    )
    # a row of one for each document: filters on the verdict stay above it and don't compute the measures again
    rows = rows.select("_id", "_rest", F.explode(F.array(measures)).alias("_m")).select("_id", "_rest", "_m.*").select("*", "w.*")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.select(
        F.col("_id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("score") >= F.lit(threshold))).alias("kept"),
        "score",
        *[F.col("_rest")[c].alias(c) for c in keep if c != id_col],
    )
