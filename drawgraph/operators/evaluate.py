"""Evaluation of answers and runs, and comparisons of lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawgraph.functions.scalars import verdict_band


def pair_labels(images: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(image, label, state) of the full join of two lists of stems."""
    a, b = images.select(F.col(key).alias("image")), labels.select(F.col(key).alias("label"))
    state = F.when(F.col("label").isNull(), "no label").when(F.col("image").isNull(), "no image").otherwise("paired")
    return a.join(b, F.col("image") == F.col("label"), "full_outer").withColumn("state", state)


def compare_runs(baseline: DataFrame, current: DataFrame, step: int = 5) -> DataFrame:
    """(id, baseline, current, delta, arrow) of two runs' scores."""
    joined = baseline.select("id", F.col("score").alias("baseline")).join(current.select("id", F.col("score").alias("current")), "id")
    delta = F.col("current") - F.col("baseline")
    return joined.withColumn("delta", delta).withColumn("arrow", F.when(delta > step, "up").when(delta < -step, "down").otherwise("same"))


def validate_summaries(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """Whether each document's stored summary (preview, size) still fits, and its size now."""
    old = stored.select("doc_id", F.col("preview").alias("_preview"), F.col("size").alias("_size"))
    size = F.length("text").cast("long")
    ok = F.col("_preview").isNotNull() & F.col("_size").isNotNull() & (F.col("_size") == size)
    return docs.join(old, "doc_id", "left").select("doc_id", "text", F.coalesce(ok, F.lit(False)).alias("cached"), size.alias("size"))


def expected_vs_actual(drawings: DataFrame, files: DataFrame, rows: int, cols: int, passes: int) -> DataFrame:
    """(pid, row, col, pass, state) of the expected grid: 'missing' without a file, 'retry' where its parsing failed, 'final' where it failed again.

    ``files`` has (pid, row, col, pass) and may have parse_error and retried; of several files of one place the worst
    tells. The grid of each drawing is a fixed small list.
    """
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False)) if c in files.columns else F.lit(False)
    place = ["pid", "row", "col", "pass"]
    held = files.groupBy(*place).agg(F.count("*").alias("_n"), flag("parse_error").alias("_bad"), flag("retried").alias("_again"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(rows * cols * passes - 1)).cast("array<bigint>"))
    whole = drawings.select("pid", grid.alias("k")).select(
        "pid", (1 + F.floor(F.col("k") / (cols * passes))).alias("row"), (1 + F.floor(F.col("k") / passes) % cols).alias("col"), (1 + F.col("k") % passes).alias("pass")
    )
    state = F.when(F.col("_n").isNull(), "missing").when(F.col("_bad") & F.col("_again"), "final").when(F.col("_bad"), "retry")
    return whole.join(held, place, "left").select(*place, state.alias("state")).filter("state is not null")


def filter_questions(questions: DataFrame, ids: list[str]) -> DataFrame:
    return questions.filter(F.upper("id").isin(*[i.upper() for i in ids]))


def catalog_files(rows: DataFrame, found: dict[str, DataFrame], key: str) -> DataFrame:
    """A flag for each list of existing files."""
    for name, files in found.items():
        flag = files.select(key).distinct().withColumn(name, F.lit(True))
        rows = rows.join(flag, key, "left").na.fill({name: False})
    return rows


def benchmark_report(results: DataFrame) -> DataFrame:
    """(verdict, n, score, seconds): answers, average score and time of each verdict, and of all under 'all'."""
    sums = results.withColumn("verdict", verdict_band(F.col("score"))).rollup("verdict").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("score"), F.sum("seconds").alias("seconds"), F.grouping("verdict").alias("_g")
    )
    return sums.select(F.when(F.col("_g") == 1, "all").otherwise(F.col("verdict")).alias("verdict"), "n", "score", "seconds")


def keyword_gate(rows: DataFrame, answer: str) -> DataFrame:
    """``gaps``: terms of ``must`` that the answer lacks; ``hallucinated``: terms of ``must_not`` that it has; any case."""
    has = lambda t: F.contains(F.lower(F.coalesce(F.col(answer), F.lit(""))), F.lower(t))
    return rows.withColumn("gaps", F.filter("must", lambda t: ~has(t))).withColumn("hallucinated", F.filter("must_not", has))


def source_attribution(calls: DataFrame, answer: str, tool: str) -> DataFrame:
    return calls.groupBy(answer).agg(F.sort_array(F.collect_set(tool)).alias("tools"), F.count("*").alias("calls"))


def chat_history(turns: DataFrame) -> DataFrame:
    """For each turn the turns before it in order, ``role:text`` joined by '|'. A conversation is one bounded group."""
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    said = F.collect_list(F.concat_ws(":", "role", "text")).over(before)
    return turns.withColumn("history", F.array_join(said, "|"))


def usage_totals(calls: DataFrame, rates: tuple[float, float], cached_share: float = 0.9) -> DataFrame:
    """(pid, calls, tokens_in, tokens_out, cache_read, cost, saved) of the calls (pid, tokens_in, tokens_out, cache_read).

    ``rates`` are the prices of a million tokens in and out; what is read from a cache saves ``cached_share`` of its price.
    """
    sums = calls.groupBy("pid").agg(F.count("*").alias("calls"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens_in", "tokens_out", "cache_read")])
    cost = (F.col("tokens_in") * rates[0] + F.col("tokens_out") * rates[1]) / 1e6
    return sums.withColumns({"cost": F.round(cost, 9), "saved": F.round(F.col("cache_read") * cached_share * rates[0] / 1e6, 9)})


def step_costs(extract: DataFrame, schema: DataFrame) -> DataFrame:
    """(pid, extract_cost, schema_cost, total) of the totals of two steps; a drawing may lack either."""
    a, b = extract.select("pid", F.col("cost").alias("extract_cost")), schema.select("pid", F.col("cost").alias("schema_cost"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return a.join(b, "pid", "full_outer").withColumn("total", F.round(zero("extract_cost") + zero("schema_cost"), 9))


def running_usage(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(value).over(w))


def truncate_lists(rows: DataFrame, column: str, most_chars: int, n: int) -> DataFrame:
    """``short``: the first ``n`` items where the written list is longer than ``most_chars``, else all."""
    written = F.length(F.array_join(F.col(column).cast("array<string>"), ","))
    return rows.withColumn("short", F.when(written > most_chars, F.slice(column, 1, n)).otherwise(F.col(column)))
