"""URL filter: fixed host and path rules, and association rules mined from what they label."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawgraph.llm.common import cut

#: Host, path and verdict; the longest rule that fits wins.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Share of labelled urls that hold all tokens of a mined rule, and share of those with its verdict.
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.9
#: Labels, directories and query keys in a rule that FP-growth mines; rules of more are grown from there.
FIRST_FREE = 2
#: Tokens of a rule up to which all its subsets are listed.
LISTED = 10
#: Deviations by which a rule's confidence must exceed its verdict's share of all labelled urls (one side, 95 %).
DEVIATIONS = 1.645
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def fixed_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    """Distinct tokens of a url: scheme, host labels, host suffixes, directories, suffix of the file, query keys."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    named = lambda kind, values: F.transform(values, lambda v: F.concat(F.lit(kind + ":"), v))
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(3))), lambda n: F.array_join(F.slice(labels, -n, n), ".")
    )
    directories = F.filter(F.split(path, "/"), lambda d: d != "")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda q: F.split(q, "=", 2)[0]), lambda k: k != "")
    one = lambda kind, value: F.when(value != "", F.array(F.concat(F.lit(kind + ":"), value))).otherwise(
        F.array().cast("array<string>")
    )
    every = F.concat(
        one("scheme", F.regexp_extract(url, r"(?s)^([^:/?#]*)://", 1)),
        named("label", F.filter(labels, lambda v: v != "")),
        named("host", F.filter(suffixes, lambda v: v != "")),
        named("dir", directories),
        one("file", F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)),
        named("key", keys),
        one("mark", F.when(url.contains("#"), F.lit("fragment")).otherwise(F.lit(""))),
    )
    return F.array_distinct(F.coalesce(every, F.array().cast("array<string>")))


def _of_kinds(tokens: Column, *kinds: str) -> Column:
    return F.filter(tokens, lambda x: F.substring_index(x, ":", 1).isin(*kinds))


def _lower_bound(hits: Column, rows: Column) -> Column:
    """Wilson's lower bound of a share of ``hits`` in ``rows``."""
    p, z2 = hits / rows, DEVIATIONS**2
    return (p + z2 / (2 * rows) - DEVIATIONS * F.sqrt(p * (1 - p) / rows + z2 / (4 * rows * rows))) / (1 + z2 / rows)


def _subsets(tokens: Column, most: int) -> Column:
    """All subsets of at most ``most`` of the (distinct) tokens."""
    return F.aggregate(
        tokens,
        F.array(F.array().cast("array<string>")),
        lambda found, t: F.concat(found, F.transform(F.filter(found, lambda x: F.size(x) < most), lambda x: F.array_append(x, t))),
    )


def _grown(rows: DataFrame, shares: dict[str, int], least: float, min_confidence: float, most_free: int | None) -> DataFrame:
    """Rules (tokens, verdict, confidence, hits) of more than ``FIRST_FREE`` free tokens, over (verdict, tokens, free) rows.

    Pattern growth by projected tables: each set of tokens has the rows that hold it, with their later free tokens
    (``free`` has the rarest first). A set goes on only if its last token took away rows of another verdict and such rows
    are left, since otherwise a smaller set is as good, and if it would be a rule without those of these rows that hold
    all tokens by which it can still grow: these stay in whatever it grows to.
    """
    n = sum(shares.values())
    patterns = cut(rows.groupBy("verdict", F.array_sort("tokens").alias("tokens"), "free").agg(F.count("*").alias("w")))
    base = F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(v / n))])
    hosts = F.concat(F.array(F.array().cast("array<string>")), F.transform(_of_kinds(F.col("tokens"), "host"), lambda x: F.array(x)))
    held = patterns.select("verdict", "tokens", "free", "w", F.explode(_subsets(_of_kinds(F.col("tokens"), "scheme", "file", "mark"), 3)).alias("rest"))
    held = held.select("verdict", "free", "w", F.explode(F.transform(hosts, lambda h: F.concat("rest", h))).alias("set"))
    held = held.select("set", F.explode(F.array(*[F.lit(k) for k in shares])).alias("goal"), "w", (F.col("verdict") == F.col("goal")).alias("hit"), F.col("free").alias("tail"))
    pos, neg = (F.sum(F.when(F.col("hit") == side, F.col("w")).otherwise(0)) for side in (True, False))
    may_be = lambda hits, others: (hits / (hits + others) >= min_confidence) & (
        _lower_bound(hits, hits + others) > F.get(F.array(base[F.col("goal")]), F.lit(0))
    )
    some = held.groupBy("set", "goal").agg(pos.alias("pos"), neg.alias("others")).filter((F.col("pos") >= least) & (F.col("others") > 0))
    held = cut(held.join(some.drop("pos"), ["set", "goal"]).filter(F.size("tail") > 0))
    found, size = [], 0
    while not held.isEmpty() and (most_free is None or size < most_free):
        size += 1
        ways = (
            held.select("set", "goal", "w", "hit", "others", F.explode("tail").alias("x"))
            .groupBy("set", "goal", "others", "x")
            .agg(pos.alias("pos"), neg.alias("neg"))
            .filter((F.col("pos") >= least) & (F.col("neg") < F.col("others")))
        )
        ways = cut(ways)
        if size > FIRST_FREE:
            rule = ways.filter(may_be(F.col("pos"), F.col("neg")))
            found.append(
                rule.select(F.array_sort(F.array_append("set", F.col("x.t"))).alias("tokens"), F.col("goal").alias("verdict"),
                            (F.col("pos") / (F.col("pos") + F.col("neg"))).alias("confidence"), F.col("pos").cast("double").alias("hits"))
            )
        more = ways.filter("neg > 0").groupBy("set", "goal").agg(F.array_sort(F.collect_list("x")).alias("more"))
        nexts = (
            held.join(more, ["set", "goal"])
            .withColumn("tail", F.array_intersect("tail", "more"))
            .select("set", "goal", "w", "hit", "more", "tail", F.posexplode("tail").alias("at", "x"))
            .select(
                F.array_append("set", F.col("x.t")).alias("set"), "goal", "w", "hit",
                F.expr("slice(tail, at + 2, size(tail))").alias("tail"),
                (F.expr("size(tail) - at - 1") == F.size("more") - F.array_position("more", F.col("x"))).alias("full"),
            )
        )
        nexts = cut(nexts)
        stays = F.sum(F.when(~F.col("hit") & F.col("full"), F.col("w")).otherwise(0))
        alive = nexts.groupBy("set", "goal").agg(pos.alias("pos"), neg.alias("others"), stays.alias("stays"))
        alive = alive.filter(may_be(F.col("pos"), F.col("stays"))).select("set", "goal", "others")
        held = cut(nexts.filter(F.size("tail") > 0).drop("full").join(alive, ["set", "goal"]))
    empty = rows.sparkSession.createDataFrame([], "tokens array<string>, verdict string, confidence double, hits double")
    for more in found:
        empty = empty.unionByName(more)
    return empty


def mine(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, most_free: int | None = None
) -> DataFrame:
    """Rules (id, tokens, verdict, confidence, support) by FP-growth over (tokens, verdict) rows.

    A rule combines at most one host suffix (a suffix implies the shorter ones) and any number (or ``most_free``) of
    labels, directories and query keys with scheme, file suffix and mark. Tokens below ``min_support`` can be in no rule
    and are left out first. Then a url gives one transaction for each combination of a suffix and at most ``FIRST_FREE``
    free tokens, with one item that stands for it, so that urls of many common tokens don't span the lattice of all their
    subsets. Rules of more free tokens are grown set by set, see ``_grown``.

    A rule must have ``min_support`` of all labelled urls and ``min_confidence``, and be better than chance: Wilson's
    lower bound of its confidence lies above the share of its verdict. It is dropped if one with some of its tokens and
    the same verdict is as confident. The same holds for a table of any size; without labels there are no rules.
    """
    spark = labelled.sparkSession
    schema = "id long, tokens array<string>, verdict string, confidence double, support double"
    rows = cut(labelled.filter(F.col("verdict").isNotNull()).select("tokens", "verdict", F.monotonically_increasing_id().alias("n")))
    shares = {r["verdict"]: r["c"] for r in rows.groupBy("verdict").agg(F.count("*").alias("c")).collect()}  # one row a verdict
    n = sum(shares.values())
    if not n:
        return spark.createDataFrame([], schema)
    first = FIRST_FREE if most_free is None else min(FIRST_FREE, most_free)
    least = max(1.0, math.ceil(min_support * n - 1e-9))
    each = rows.select("n", F.explode("tokens").alias("t"))
    often = each.groupBy("t").agg(F.count("*").alias("c")).filter(F.col("c") >= least)
    held = each.join(often, "t").groupBy("n").agg(F.array_sort(F.collect_list(F.struct("c", "t"))).alias("often"))
    rows = rows.join(held, "n", "left").select("verdict", F.coalesce("often", F.array().cast("array<struct<c:bigint,t:string>>")).alias("often"))
    free = F.filter("often", lambda x: F.substring_index(x["t"], ":", 1).isin("label", "dir", "key"))
    rows = cut(rows.select("verdict", F.col("often.t").alias("tokens"), free.alias("free")))
    # a token holds no blank of this kind: hosts, paths and queries come apart at it
    join, none = "\u0000", F.array(F.lit(""))
    sets = rows.select(
        F.concat(_of_kinds(F.col("tokens"), "scheme", "file", "mark"), F.array(F.concat(F.lit("verdict:"), "verdict"))).alias("rest"),
        F.array_sort(_of_kinds(F.col("tokens"), "label", "dir", "key")).alias("free"),
        F.explode(F.concat(none, _of_kinds(F.col("tokens"), "host"))).alias("host"),
    )
    sets = sets.select("rest", "host", F.explode(_subsets(F.col("free"), first)).alias("free"))
    items = cut(sets.select(F.array_append("rest", F.concat(F.lit("set:"), F.array_join(F.concat(F.array("host"), "free"), join))).alias("items")))
    transactions = items.count()
    model = FPGrowth(itemsCol="items", minSupport=least / transactions, minConfidence=min_confidence).fit(items)
    some = F.get(F.filter("antecedent", lambda x: x.startswith("set:")), F.lit(0))
    rest = F.filter("antecedent", lambda x: ~x.startswith("set:"))
    hits, base = F.round(F.col("support") * transactions), F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(v / n))])
    rules = (
        model.associationRules.select(
            F.concat(rest, F.filter(F.split(F.substring(some, 5, 1 << 30), join), lambda x: x != "")).alias("tokens"),
            F.regexp_extract(F.col("consequent")[0], "(?s)^verdict:(.*)$", 1).alias("verdict"),
            "confidence",
            hits.alias("hits"),
        )
        .filter((F.col("verdict") != "") & F.col("tokens").isNotNull() & (F.size("tokens") > 0))
        .filter(_lower_bound(F.col("hits"), F.round(F.col("hits") / F.col("confidence"))) > F.get(F.array(base[F.col("verdict")]), F.lit(0)))
        .select(F.array_sort("tokens").alias("tokens"), "verdict", "confidence", "hits")
    )
    if most_free is None or most_free > FIRST_FREE:
        rules = rules.unionByName(_grown(rows, shares, least, min_confidence, most_free))
    rules = cut(rules.select(F.xxhash64("tokens", "verdict").alias("id"), "tokens", "verdict", "confidence", (F.col("hits") / n).alias("support")))
    # every smaller antecedent of a rule by its hash; those of long rules are found by their first tokens
    smaller = rules.filter(F.size("tokens") <= LISTED).select(
        "id", "verdict", "confidence", F.size("tokens").alias("size"), F.explode(_subsets(F.col("tokens"), LISTED)).alias("part")
    )
    known = rules.select(F.col("id").alias("part_id"), F.col("confidence").alias("part_confidence"))
    worse = (
        smaller.filter(F.size("part").between(1, F.col("size") - 1))
        .select("id", "confidence", F.xxhash64("part", "verdict").alias("part_id"))
        .join(known, "part_id")
        .filter(F.col("part_confidence") >= F.col("confidence"))
        .select("id")
    )
    long = rules.filter(F.size("tokens") > LISTED).select("*", F.explode("tokens").alias("t"))
    under = rules.select(F.col("tokens")[0].alias("t"), "verdict", F.col("tokens").alias("part"), F.col("confidence").alias("part_confidence"))
    inside = (F.size("part") < F.size("tokens")) & (F.col("part_confidence") >= F.col("confidence"))
    held = long.join(under, ["t", "verdict"]).filter(inside & (F.size(F.array_except("part", "tokens")) == 0))
    worse = worse.unionByName(held.select("id")).distinct()
    return rules.join(worse, "id", "left_anti")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, verdict) of each url that a rule fits; ``urls`` has distinct rows (url, tokens).

    The index lists each rule under its rarest token (by support of the rules that hold it, then by name); a url meets
    the rules under its own tokens, and those whose other tokens it holds as well fit. The most confident one decides,
    then the better supported, then 'block'.
    """
    weight = rules.select(F.explode("tokens").alias("t"), "support").groupBy("t").agg(F.sum("support").alias("s"))
    index = (
        rules.select("id", F.explode("tokens").alias("t"))
        .join(weight, "t")
        .groupBy("id")
        .agg(F.min_by("t", F.struct("s", "t")).alias("t"))
        .join(rules, "id")
        .select("t", F.col("tokens").alias("needed"), "verdict", "confidence", "support")
    )
    return (
        urls.select("url", "tokens", F.explode("tokens").alias("t"))
        .join(index, "t")
        .filter(F.size(F.array_except("needed", "tokens")) == 0)
        .groupBy("url")
        .agg(F.max_by("verdict", F.struct("confidence", "support", "verdict")).alias("mined"))
    )


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, default: str = "allow") -> DataFrame:
    """Host, path, fixed rule and verdict of every page.

    Pages that a fixed rule fits take its verdict and are the labels from which rules are mined; the mined rules
    judge the others, and ``default`` holds where none fits. Returns id, host, path, rule, verdict, by ('rule',
    'mined' or 'default').

    A null url, or one without '://', has empty host and path and takes what its tokens or the default give; null ids
    and repeated rows are kept; an empty table gives no rows; other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    fixed = rows.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    mined_rules = cut(mine(fixed.select(tokens(F.col("url")).alias("tokens"), F.col("fixed.verdict").alias("verdict"))))
    open_urls = fixed.filter("fixed is null and url is not null").select("url").distinct()
    mined = match(open_urls.select("url", tokens(F.col("url")).alias("tokens")), mined_rules)
    return fixed.join(mined, "url", "left").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("fixed.rule").alias("rule"),
        F.coalesce("fixed.verdict", "mined", F.lit(default)).alias("verdict"),
        F.when(F.col("fixed").isNotNull(), "rule").when(F.col("mined").isNotNull(), "mined").otherwise("default").alias("by"),
    )
