"""Personal data: base patterns, and a bootstrapped search by context for identifiers that they miss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawgraph.llm.common import bit_table, cut, has_bit, let, words_of

# The base patterns, written so that Java's matcher neither recurses nor rescans a run of characters:
# possessive where giving back cannot help, and tried only where a run begins (or a match just ended).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE_ANY = f"{EMAIL}|{IP}|{CARD}|{PHONE}"
#: Words that might identify somebody: five characters or more, one of them a digit or '@'.
CANDIDATE = r"(?<![A-Za-z0-9@._+/-])(?=[A-Za-z._+/-]*+[0-9@])(?:[A-Za-z0-9@]|[._+/-](?=[A-Za-z0-9])){5,}+"
#: Kinds of base spans, then of discovered ones, which carry the kind of the seeds that led to them.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + tuple(f"{k}_like" for k in BASE_KINDS)
#: Characters before and after a match in which its context is read.
LEFT, RIGHT = 64, 32
#: Matches whose places are added up at once; keeps the cost of a text linear in its matches.
BLOCK = 128
#: Rounds of scoring between patterns and instances.
ROUNDS = 3
#: A pattern counts from so many different instances and this confidence.
MIN_SUPPORT, MIN_CONFIDENCE = 5.0, 0.7
#: An unseen instance is reported from this score.
MIN_SCORE = 0.7
#: Bits of the table of patterns whose occurrences are counted (a full table only lets more through).
PATTERN_BITS = 20


def _found(text: Column, pattern: str) -> Column:
    """Array of (s, e, v, left, right): code point span, value and the text around, of each match from the left.

    The context reaches over the neighbouring match, so identifiers in a row have one too.
    """
    kind = "struct<s:int,e:int,v:string,left:string,right:string>"
    empty = F.array().cast(f"array<{kind}>")
    zero = F.lit("")

    def within(m: Column, first: Column, at: Column, last: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            before, value = F.get(m["between"], i), F.get(m["values"], i)
            start = acc["at"] + F.length(before)
            end = start + F.length(value)
            near = F.concat(F.coalesce(F.get(m["between"], i - 1), zero), F.coalesce(F.get(m["values"], i - 1), zero), before)
            after = F.concat(F.get(m["between"], i + 1), F.coalesce(F.get(m["values"], i + 1), zero))
            new = F.struct(
                start.alias("s"), end.alias("e"), value.alias("v"), F.right(near, F.lit(LEFT)).alias("left"), F.left(after, F.lit(RIGHT)).alias("right")
            )
            return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(new)).alias("spans"))

        start = F.struct(at.alias("at"), empty.alias("spans"))
        return F.aggregate(F.sequence(first, last), start, step, lambda acc: acc["spans"])

    def place(m: Column) -> Column:
        n = F.size(m["values"])
        firsts = F.sequence(F.lit(0), n - 1, F.lit(BLOCK))
        total = lambda parts: F.aggregate(parts, F.lit(0), lambda acc, x: acc + F.length(x))
        held = F.transform(firsts, lambda f: total(F.slice(m["between"], f + 1, BLOCK)) + total(F.slice(m["values"], f + 1, BLOCK)))

        def sums(held: Column) -> Column:
            return F.aggregate(held, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

        def blocks(starts: Column) -> Column:
            return F.flatten(
                F.transform(firsts, lambda f, k: within(m, f, F.get(starts, k), F.least(f + BLOCK - 1, n - 1)))
            )

        return let(let(held, sums), blocks)

    def split(values: Column) -> Column:
        both = F.struct(values.alias("values"), F.split(text, pattern, -1).alias("between"))
        return F.when(F.size(values) > 0, let(both, place)).otherwise(empty)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), split)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    def total(digits: Column) -> Column:
        def part(i: Column) -> Column:
            d = F.substr(digits, i, F.lit(1)).cast("int")
            twice = (i % 2) == 0
            return F.when(twice & (d > 4), 2 * d - 9).when(twice, 2 * d).otherwise(d)

        places = F.sequence(F.lit(1), F.length(digits))
        return F.aggregate(F.transform(places, part), F.lit(0), lambda acc, x: acc + x) % 10 == 0

    return let(F.reverse(_digits(value)), total)


def _small_parts(value: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= F.lit("255")))

    return F.forall(F.split(value, r"\."), small)


def _of_kind(spans: Column, kind: int) -> Column:
    def one(x: Column) -> Column:
        return F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e"), x["v"].alias("v"), x["left"].alias("left"), x["right"].alias("right"))

    return F.transform(spans, one)


def base_spans(text: Column) -> Column:
    """Array of (s, k, e, v, left, right) over the four base kinds, ordered by start and kind; k indexes ``KINDS``."""
    phone_ok = lambda x: F.length(_digits(x["v"])).between(10, 15)
    found = (
        (0, EMAIL, None),
        (1, IP, lambda x: _small_parts(x["v"])),
        (2, CARD, lambda x: _luhn(x["v"])),
        (3, PHONE, phone_ok),
    )
    parts = []
    for k, pattern, valid in found:
        spans = _found(text, pattern)
        spans = spans if valid is None else F.filter(spans, valid)
        parts.append(_of_kind(spans, k))
    return F.sort_array(F.concat(*parts))


def _context_words(text: Column) -> Column:
    """Lower-case words with runs of digits as '0'; what opens a value ('=', ':', quotes, brackets) ends a word."""
    plain = F.regexp_replace(F.lower(text), "[0-9]+", "0")
    opened = F.regexp_replace(plain, r"([=:#(\[\"'])(?=[a-z0-9+])", "$1 ")
    return words_of(opened)


def _context_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _patterns(left: Column, right: Column) -> Column:
    """The lexical patterns of a context: its last word, last two and last three, and the words on both sides.

    A pattern holds a word of two letters or more, so separators alone are none.
    """

    def named(w: Column, parts: list[Column], tag: int) -> Column:
        words = F.array(*parts)
        ok = F.forall(words, lambda x: x.isNotNull()) & F.exists(words, lambda x: x.rlike(r"\p{L}{2}"))
        return F.when(ok, F.xxhash64(F.lit(tag), *[F.xxhash64(x) for x in parts]))

    def every(c: Column) -> Column:
        at = lambda k: F.try_element_at(c["l"], F.lit(-k))
        return F.array_compact(
            F.array(
                named(c, [at(1)], 1), named(c, [at(2), at(1)], 2), named(c, [at(3), at(2), at(1)], 3), named(c, [at(1), F.get(c["r"], F.lit(0))], 4)
            )
        )

    # the first word on the left and the last on the right may be cut
    whole = F.struct(
        F.when(F.length(left) < LEFT, _context_words(left)).otherwise(F.slice(_context_words(left), 2, LEFT)).alias("l"),
        F.when(F.length(right) < RIGHT, _context_words(right)).otherwise(F.slice(_context_words(right), 1, F.greatest(F.size(_context_words(right)) - 1, F.lit(0)))).alias("r"),
    )
    return let(whole, every)


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One slim row per document: id, h (hash of the text), base spans, other candidates. No text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # base patterns come first, so what they match, valid or not, is no candidate
    other = F.filter(_found(text, f"{BASE_ANY}|{CANDIDATE}"), lambda c: ~c["v"].rlike(BASE_ANY))
    return docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), base_spans(text).alias("base"), other.alias("other")
    )


def _occurrences(docs: DataFrame, patterns: DataFrame, text_col: str) -> DataFrame:
    """(pattern, n): how often each pattern stands before any word at all."""
    bits = bit_table(patterns.select(F.col("pattern").alias("h")), PATTERN_BITS)

    def met(wh: Column, table: Column) -> Column:
        def at(i: Column) -> Column:
            one, two, three, next_ = (F.get(wh, i - k) for k in (1, 2, 3, -1))
            found = F.array(
                F.xxhash64(F.lit(1), one), F.when(i > 1, F.xxhash64(F.lit(2), two, one)), F.when(i > 2, F.xxhash64(F.lit(3), three, two, one)),
                F.when(next_.isNotNull(), F.xxhash64(F.lit(4), one, next_)),
            )
            return F.filter(found, lambda h: has_bit(table, h, PATTERN_BITS))

        n = F.size(wh)
        return F.when(n > 1, F.flatten(F.transform(F.sequence(F.lit(1), n - 1), at)))

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(_context_hashes(_context_words(text)).alias("wh"), bits.scalar().alias("bits"))
    counted = rows.select(F.explode(met(F.col("wh"), F.col("bits"))).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    return counted.join(patterns.select("pattern"), "pattern", "left_semi")


def _discover(docs: DataFrame, scanned: DataFrame, text_col: str) -> DataFrame:
    """(id, h, s, e, k) of unseen identifiers, by scoring the graph of patterns and instances in rounds.

    Seeds score 1 for their kind, unseen instances 0 at first. A pattern's confidence for a kind is the score of what
    it stands before against all words that it stands before (unseen candidates of the seeds' shape count half), so
    words that stand before anything have none. An unseen instance's score is the confidence of its patterns, summed over
    its occurrences and divided by all of them (1 at most), so one chance context of a frequent number counts for little.
    Candidates of a kind have letters only if its seeds have, and about as many digits.
    """
    same = lambda v: F.xxhash64(F.lower(v))
    digits = lambda v: F.length(F.regexp_replace(v, "[^0-9]", ""))

    def occurrence(column: str, kind: Column) -> DataFrame:
        return scanned.select("id", "h", F.explode(column).alias("o")).select(
            "id", "h", "o.s", "o.e", same(F.col("o.v")).alias("instance"), kind.alias("kind"), digits(F.col("o.v")).alias("digits"),
            F.col("o.v").rlike("[A-Za-z]").alias("letters"), _patterns(F.col("o.left"), F.col("o.right")).alias("patterns"),
        )

    seen, unseen = occurrence("base", F.col("o.k")), occurrence("other", F.lit(None).cast("int"))
    edges = cut(
        seen.unionByName(unseen)
        .select("instance", "kind", "digits", "letters", F.explode("patterns").alias("pattern"))
        .groupBy("pattern", "instance", "kind", "digits", "letters")
        .agg(F.count("*").alias("occ"))
    )
    frequent = edges.groupBy("pattern").agg(F.count_distinct("instance").alias("c"), F.max("kind").alias("k"))
    frequent = cut(frequent.filter((F.col("c") >= MIN_SUPPORT) & F.col("k").isNotNull()).select("pattern"))
    none = unseen.select("id", "h", "s", "e", F.col("kind").alias("k")).limit(0)
    if frequent.isEmpty():
        return none
    counts = cut(_occurrences(docs, frequent, text_col))
    edges = edges.join(counts, "pattern")
    shapes = seen.groupBy("kind").agg(F.min("digits").alias("least"), F.max("digits").alias("most"), F.max("letters").alias("lettered"))
    fits = (F.col("digits") * 2 >= F.col("least")) & (F.col("digits") <= F.col("most") * 2 + 4) & (F.col("lettered") | ~F.col("letters"))
    seeds = edges.filter("kind is not null").withColumn("score", F.lit(1.0))
    totals = unseen.groupBy("instance").agg(F.count("*").alias("total"))
    # one row for each kind that the candidate's shape allows: four kinds at most
    open_ = cut(edges.filter("kind is null").drop("kind").join(F.broadcast(shapes), fits).join(totals, "instance").select("pattern", "instance", "kind", "occ", "n", "total"))
    seeds = cut(seeds.select("pattern", "instance", "kind", "occ", "n", "score"))
    scored = seeds.unionByName(open_.drop("total").withColumn("score", F.lit(0.0)))
    for _ in range(ROUNDS):
        good, known = F.sum(F.col("score") * F.col("occ")), F.sum("occ")
        against = F.greatest(F.max("n") - known, F.lit(0)) + (known - good) / 2
        patterns = (
            scored.groupBy("pattern", "kind")
            .agg(F.sum("score").alias("support"), (good / (good + against)).alias("confidence"))
            .filter((F.col("support") >= MIN_SUPPORT) & (F.col("confidence") >= MIN_CONFIDENCE))
        )
        reached = cut(
            open_.join(patterns, ["pattern", "kind"])
            .groupBy("instance", "kind")
            .agg(F.least(F.lit(1.0), F.sum(F.col("confidence") * F.col("occ")) / F.max("total")).alias("reached"))
        )
        again = open_.join(reached, ["instance", "kind"], "left")
        scored = seeds.unionByName(again.select("pattern", "instance", "kind", "occ", "n", F.coalesce("reached", F.lit(0.0)).alias("score")))
    best = reached.groupBy("instance").agg(F.max(F.struct("reached", F.col("kind").alias("k"))).alias("best")).filter(F.col("best.reached") >= MIN_SCORE)
    return unseen.join(best, "instance").select("id", "h", "s", "e", F.col("best.k").alias("k"))


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All spans of every document: id, h, base (array of s, k, e), spans (base and discovered ones).

    Spans count code points, end exclusive, ordered by start and kind. Null and empty texts have none; null ids
    are kept; equal rows get equal spans; an empty table gives no rows; other columns are not read.
    """
    scanned = cut(_scan(docs, id_col, text_col))
    new = (
        _discover(docs, scanned, text_col)
        .groupBy("id", "h")
        .agg(F.collect_set(F.struct("s", (F.col("k") + len(BASE_KINDS)).alias("k"), "e")).alias("new"))
        .select(F.col("id").alias("new_id"), F.col("h").alias("new_h"), "new")
    )
    base = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    joined = scanned.join(new, (F.col("h") == F.col("new_h")) & F.col("id").eqNullSafe(F.col("new_id")), "left")
    every = F.when(F.col("new").isNull(), base).otherwise(F.sort_array(F.concat(base, "new")))
    return joined.select(F.col("id").alias(id_col), "h", base.alias("base"), every.alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of the base kinds, digest of the base spans, and all spans as text."""
    found = extract(docs, id_col, text_col)
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        id_col,
        *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)],
        F.sha2(F.encode(written(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets.

    Overlapping spans are replaced once, by the first one's kind. Texts without spans, null ones included, and all
    other columns stay as they are; every row stays.
    """
    found = extract(docs, id_col, text_col).filter(F.size("spans") > 0)
    found = found.select(F.col(id_col).alias("_pii_id"), F.col("h").alias("_pii_h"), F.col("spans").alias("_pii"))
    found = found.dropDuplicates(["_pii_id", "_pii_h"])
    text = F.col(text_col)
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, x: Column) -> Column:
        piece = F.concat(F.substr(text, acc["at"] + 1, x["s"] - acc["at"]), F.get(kinds, x["k"]))
        return F.when(
            x["s"] >= acc["at"],
            F.struct(x["e"].alias("at"), F.concat(acc["parts"], F.array(piece)).alias("parts")),
        ).otherwise(F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["parts"].alias("parts")))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    masked = F.aggregate(
        "_pii", zero, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(text, acc["at"] + 1, F.length(text)))
    )
    key = (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_pii_h")) & F.col(id_col).eqNullSafe(F.col("_pii_id"))
    joined = docs.join(found, key, "left")
    new = F.when(F.col("_pii").isNull(), text).otherwise(masked)
    return joined.select(*[new.alias(c) if c == text_col else docs[c] for c in docs.columns])
