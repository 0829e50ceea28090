"""Many tags in one pass over each text: contexts, line numbers nearby, references that become links."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawgraph.functions.scalars import line_numbers
from drawgraph.operators.lineage import cut_lineage

#: Tags that one pass looks for; more are dealt into blocks by their hash, each with a pass of its own.
BLOCK = 200_000
#: Characters that a task gathers, of what it found, before it hands them on.
HANDED = 4_000_000
#: ASCII letters lose their case, one character for one, so that places stay.
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

Found = dict[str, list[int]]


def _automaton(tags: list[str]) -> ahocorasick.Automaton:
    """Finds each tag as it is and without hyphens; a value lists the (tag, bare) that a text stands for."""
    forms: dict[str, list[tuple[str, bool]]] = {}
    for tag in tags:
        for bare, form in enumerate((tag, tag.replace("-", ""))):
            if form and (tag, False) not in forms.get(form.translate(_LOWER), ()):
                forms.setdefault(form.translate(_LOWER), []).append((tag, bool(bare)))
    out = ahocorasick.Automaton()
    for form, value in forms.items():
        out.add_word(form, (len(form), value))
    out.make_automaton()
    return out


def places(automaton: ahocorasick.Automaton, text: str) -> tuple[Found, Found]:
    """Starts of every occurrence of each tag, as it is and without hyphens; occurrences may overlap."""
    whole: Found = {}
    bare: Found = {}
    for end, (n, value) in automaton.iter(text.translate(_LOWER)):
        for tag, is_bare in value:
            (bare if is_bare else whole).setdefault(tag, []).append(end - n + 1)
    return whole, bare


def apart(starts: list[int], n: int) -> list[int]:
    """The occurrences that a reader from the left finds: none begins inside the one before."""
    out: list[int] = []
    for s in starts:
        if not out or s >= out[-1] + n:
            out.append(s)
    return out


def contexts(text: str, starts: list[int], n: int, reach: int, most: int) -> list[str]:
    """Up to ``most`` stretches of a line with an occurrence and at most ``reach`` characters on both sides.

    A stretch begins as far left as it may, holds the last occurrence that lies within ``reach`` of its beginning, and
    the next begins behind it.
    """
    out: list[str] = []
    at = i = 0
    while len(out) < most:
        while i < len(starts) and starts[i] < at:
            i += 1
        if i == len(starts):
            break
        first = max(at, starts[i] - reach, text.rfind("\n", 0, starts[i]) + 1)
        end = text.find("\n", first)
        end = len(text) if end < 0 else end
        last = max(s for s in starts[i:] if s <= first + reach and s + n <= end)
        at = min(last + n + reach, end)
        out.append(text[first:at].strip())
    return out


def _scanned(texts: DataFrame, tags: DataFrame, schema: str, rows: Callable[[str, Found, Found], Iterator[tuple]]) -> DataFrame:
    """(doc_id, tag, ...) rows that ``rows`` makes of each text and the places of the tags in it."""
    spark = texts.sparkSession
    known = cut_lineage(tags.select("tag").filter("tag <> ''").distinct())
    blocks = -(-known.count() // BLOCK) or 1
    kind = texts.schema["doc_id"].dataType.simpleString()

    def over(block: int) -> DataFrame:
        some = [r["tag"] for r in known.filter(F.pmod(F.xxhash64("tag"), F.lit(blocks)) == block).collect()]  # about BLOCK at most
        sent = spark.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(sent.value) if sent.value else None
            for batch in batches:
                found: list[tuple] = []
                at: list[int] = []
                held = 0

                def handed() -> pa.RecordBatch:
                    columns = [pa.array(c) for c in zip(*found, strict=True)]
                    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], names=["doc_id", *(f"c{k}" for k in range(len(columns)))])

                for i, text in enumerate(batch.column(1)):
                    if automaton is not None and (text := text.as_py()):
                        for row in rows(text, *places(automaton, text)):
                            found.append(row)
                            at.append(i)
                            held += len(row[-1])
                            if held > HANDED:
                                yield handed()
                                found, at, held = [], [], 0
                if found:
                    yield handed()

        return texts.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, {schema}")

    return reduce(DataFrame.unionByName, [over(b) for b in range(blocks)])


def tag_contexts(texts: DataFrame, tags: DataFrame, reach: int = 120, most: int = 2) -> DataFrame:
    """(doc_id, tag, context) of every tag that a text mentions, contexts joined by ' | '.

    A tag is looked for anywhere, whatever the case of its letters; only where a text doesn't hold it, without hyphens.
    ``tags`` has a column tag. Each text is read once for all tags (once for each ``BLOCK`` of them). Null and empty
    texts and tags give nothing.
    """

    def rows(text: str, whole: Found, bare: Found) -> Iterator[tuple]:
        for tag, starts in [*whole.items(), *((t, s) for t, s in bare.items() if t not in whole)]:
            n = len(tag) if tag in whole else len(tag.replace("-", ""))
            yield tag, " | ".join(contexts(text, starts, n, reach, most))

    return _scanned(texts, tags, "tag string, context string", rows)


def lines_near_tags(texts: DataFrame, tags: DataFrame, reach: int = 400) -> DataFrame:
    """(doc_id, tag, line): distinct pipe-line numbers within ``reach`` characters of a mention of each tag.

    Mentions with and without hyphens count, each form from the left without overlap; a line number must lie inside the
    stretch. Texts are read as in ``tag_contexts``.
    """

    def rows(text: str, whole: Found, bare: Found) -> Iterator[tuple]:
        for forms, length in ((whole, len), (bare, lambda t: len(t.replace("-", "")))):
            for tag, starts in forms.items():
                for s in apart(starts, length(tag)):
                    yield tag, text[max(0, s - reach) : s + length(tag) + reach]

    around = _scanned(texts, tags, "tag string, around string", rows)
    return around.select("doc_id", "tag", F.explode(line_numbers(F.col("around"))).alias("line")).distinct()


def _replaced(text: Column, pattern: str, key: Callable[[Column], Column], number: Callable[[Column], Column], seen: Column, known: Column) -> Column:
    """(text, seen): each match of a known number becomes a link if it is the first of its key and not seen yet."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    keys = F.transform(matches, lambda m: F.when(F.map_contains_key(known, number(m)), key(m)))
    parts = F.struct(matches.alias("matches"), keys.alias("keys"), F.split(text, pattern, -1).alias("gaps"), seen.alias("seen"), known.alias("known"))

    def body(x: Column) -> Column:
        mine = lambda i: F.get(x["keys"], i)
        link = lambda m: F.concat(F.lit("[PID-"), number(m), F.lit("](#pid-"), F.element_at(x["known"], number(m)), F.lit(")"))
        first = lambda i: (F.array_position(x["keys"], mine(i)) == i + 1) & ~F.array_contains(x["seen"], mine(i))
        new = F.transform(x["matches"], lambda m, i: F.concat(F.when(first(i), link(m)).otherwise(m), F.get(x["gaps"], i + 1)))
        return F.struct(F.concat(F.get(x["gaps"], F.lit(0)), F.array_join(new, "")).alias("text"), F.array_union(x["seen"], F.array_compact(x["keys"])).alias("seen"))

    return F.get(F.transform(F.array(parts), body), F.lit(0))  # the parts are computed once


def _known(messages: DataFrame, keys: list[str], text: str, mapping: DataFrame) -> DataFrame:
    """``messages`` with ``_known``: number to target of the drawings that a text names."""
    numbers = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)PID-(\d{3,4})"), F.lit(1)), lambda n: F.lpad(n, 4, "0")))
    named = messages.select(*keys, F.explode(numbers).alias("number"))
    first = mapping.groupBy("number").agg(F.min("target").alias("target"))
    found = named.join(first, "number").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("number", "target"))).alias("_known"))
    return messages.join(found, keys, "left").withColumn("_known", F.coalesce("_known", F.create_map().cast("map<string,string>")))


def link_drawing_refs(messages: DataFrame, keys: list[str], mapping: DataFrame) -> DataFrame:
    """``messages`` whose ``text`` has links to the drawings that it names, one for the first mention of each.

    ``mapping`` has (number of four digits, target); ``keys`` tell messages apart. In turn: ``[doc_id:...]`` with a
    number of four digits in it, ``[PID-...]``, which share their first mentions, and bare ``PID-...``, of which each
    spelling of a number counts on its own and mentions inside the links before count too. Other mentions, unknown
    drawings and null texts stay as they are.
    """
    four = lambda m: F.regexp_extract(m, r"PID-(\d{4})", 1)
    some = lambda m: F.regexp_extract(m, r"(?i)PID-(\d{3,4})", 1)
    padded = lambda m: F.lpad(some(m), 4, "0")
    named = _known(messages, keys, "text", mapping)
    none = F.array().cast("array<string>")
    one = named.withColumn("_s", _replaced(F.col("text"), r"(?i)\[doc_id:[^\]]+\]", four, four, none, F.col("_known")))
    two = one.withColumn("_s", _replaced(F.col("_s.text"), r"(?i)\[PID-\d{3,4}\]", padded, padded, F.col("_s.seen"), F.col("_known")))
    again = _known(two.withColumn("text", F.coalesce("_s.text", "text")).select(*messages.columns), keys, "text", mapping)
    bare = _replaced(F.col("text"), r"(?i)\bPID-\d{3,4}\b", some, padded, none, F.col("_known"))
    return again.withColumn("text", F.coalesce(bare["text"], F.col("text"))).select(*messages.columns)
