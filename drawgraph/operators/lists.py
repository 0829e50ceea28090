"""Operators on single lists: nodes, labels, pages, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def list_nodes(nodes: DataFrame, node_type: str, subtype_prefix: str = "") -> DataFrame:
    return nodes.filter((F.col("type") == node_type) & F.coalesce("subtype", F.lit("")).startswith(subtype_prefix))


def props_summary(props: Column) -> Column:
    """Entries that aren't null, '', '[]' or '{}'; 0 and false stay."""
    return F.map_filter(props, lambda _, v: v.isNotNull() & ~v.isin("", "[]", "{}"))


#: Marks of ids that were made up while drawings were digitised; fixed values.
AUTO_INSIDE = r"_r\d+c\d+|_osbl|_anno_|_sub_|_tile_"
AUTO_START = r"spec_break_|anno_|term_|barred_tee_"


def strip_auto_ids(document: Column, inside: str = AUTO_INSIDE, start: str = AUTO_START) -> Column:
    """JSON text without the ``id`` entries, at any depth of objects and lists, whose text is a made-up id.

    Such an id has ``inside`` anywhere or begins with ``start``, in any case. Everything else stays byte for byte, ids
    that are numbers or objects too; text that is no JSON, and null, stay as they are.

    The tree is walked in its text, in one pass and to any depth: a bare quote ends or begins a string (inside one it
    is escaped), so ``"id"`` with a colon behind it is a key wherever it stands and never part of a value. Keys and ids
    that spell plain letters as ``\\u`` escapes aren't recognised.
    """
    value = rf'"(?:[^"\\]*?(?:\\.[^"\\]*?)*?(?:{inside})|(?:{start}))[^"\\]*(?:\\.[^"\\]*)*"'
    entry = rf'"id"\s*:\s*(?i:{value})'
    first = F.regexp_replace(document, rf"(\{{\s*){entry}\s*(?:,\s*|(?=\}}))", "$1")  # the first or only entry of an object
    clean = F.regexp_replace(first, rf"\s*,\s*{entry}", "")
    return F.when(F.try_parse_json(document).isNotNull(), clean).otherwise(document)


def remap_classes(lines: DataFrame, mapping: dict[int, int]) -> DataFrame:
    """``new_cls`` of each label line; a file (stem) with an unknown class or a malformed line is rejected whole."""
    fields = F.split("line", " ")
    known = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    well_formed = F.col("line").rlike(r"^\d+( [0-9.]+){4}$")
    new = F.when(well_formed, known[fields[0].try_cast("int")])
    found = lines.withColumn("new_cls", new)
    bad = found.filter(F.col("new_cls").isNull()).select("stem").distinct()
    return found.join(bad, "stem", "left_anti")


def norm_class_label(label: Column, names: dict[str, str]) -> Column:
    known = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(known[F.trim(label)], F.lower(F.trim(label)))


def call_cost(model: Column, tokens_in: Column, tokens_out: Column, rates: dict[str, tuple[float, float]]) -> Column:
    """Cost by rates per million tokens; an unknown model costs nothing."""
    rate = lambda k: F.coalesce(F.create_map(*[x for m, r in rates.items() for x in (F.lit(m), F.lit(r[k]))])[model], F.lit(0.0))
    return (tokens_in * rate(0) + tokens_out * rate(1)) / F.lit(1e6)


def title_block(pages: DataFrame) -> DataFrame:
    """First two non-blank lines of a page as title and system."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S"))
    return pages.withColumn("_l", lines).withColumn("title", F.get("_l", F.lit(0))).withColumn("system", F.get("_l", F.lit(1))).drop("_l")


def first_rows(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group in file order."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def compact_entities(nodes: DataFrame, edges: DataFrame, n: int = 100, m: int = 150) -> DataFrame:
    """(pid, kind, id, body): the first ``n`` tagged nodes and ``m`` edges of each drawing as JSON without null and empty fields.

    Nodes need (pid, node_seq, id), edges (pid, edge_seq, id); the sequence is not shown.
    """

    def shown(rows: DataFrame, kind: str, order: str) -> DataFrame:
        fields = [F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns if c not in ("pid", order)]
        return rows.select("pid", F.lit(kind).alias("kind"), "id", F.to_json(F.struct(*fields)).alias("body"))

    some = first_rows(nodes.filter("tag <> ''"), "pid", "node_seq", n)
    return shown(some, "node", "node_seq").unionByName(shown(first_rows(edges, "pid", "edge_seq", m), "edge", "edge_seq"))


def check_nodes(nodes: DataFrame, types: tuple[str, ...], required: tuple[str, ...]) -> DataFrame:
    """(id, issue): types out of the enumeration, and missing required fields."""
    issues = F.array(
        F.when(~F.coalesce(F.col("type").isin(*types), F.lit(False)), "bad type"), *[F.when(F.col(c).isNull(), f"no {c}") for c in required]
    )
    return nodes.select("id", F.explode(F.array_compact(issues)).alias("issue"))


def check_values(rows: DataFrame, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """(id, issue): columns whose value is not one of the enumeration; a null value is none."""
    issues = F.array(*[F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), f"bad {c}") for c, values in allowed.items()])
    return rows.select("id", F.explode(F.array_compact(issues)).alias("issue"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, issue) of edges with an end that no node has."""
    ids = nodes.select(F.col("id").alias("_n"), F.lit(True).alias("_known"))
    a = ids.select(F.col("_n").alias("src"), F.col("_known").alias("_a"))
    b = ids.select(F.col("_n").alias("dst"), F.col("_known").alias("_b"))
    found = edges.join(a, "src", "left").join(b, "dst", "left").filter(F.col("_a").isNull() | F.col("_b").isNull())
    return found.select("id", F.lit("dangling end").alias("issue"))
