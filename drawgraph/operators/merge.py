"""Merging of tile extractions: corrections, additions, enrichment, stitching, de-duplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawgraph.functions.scalars import norm_tag, norm_tag_strict, tile_key, type_of_subtype
from drawgraph.operators.ranks import ranked

#: Opposite edges, and the step (row, column) to the neighbour tile behind an edge.
EDGES = (("EDGE_LEFT", "EDGE_RIGHT", 0, -1), ("EDGE_RIGHT", "EDGE_LEFT", 0, 1), ("EDGE_TOP", "EDGE_BOTTOM", -1, 0), ("EDGE_BOTTOM", "EDGE_TOP", 1, 0))


def apply_corrections(components: DataFrame, corrections: DataFrame, keys: tuple[str, ...] = ("tile", "id")) -> DataFrame:
    """``components`` with their JSON document ``body`` patched; only those of pass 1 are.

    ``corrections`` has the keys and (fld, val, seq): ``fld`` names a field, or ``field.key`` one key of a field that is
    an object, and is set to the JSON text ``val`` (text that isn't JSON is a string, null is JSON's null). They hold in
    the order of ``seq``, the last one wins, and all other fields and keys stay. A key whose field is missing at that
    point, or is no object, changes nothing. A body that is no JSON object stays as it is; so does one that nothing corrects.

    The last value of each path is found by one aggregation, and the patches of a component meet it in one join: a
    field's last whole value goes in first, then the keys that were set after it.
    """
    last = corrections.filter("fld <> ''").groupBy(*keys, "fld").agg(F.max("seq").alias("seq"), F.max_by("val", "seq").alias("val"))
    value = "coalesce(try_parse_json(coalesce(val, 'null')), cast(val as variant))"
    patches = last.groupBy(*keys).agg(
        F.expr(f"map_from_entries(collect_list(case when instr(fld, '.') = 0 then struct(fld, struct(seq, {value} as val)) end))").alias("_whole"),
        F.expr(
            f"collect_list(case when instr(fld, '.') > 0 then "
            f"struct(substring_index(fld, '.', 1) as field, substr(fld, instr(fld, '.') + 1) as key, seq, {value} as val) end)"
        ).alias("_keys"),
    )
    fields = "map_zip_with(_body, _whole, (f, old, new) -> coalesce(new.val, old))"
    later = "filter(_keys, k -> k.field = f and k.seq > coalesce(_whole[f].seq, k.seq - 1))"
    patched = f"map_zip_with(try_variant_get(v, '$', 'map<string,variant>'), map_from_entries(transform({later}, k -> struct(k.key, k.val))), (k, old, new) -> coalesce(new, old))"
    whole = f"transform_values({fields}, (f, v) -> case when size({later}) = 0 then v else coalesce(parse_json(to_json({patched})), v) end)"
    joined = components.join(patches, list(keys), "left").withColumn("_body", F.expr("from_json(body, 'map<string,variant>')"))
    new = F.when((F.col("pass") == 1) & F.col("_keys").isNotNull() & F.col("_body").isNotNull(), F.to_json(F.expr(whole))).otherwise(F.col("body"))
    return joined.withColumn("body", new).select(*components.columns)


def merge_additions(components: DataFrame, order: tuple[int, ...] = (1, 3, 2)) -> DataFrame:
    """One row per (tile, id): the first by pass precedence, then by position."""
    precedence = F.create_map(*[x for k, p in enumerate(order) for x in (F.lit(p), F.lit(k))])[F.col("pass")]
    rank = F.row_number().over(Window.partitionBy("tile", "id").orderBy(precedence, "seq"))
    return components.withColumn("_r", rank).filter("_r = 1").drop("_r")


def enrich_setpoints(components: DataFrame, setpoints: DataFrame) -> DataFrame:
    """``setpoints`` (array of level and value, in order) for every component of an equal tag."""
    lists = setpoints.filter("tag is not null").groupBy("tag").agg(F.sort_array(F.collect_list(F.struct("seq", "level", "value"))).alias("_s"))
    joined = components.join(lists, "tag", "left")
    return joined.withColumn("setpoints", F.transform("_s", lambda x: F.struct(x["level"].alias("level"), x["value"].alias("value")))).drop("_s")


def enrich_positions(components: DataFrame, positions: DataFrame) -> DataFrame:
    """``normal_position`` of the last record of an equal tag, ``interlock_ref`` of the last that has one (not '').

    Where ``components`` has these columns, a component without a record, or without a reference, keeps its own.
    """
    last = positions.filter("tag is not null").groupBy("tag").agg(
        F.max_by(F.struct("position"), "seq").alias("_position"), F.max_by("interlock_ref", F.when(F.col("interlock_ref") != "", F.col("seq"))).alias("_ref")
    )
    own = lambda c: F.col(c) if c in components.columns else F.lit(None).cast("string")
    return (
        components.join(last, "tag", "left")
        .withColumns({"normal_position": F.when(F.col("_position").isNotNull(), F.col("_position.position")).otherwise(own("normal_position")), "interlock_ref": F.coalesce("_ref", own("interlock_ref"))})
        .drop("_position", "_ref")
    )


def enrich_conditions(components: DataFrame, conditions: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The last value of each field that isn't null or '' for components of an equal tag."""
    last = conditions.filter("tag is not null").groupBy("tag").agg(
        *[F.max_by(f, F.when(F.coalesce(F.col(f), F.lit("")) != "", F.col("seq"))).alias(f) for f in fields]
    )
    return components.join(last, "tag", "left")


def stitch_edges(connections: DataFrame) -> DataFrame:
    """Bridges between neighbour tiles of a drawing: (pid, tile, seq, other_tile, other_seq, src, dst, line_tag).

    A connection that touches an edge meets every connection that touches the opposite edge of the tile behind it.
    """
    keyed = connections.withColumn("_k", tile_key(F.col("tile")))
    touches = keyed.select(
        "*",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("dst").startswith("EDGE_"), F.struct(F.col("dst").alias("edge"), F.col("src").alias("real"))),
                    F.when(F.col("src").startswith("EDGE_"), F.struct(F.col("src").alias("edge"), F.col("dst").alias("real"))),
                )
            )
        ).alias("_t"),
    ).filter(~F.col("_t.real").startswith("EDGE_"))
    opposite = reduce(lambda acc, e: acc.when(F.col("_t.edge") == e[0], F.struct(F.lit(e[1]).alias("edge"), F.lit(e[2]).alias("dr"), F.lit(e[3]).alias("dc"))), EDGES, F)
    here = touches.withColumn("_o", opposite).select(
        "pid", "tile", "seq", F.col("_t.real").alias("src"), "line_tag", F.col("_o.edge").alias("edge"),
        (F.col("_k.row") + F.col("_o.dr")).alias("row"), (F.col("_k.col") + F.col("_o.dc")).alias("col"),
    )
    there = touches.select(
        "pid", F.col("tile").alias("other_tile"), F.col("seq").alias("other_seq"), F.col("_t.real").alias("dst"),
        F.col("line_tag").alias("_line"), F.col("_t.edge").alias("edge"), F.col("_k.row").alias("row"), F.col("_k.col").alias("col"),
    )
    return here.join(there, ["pid", "edge", "row", "col"]).select(
        "pid", "tile", "seq", "other_tile", "other_seq", "src", "dst", F.coalesce("line_tag", "_line").alias("line_tag")
    )


def dedup_richest(rows: DataFrame, tag: str, size: str, order: str) -> DataFrame:
    """Per normalised tag the row of the largest ``size``, the first of equals; rows without a tag all stay."""
    named = rows.withColumn("_t", norm_tag(F.col(tag)))
    rank = F.row_number().over(Window.partitionBy("_t").orderBy(F.desc(size), order))
    best = named.filter("_t <> ''").withColumn("_r", rank).filter("_r = 1").drop("_r")
    return best.unionByName(named.filter("_t = ''")).drop("_t")


def dedup_first(rows: DataFrame, tag: str, order: list[str]) -> DataFrame:
    """Per strictly normalised tag the first row; rows without a tag all stay."""
    named = rows.withColumn("_t", norm_tag_strict(F.col(tag)))
    rank = F.row_number().over(Window.partitionBy("_t").orderBy(*order))
    best = named.filter("_t <> ''").withColumn("_r", rank).filter("_r = 1").drop("_r")
    return best.unionByName(named.filter("_t = ''")).drop("_t")


def union_tiles(parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Everything that the tiles of a drawing hold: ``parts`` (components, connections, refs, breaks, notes, flags) by name.

    Components and connections get their tile before their id, unless it begins with it, and ``source_tile``. One
    without an id is named by its place in the tile (``comp_0``, ``conn_0``; order ``seq``). The other parts stay as they are.
    """
    out = dict(parts)
    for name, word in (("components", "comp"), ("connections", "conn")):
        rows = parts.get(name)
        if rows is not None:
            placed = ranked(rows, [c for c in ("pid", "tile") if c in rows.columns], [F.col("seq")])
            id_ = F.coalesce(F.nullif(F.col("id"), F.lit("")), F.concat(F.lit(f"{word}_"), (F.col("rank") - 1).cast("string")))
            whole = F.when(F.startswith(id_, F.col("tile")), id_).otherwise(F.concat_ws("__", "tile", id_))
            out[name] = placed.withColumns({"id": whole, "source_tile": F.col("tile")}).drop("rank")
    return out


def graph_nodes(components: DataFrame, refs: DataFrame, breaks: DataFrame) -> DataFrame:
    """(pid, id, type, subtype, tag, off_page_ref, props): the nodes of a graph from what was extracted.

    A component's id is its tag without spaces, or its own id without a tag; its type follows from its subtype, and
    ``fields`` (a map of what else is known) become props without null and empty values. A reference becomes a
    terminator, a spec break a junction that tells both specifications. Of equal ids in a drawing the first by ``seq``
    stays, components first.
    """
    text = F.lit(None).cast("string")
    tagged = F.nullif(F.replace(F.col("tag"), F.lit(" "), F.lit("")), F.lit(""))
    known = F.map_filter("fields", lambda _, v: v.isNotNull() & (v != ""))
    a = components.select("pid", F.lit(0).alias("_k"), "seq", F.coalesce(tagged, F.col("id")).alias("id"), type_of_subtype(F.col("subtype")).alias("type"), "subtype", "tag", text.alias("off_page_ref"), F.to_json(known).alias("props"))
    b = refs.select("pid", F.lit(1).alias("_k"), "seq", F.concat(F.lit("term_"), F.col("seq").cast("string")).alias("id"), F.lit("terminator").alias("type"), text.alias("subtype"), text.alias("tag"), F.col("ref").alias("off_page_ref"), F.lit("{}").alias("props"))
    spec = F.to_json(F.struct(F.lit(True).alias("spec_change"), "from_spec", "to_spec"))
    c = breaks.select("pid", F.lit(2).alias("_k"), "seq", F.concat(F.lit("spec_break_"), F.col("seq").cast("string")).alias("id"), F.lit("junction").alias("type"), text.alias("subtype"), text.alias("tag"), text.alias("off_page_ref"), spec.alias("props"))
    rows = a.unionByName(b).unionByName(c)
    fields = ["type", "subtype", "tag", "off_page_ref", "props"]
    first = rows.groupBy("pid", "id").agg(F.min_by(F.struct(*fields), F.struct("_k", "seq")).alias("n"))
    return first.select("pid", "id", "n.*")


def expand_subtypes(components: DataFrame, codes: dict[str, str]) -> DataFrame:
    known = F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))])
    return components.withColumn("subtype", F.coalesce(known[F.col("subtype")], F.col("subtype")))


def stitch_stats(components: DataFrame, connections: DataFrame) -> DataFrame:
    """One row: raw and de-duplicated components, connections inside tiles and across them."""
    raw = components.agg(F.count("*").alias("raw_components"))
    kept = dedup_richest(components, "tag", "size", "seq").agg(F.count("*").alias("components"))
    inner = connections.filter(~F.col("src").startswith("EDGE_") & ~F.col("dst").startswith("EDGE_")).agg(F.count("*").alias("intra"))
    cross = stitch_edges(connections).agg(F.count("*").alias("cross_tile"))
    return raw.join(kept).join(inner).join(cross)  # one row each


def sub_tile_fallback(results: DataFrame) -> DataFrame:
    """Per tile the results of the first mode (whole, half, quarter) of which no piece failed; ``results`` has (tile, mode, ok)."""
    preference = F.when(F.col("mode") == "whole", 0).when(F.col("mode") == "half", 1).otherwise(2)
    modes = results.groupBy("tile", "mode").agg(F.bool_and("ok").alias("_ok")).filter("_ok")
    best = modes.groupBy("tile").agg(F.min_by("mode", preference).alias("mode"))
    return results.join(best, ["tile", "mode"])
