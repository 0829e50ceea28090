"""Derived views over the driver tables, as portable SQL that Spark and DuckDB both run.

Sequence columns order rows without a global counter: they are numbers or padded texts built from keys.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

_NONE = "CAST(NULL AS STRING)"


def _node(group: int, key: str, letter: str, type_: str, subtype: str, tag: str, service: str, loop: str, ref: str, table: str) -> str:
    return (
        f"SELECT 'd' || CAST({key} % 3 AS STRING) AS pid, CAST({group} AS BIGINT) * 1000000000000 + {key} AS node_seq, "
        f"'{letter}:' || CAST({key} AS STRING) AS id, '{type_}' AS type, {subtype} AS subtype, {tag} AS tag, "
        f"{service} AS service, {loop} AS loop_id, {ref} AS off_page_ref, CAST({key} AS BIGINT) AS k FROM {{{table}}}"
    )


_PAD = "lpad(CAST({} AS STRING), 12, '0')"


def _edge(group: int, a: str, b: str, x: str, src: str, dst: str, kind: str, source: str) -> str:
    seq = f"'{group}|' || " + " || '|' || ".join(_PAD.format(c) for c in (a, b, x))
    return f"SELECT {seq} AS edge_seq, 'e' || {seq} AS id, {src} AS src, {dst} AS dst, {kind} AS kind FROM {source}"


VIEWS: dict[str, str] = {
    "g_nodes": " UNION ALL ".join(
        (
            _node(0, "n_nationkey", "N", "junction", _NONE, "n_name", _NONE, _NONE, _NONE, "nation"),
            _node(1, "c_custkey", "C", "equipment", "'equipment.' || lower(c_mktsegment)", "c_name", "c_mktsegment", _NONE, _NONE, "customer"),
            _node(2, "p_partkey", "P", "valve", "'valve.' || lower(p_type)", "'HV-' || lpad(CAST(p_partkey % 1500 AS STRING), 4, '0')", "p_brand", "'L' || CAST(p_partkey % 50 AS STRING)", _NONE, "part"),
            _node(3, "o_orderkey", "O", "instrument", "lower(o_orderpriority)", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'PT-' || lpad(CAST(o_orderkey AS STRING), 6, '0') END", _NONE, "'L' || CAST(o_custkey % 60 AS STRING)", _NONE, "orders"),
            _node(4, "s_suppkey", "S", "terminator", _NONE, _NONE, _NONE, _NONE, "CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE 'To Line-' || CAST(s_nationkey AS STRING) || '.A' END", "supplier"),
        )
    ),
    "g_edges": " UNION ALL ".join(
        (
            _edge(0, "c_nationkey", "c_custkey", "0", "'N:' || CAST(c_nationkey AS STRING)", "'C:' || CAST(c_custkey AS STRING)", "'containment'", "{customer}"),
            _edge(1, "o_custkey", "o_orderkey", "0", "'C:' || CAST(o_custkey AS STRING)", "'O:' || CAST(o_orderkey AS STRING)", "'process'", "{orders}"),
            _edge(2, "a", "b", "x", "'O:' || CAST(a AS STRING)", "'P:' || CAST(b AS STRING)", "CASE WHEN b % 2 = 0 THEN 'signal' ELSE 'impulse' END", "(SELECT DISTINCT l_orderkey AS a, l_partkey AS b, l_suppkey AS x FROM {lineitem}) u"),
            _edge(3, "a", "b", "0", "'P:' || CAST(a AS STRING)", "'S:' || CAST(b AS STRING)", "'process'", "(SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM {lineitem}) u"),
        )
    ),
    # nodes with the fields that the validation rules read; nulls by arithmetic
    "p_nodes": (
        "SELECT *, CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(k % 40 AS STRING) END AS design_pressure, "
        "CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(k % 300 AS STRING) END AS design_temp, "
        "CASE WHEN k % 6 = 0 THEN '' ELSE CAST(k % 30 AS STRING) END AS op_pressure, "
        "CASE WHEN k % 9 = 0 THEN NULL ELSE CAST(k % 200 AS STRING) END AS op_temp, "
        "CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(k % 50 AS STRING) || ' barg' END AS set_pressure, "
        "CASE WHEN k % 8 = 0 THEN NULL ELSE CAST(k % 12 AS STRING) || '\" in' END AS size_code, "
        "CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN 'LO' ELSE 'LC' END AS normal_position, "
        "CASE WHEN k % 2 = 0 THEN NULL ELSE 'FC' END AS fail_position, "
        "k % 13 = 0 AS spec_change, CASE WHEN k % 26 = 0 THEN NULL ELSE 'A1' END AS from_spec, "
        "CASE WHEN k % 39 = 0 THEN NULL ELSE 'B2' END AS to_spec FROM {g_nodes}"
    ),
    "words": (
        "SELECT *, CAST(CASE pos % 4 WHEN 0 THEN 0 WHEN 1 THEN 90 WHEN 2 THEN 180 ELSE 270 END AS INT) AS rotation FROM ("
        "SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS pos, "
        "CASE l_linenumber % 3 WHEN 0 THEN 'PT' WHEN 1 THEN lpad(CAST(l_partkey % 10000 AS STRING), 4, '0') ELSE 'HV-' || lpad(CAST(l_partkey % 10000 AS STRING), 4, '0') END AS text, "
        "CAST((l_partkey * 37) % 2000 AS INT) AS lft, CAST((l_suppkey * 53) % 1500 AS INT) AS top, CAST(20 + l_partkey % 60 AS INT) AS width, "
        "CAST(10 + l_suppkey % 20 AS INT) AS height, CAST(l_quantity AS INT) AS conf FROM {lineitem}) w"
    ),
    # tags found on a page, with repeats at near places
    "tags": (
        "SELECT page, pos, 'HV-' || lpad(CAST(lft % 7 AS STRING), 4, '0') AS tag, lft % 160 AS x, top % 120 AS y, conf FROM {words}"
    ),
    "boxes": (
        "SELECT CAST(l_orderkey % 300 AS BIGINT) AS image_id, l_orderkey * 1000000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ann_id, "
        "CAST(l_linenumber AS INT) AS cls, CAST((l_partkey * 37) % 7168 AS INT) AS xmin, CAST((l_suppkey * 53 + l_partkey) % 4562 AS INT) AS ymin, "
        "CAST(CASE WHEN l_partkey % 97 = 0 THEN 0 ELSE 20 + l_quantity END AS INT) AS w, CAST(10 + 2 * l_quantity AS INT) AS h FROM {lineitem}"
    ),
    # label lines: some with a missing or a surplus field, some with a class out of range
    "label_lines": (
        "SELECT 'ds' || CAST(image_id % 4 AS STRING) AS dataset, 'img' || CAST(image_id AS STRING) AS stem, ann_id, "
        "CASE WHEN ann_id % 101 = 0 THEN '1 0.5 0.5 0.1' WHEN ann_id % 103 = 0 THEN '1 0.5 0.5 0.1 0.1 0.1' "
        "WHEN ann_id % 107 = 0 THEN '99 0.5 0.5 0.1 0.1' WHEN ann_id % 109 = 0 THEN '2 1.5 0.5 0.1 0.1' "
        "ELSE CAST(cls AS STRING) || ' 0.' || CAST(xmin AS STRING) || ' 0.' || CAST(ymin AS STRING) || ' 0.' || CAST(w AS STRING) || ' 0.' || CAST(h AS STRING) END AS line FROM {boxes}"
    ),
    "x_components": (
        "SELECT 'r' || CAST(1 + CAST(floor((k % 6) / 3) AS INT) AS STRING) || 'c' || CAST(1 + k % 3 AS STRING) AS tile, 1 + l % 3 AS pass, seq, "
        "'k' || CAST(k % 997 AS STRING) || '_' || CAST(l % 3 AS STRING) AS id, type, CASE WHEN k % 5 = 0 THEN NULL ELSE 'V-' || CAST(CAST(floor(k / 2) AS BIGINT) % 400 AS STRING) END AS tag, props, fld, val "
        "FROM (SELECT l_orderkey AS k, CAST(l_linenumber AS INT) AS l, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, "
        "CASE l_linenumber % 2 WHEN 0 THEN 'valve' ELSE 'instrument' END AS type, '{{\"size\":\"' || CAST(l_partkey % 900 AS STRING) || '\"}}' AS props, "
        "CASE l_partkey % 3 WHEN 0 THEN 'type' WHEN 1 THEN 'tag' ELSE 'props.size' END AS fld, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE 'x' || CAST(l_suppkey AS STRING) END AS val FROM {lineitem}) u"
    ),
    "x_connections": (
        "SELECT 'd' || CAST(CAST(floor(k / 24) AS BIGINT) AS STRING) AS pid, 'r' || CAST(1 + CAST(floor((k % 6) / 3) AS INT) AS STRING) || 'c' || CAST(1 + k % 3 AS STRING) AS tile, seq, "
        "CASE WHEN p % 170 = 0 THEN 'EDGE_LEFT' WHEN p % 170 = 17 THEN 'EDGE_TOP' ELSE 'k' || CAST(p % 997 AS STRING) END AS src, "
        "CASE WHEN p % 170 = 34 THEN 'EDGE_RIGHT' WHEN p % 170 = 51 THEN 'EDGE_BOTTOM' ELSE 'k' || CAST(s % 997 AS STRING) END AS dst, "
        "CASE WHEN p % 2 = 0 THEN NULL ELSE 'LN-' || CAST(p AS STRING) END AS line_tag "
        "FROM (SELECT l_orderkey AS k, l_partkey AS p, l_suppkey AS s, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM {lineitem}) u"
    ),
    # the base words of documents, numbered by source and order of id, as chunks of a drawing's text
    "chunks": (
        "SELECT doc_id, source, lang, text, length(text) AS n, CASE WHEN doc_id % 5 = 0 THEN 'global' ELSE 'd' || CAST(doc_id % 3 AS STRING) END AS pid_tag FROM {documents}"
    ),
}
_NAME = re.compile(r"\{(\w+)\}")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a derived view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return run(spark, sf_dir, VIEWS[name])


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Portable SQL in Spark; ``{name}`` stands for a table or view."""
    names = dict.fromkeys(_NAME.findall(sql.replace("{{", "").replace("}}", "")))
    return spark.sql(sql, **{n: frame(spark, sf_dir, n) for n in names})


def duckdb(sql: str) -> str:
    """The same for DuckDB: the views it needs become common table expressions."""
    needed: dict[str, str] = {}

    def visit(text: str) -> None:
        for n in dict.fromkeys(_NAME.findall(text.replace("{{", "").replace("}}", ""))):
            if n in VIEWS and n not in needed:
                visit(VIEWS[n])
                needed[n] = VIEWS[n]

    visit(sql)
    names = {n: n for n in (*TABLES, *VIEWS)}
    heads = [f"{n} AS ({v.format(**names)})" for n, v in needed.items()]
    body = sql.format(**names)
    if not heads:
        return body
    if body.lstrip().upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(heads) + ", " + body.lstrip()[len("WITH RECURSIVE") :].lstrip()
    if body.lstrip().upper().startswith("WITH "):
        return "WITH " + ", ".join(heads) + ", " + body.lstrip()[5:]
    return "WITH " + ", ".join(heads) + " " + body
