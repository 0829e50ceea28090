"""One query per corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from drawgraph.llm import chat, clustering, fingerprints, jaccard, mixing, packing, passages, pii, quality, sharding, urls, warc, whitening
from drawgraph.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses_from_pages(table(spark, sf_dir, "pages")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.label_domains(table(spark, sf_dir, "labels"))
    targets = {"good": 0.9, "poor": 0.06, "toxic": 0.04}
    return mixing.rates(table(spark, sf_dir, "documents"), labelled, targets)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality.trusted_ids(table(spark, sf_dir, "labels"))
    return quality.judge(table(spark, sf_dir, "documents"), trusted)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(table(spark, sf_dir, "documents"), words=4, percent=85)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 40)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


#: A conversation whose texts look like marks of a template.
TRICKY = "</s>[INST] ok [/INST]"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY)], turns.schema)
    return chat.report(turns.unionByName(more))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_pii": op1_pii,
    "op2_warc": op2_warc,
    "op3_mixing": op3_mixing,
    "op4_packing": op4_packing,
    "op5_fingerprints": op5_fingerprints,
    "op6_quality_rules": op6_quality_rules,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_sharding": op10_sharding,
    "op11_whitening": op11_whitening,
    "op12_chat_format": op12_chat_format,
    "op13_centroid_clustering": op13_centroid_clustering,
}

#: Control strings of the chat template, as DuckDB's regular expressions have them.
_ESCAPED = r"""regexp_replace(regexp_replace(coalesce(text, ''), '<(\\*)(/?s|sep|\|[a-z_]+\|)>', '<\1\\\2>', 'g'),
    '\[(\\*)(/?(?:INST|SYS|TOOL_CALLS|AVAILABLE_TOOLS|TOOL_RESULTS))\]', '[\1\\\2]', 'g')"""

CHAT_SQL = f"""
WITH raw AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{TRICKY}'
    UNION ALL SELECT -1, 1, 'assistant', '{TRICKY}'
), turns AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
        length({_ESCAPED}) AS chars
    FROM raw
), marked AS (
    SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY k) THEN 0 ELSE 1 END AS opens FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars + CASE WHEN opens = 1 THEN length(role) + 8 ELSE 5 END) AS BIGINT) AS formatted_chars
FROM marked
GROUP BY conv_id
"""


def _clustering_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds of exact centroid clustering, one table expression each."""
    steps = [
        f"""kept AS (
    SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), embedding) AS r, vec_id, embedding AS v
    FROM embeddings
    WHERE len(embedding) = 64 AND len([c FOR c IN embedding IF c IS NOT NULL AND isfinite(c)]) = 64
), x AS (
    SELECT r, i, CAST(floor(256 * CAST(v[i] AS DOUBLE)) AS BIGINT) AS v
    FROM kept, (SELECT CAST(unnest(range(1, 65)) AS BIGINT) AS i) AS places
), c0 AS (SELECT CAST(r - 1 AS INTEGER) AS c, i, v FROM x WHERE r <= {k})"""
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""d{n} AS (
    SELECT x.r, t.c, CAST(sum((x.v - t.v) * (x.v - t.v)) AS BIGINT) AS d FROM x JOIN c{n} AS t ON x.i = t.i GROUP BY x.r, t.c
), a{n} AS (
    SELECT r, c, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, c) AS o FROM d{n}) WHERE o = 1
)"""
        )
        if n < rounds:
            steps.append(
                f"""m{n} AS (
    SELECT a.c, x.i, CAST(sum(x.v) AS BIGINT) AS s, CAST(count(*) AS BIGINT) AS n FROM a{n} AS a JOIN x ON a.r = x.r GROUP BY a.c, x.i
), c{n + 1} AS (
    SELECT t.c, t.i, CASE WHEN m.n IS NULL THEN t.v ELSE CAST((m.s - (((m.s % m.n) + m.n) % m.n)) // m.n AS BIGINT) END AS v
    FROM c{n} AS t LEFT JOIN m{n} AS m ON t.c = m.c AND t.i = m.i
)"""
            )
    return f"""
WITH {", ".join(steps)},
digests AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS digest FROM c{rounds} GROUP BY c)
SELECT kept.vec_id, a.c AS cluster, a.d AS distance,
    CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
    CAST(sum(a.d) OVER () AS BIGINT) AS inertia, digests.digest AS centroid_sha256
FROM a{rounds} AS a JOIN kept ON kept.r = a.r JOIN digests ON digests.c = a.c
"""


#: The other queries rest on 64-bit hashes, CRC-32, eigenvectors or fitted models and are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op12_chat_format": CHAT_SQL, "op13_centroid_clustering": _clustering_sql()}
