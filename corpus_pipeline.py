"""A training-data pipeline over ``documents``: filter, de-duplicate, redact, mix, pack."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawgraph.llm import jaccard, mixing, packing, pii, quality
from drawgraph.llm.common import cut, table

#: Weights of the domains in the mixture, and its tokens against those that come in.
TARGETS = {"good": 0.97, "poor": 0.01, "toxic": 0.02}
BUDGET = 1.1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio; the others go."""
    trusted = quality.trusted_ids(table(spark, sf_dir, "labels"))
    return quality.judge(docs, trusted, keep=tuple(docs.columns)).filter("kept").select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles are 80 % alike, directly or through others."""
    return jaccard.representatives(docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or dropped by the rates that bring the labelled domains to ``TARGETS``."""
    labelled = mixing.label_domains(table(spark, sf_dir, "labels"))
    return mixing.mixture(docs, labelled, TARGETS, BUDGET)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Hashes, fitted models and packing have no equal in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)  # the next stage reads it more than once
    return docs
