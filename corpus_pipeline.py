"""A training corpus from `documents`: quality rules, near-duplicates, pseudonyms, mixing, piece ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernel.llm import common, mixing, pieces, pii, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs, pii.shown_key(spark))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document of the mix, and whether they decode to its text."""
    return pieces.encoded_and_checked(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("pseudonyms", pseudonyms),
    ("mixing", mix),
    ("piece ids", piece_ids),
]

#: No stage is expressible in SQL as a whole: trained weights, XXH64, a keyed permutation and a tokenizer take part.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written before the next; a stage's table goes once its successor is written."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, path = common.written_to(docs)
            if before:
                common.remove(spark, before)
            before = path
    return docs
