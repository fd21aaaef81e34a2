"""From raw documents to packed sequences: filter, deduplicate, mix and pack.

Each stage takes (spark, docs, sf_dir) and gives documents again, but for the last one, which gives the places of their
pieces. A stage works on all that the one before it kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eospark.functions.shipping import ship
from eospark.functions.storage import clear, mark, staged
from eospark.llm import exact_dedup, mixing, packing, simhash_dedup, toxicity

#: A source is passed over at most so many times.
REPETITION_LIMIT = 2.0
#: SQL cannot express classifiers, SimHash components or bin packing.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the table's labels, scores below its threshold."""
    ship(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each group of equal texts."""
    ship(spark)
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each group of near duplicates."""
    ship(spark)
    return simhash_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and documents of smaller sources again as far as the repetition limit goes."""
    ship(spark)
    return mixing.mix(docs, repetition_limit=REPETITION_LIMIT).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences."""
    ship(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents``; what a stage gives is written before the next one reads it.

    Once a stage's result is written, the tables that it made on the way, and its input, are deleted.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = mark()
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if (name, stage) != STAGES[-1]:
            docs = staged(docs, name)
            clear(spark, since, but=1)
    return docs
