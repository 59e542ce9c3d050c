"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing to weights, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievewright.llm import exact_dedup, mixing, near_dedup, packing, quality_rules
from sievewright.session import ship, stash, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy keeps."""
    return quality_rules.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    ship(spark)
    return near_dedup.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, the last of a shard cut to its block."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    ship(spark)
    return packing.pieces(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("source_mixing", mix), ("packing", pack)]

#: Neither near-duplicate classes nor token ids can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES):
            docs = stash(docs)
    return docs
