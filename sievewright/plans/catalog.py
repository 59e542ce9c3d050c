"""All registered queries of the engine on the standard tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievewright.plans import agent_queries, corpus_queries, registry, rules_queries, search_queries, zh_queries

MODULES = (corpus_queries, search_queries, rules_queries, agent_queries, zh_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_queries.flagship(spark, sf_dir)


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
