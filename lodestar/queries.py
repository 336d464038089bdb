"""The engine's own queries and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.plans import activity, catalogue, retrieval

QUERIES = retrieval.QUERIES | activity.QUERIES | catalogue.QUERIES
ORACLE_SQL = retrieval.ORACLE_SQL | activity.ORACLE_SQL | catalogue.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar items for a set of seeds: vector recall, then weighted re-ranking with reasons."""
    return retrieval.similar_items(spark, sf_dir)
