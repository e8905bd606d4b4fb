"""Named queries over the test tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kgivm.plans import maintenance_queries, star_queries, text_queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits to deltas to decisions, summed per scenario against a rebuild."""
    return star_queries.scenario_summary(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return star_queries.QUERIES | text_queries.QUERIES | maintenance_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return star_queries.ORACLES | text_queries.ORACLES | maintenance_queries.ORACLES
