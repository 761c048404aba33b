"""Named queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rainloom.plans import data_queries, fit_queries, formula_queries, reference_queries, table_queries  # noqa: F401


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return data_queries.QUERIES | reference_queries.QUERIES


def all_oracles() -> dict[str, str]:
    return data_queries.ORACLES | reference_queries.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_queries.top_rain_times(spark, sf_dir)
