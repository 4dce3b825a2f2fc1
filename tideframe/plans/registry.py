"""All queries of the engine and the SQL that a second engine can check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog, studies  # noqa: F401  (registers its queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in catalog.CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, q in catalog.CATALOG.items() if (sql := q.oracle()) is not None}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network summary of a panel that is filled, however sparse."""
    return catalog.network_summary(spark, sf_dir, "ffill")
