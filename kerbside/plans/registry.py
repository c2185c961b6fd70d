"""All queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kerbside.plans import analysis, ingest, learning  # noqa: F401  they register their queries
from kerbside.plans.bindings import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query that the driver smoke-tests."""
    return learning.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
