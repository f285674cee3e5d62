"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.plans import changes, more  # noqa: F401 (they register their queries)
from codeloom.plans.queries import QUERIES, SQL

SMALLEST = "/root/testdata/sf0.001"


def entry(spark: SparkSession) -> DataFrame:
    """Files ranked by references, and the best symbols within a token budget."""
    return QUERIES["ranked_map"](spark, SMALLEST)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
