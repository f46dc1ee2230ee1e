"""Name -> query over the driver's tables, and name -> the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grainfold.plans import files, runs, scores, search, texts, timely  # noqa: F401, they register their queries
from grainfold.plans.base import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid_search(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
