"""All queries of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import language, preparation, surface


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Daily totals per event type, the types in order of their totals."""
    return surface.flagship(spark, d)


def queries() -> dict:
    return preparation.queries() | surface.queries() | language.queries()


def oracle_sql() -> dict[str, str]:
    return preparation.oracle_sql() | surface.oracle_sql() | language.oracle_sql()
