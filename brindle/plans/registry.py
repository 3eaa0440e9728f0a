"""All registered queries of the core and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.plans import core_problems, extras, features, models, relational

BOOKS = [core_problems, features.B, relational.B, models.B, extras.B]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in BOOKS:
        found |= m.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for m in BOOKS:
        found |= m.ORACLES
    return found


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["fm_hourly"](spark, sf_dir)
