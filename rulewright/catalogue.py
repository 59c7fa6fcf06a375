"""Every registered query of this package but those of the corpus subpackage."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from rulewright import operators
from rulewright.operators import building, fuzzy, learn, stored, vectors
from rulewright.streaming import job, jobs, live


def _from_tables(key: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.from_tables(spark, key, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: partial(_from_tables, key) for key in operators.OPERATORS} | vectors.QUERIES | fuzzy.QUERIES | building.QUERIES | learn.QUERIES | stored.QUERIES | jobs.QUERIES | job.QUERIES | live.QUERIES


def oracle_sql() -> dict[str, str]:
    return {key: operators.oracle(key) for key in operators.OPERATORS} | vectors.ORACLES | stored.ORACLES | building.ORACLES | jobs.ORACLES | job.ORACLES | live.ORACLES
