"""The operators by group. OPERATORS maps a key (inventory number and short name) to its SQL.

apply(spark, key, feedback=df, ...) runs one over any DataFrames of the input's columns; from_tables(spark, key, dir)
runs it over the driver's tables by the adapter views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rulewright.plans import sql as plans
from rulewright.sources.adapters import VIEWS

from . import classify, datagen, evaluate, extract, judged, lifecycle, pairs, route, similarity, stream, tables, tagged, tags, text, validate

OPERATORS: dict[str, str] = {}
for _group in (tables, text, classify, extract, tags, validate, similarity, route, lifecycle, datagen, evaluate, stream):
    OPERATORS |= _group.OPS


def apply(spark: SparkSession, key: str, **inputs: DataFrame) -> DataFrame:
    if key in pairs.WAYS:
        return pairs.run(spark, key, inputs)
    if key in judged.WAYS:
        return judged.WAYS[key](spark, inputs)
    if key in tagged.WAYS:
        return tagged.WAYS[key](spark, key, inputs)
    return plans.run(spark, OPERATORS[key], VIEWS, inputs)


def from_tables(spark: SparkSession, key: str, sf_dir: str) -> DataFrame:
    return apply(spark, key, **plans.tables(spark, sf_dir, plans.complete(OPERATORS[key], VIEWS)))


def oracle(key: str) -> str:
    return plans.other_text(plans.complete(OPERATORS[key], VIEWS))
