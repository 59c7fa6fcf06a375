"""EXT-20 on Spark, once for each distinct text. The SQL in tags says what it returns.

What a text's tokens come to depends on the text, its domain and what its rule can name. Records alike in these are one kind:
the SQL runs over one record of each kind, step by step, and its rows are given to all records of the kind. Records that share
an id meet each other's tokens, so they go through the SQL as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulewright.plans import sql as plans
from rulewright.sources.adapters import VIEWS

from .pairs import _kept
from .tags import OPS

_GIVEN = {*plans.BASE, "feedback", "rules", "records", "conditions", "rule_mentions", "catalog"}
#: Views that later ones read many times, in the order in which they need each other.
_STEPS = ("tagged_tokens", "tag_words", "tag_conditions", "tag_qualified", "tag_rules")


def _mentions(spark: SparkSession, records: DataFrame, inputs: dict[str, DataFrame]) -> DataFrame:
    """What the rules of records can name."""
    used = records.select("rule_id").distinct()
    of = lambda name: plans.run(spark, f"SELECT * FROM {name}", VIEWS, inputs).join(used, "rule_id", "left_semi")
    if "rule_mentions" in inputs:
        return of("rule_mentions")
    return plans.run(spark, "SELECT * FROM rule_mentions", VIEWS, {"rules": _kept(of("rules"), "rules"), "conditions": _kept(of("conditions"), "conditions")})


def _run(spark: SparkSession, key: str, given: dict[str, DataFrame]) -> DataFrame:
    for step in _STEPS:
        given[step] = _kept(plans.run(spark, f"SELECT * FROM {step}", VIEWS, given), step)
    return _kept(plans.run(spark, OPS[key], VIEWS, given), key)


def _by_text(spark: SparkSession, key: str, inputs: dict[str, DataFrame]) -> DataFrame:
    if set(inputs) - _GIVEN:
        return plans.run(spark, OPS[key], VIEWS, inputs)
    records = _kept(plans.run(spark, "SELECT feedback_id, feedback_text, domain, rule_id FROM records WHERE feedback_id IS NOT NULL", VIEWS, inputs), "records")
    more = {"rule_mentions": _kept(_mentions(spark, records, inputs), "mentions")} | {k: v for k, v in inputs.items() if k == "catalog"}
    named = more["rule_mentions"].groupBy("rule_id").agg(F.md5(F.to_json(F.array_sort(F.collect_list(F.struct("priority", "label", "mention"))))).alias("names"))
    kinds = records.join(named, "rule_id", "left").withColumn("kind", F.md5(F.to_json(F.struct("feedback_text", "domain", "names"))))
    kinds = _kept(kinds.withColumn("again", F.count("*").over(Window.partitionBy("feedback_id")) > 1), "kinds")
    alone, again = kinds.where("NOT again AND feedback_text IS NOT NULL"), kinds.where("again")
    one = _kept(alone.groupBy("kind").agg(F.min(F.struct("feedback_id", "feedback_text", "domain", "rule_id")).alias("r")).select("kind", "r.*"), "one")
    told = _run(spark, key, more | {"records": one.drop("kind")})
    rows = told.join(one.select("kind", "feedback_id"), "feedback_id").drop("feedback_id").join(alone.select("kind", "feedback_id"), "kind").select(told.columns)
    if again.isEmpty():
        return rows
    return rows.unionByName(_run(spark, key, more | {"records": again.select("feedback_id", "feedback_text", "domain", "rule_id")}))


#: Operators that run this way.
WAYS = {"ext_20_normalise_components": _by_text}
