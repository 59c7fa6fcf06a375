"""Queries of rule pairs return every pair of rules, however many are alike."""

import pytest
from pyspark.sql import functions as F

from rulewright import operators
from rulewright.operators import fuzzy, pairs
from rulewright.plans import sql as plans
from rulewright.sources.adapters import VIEWS

N = 7


def _given(spark, sf, old_term="net revenue"):
    """N new and N old rules of either of two kinds, in one group; kinds differ in operation, and their conditions contradict."""
    rules = plans.run(spark, "SELECT * FROM rules", VIEWS, plans.tables(spark, sf, "part")).limit(1).drop("rule_no", "rule_id", "operation", "business_term", "scope")
    many = rules.crossJoin(spark.range(2 * N)).withColumns({"rule_no": F.col("id"), "operation": F.when(F.col("id") % 2 == 0, "include").otherwise("exclude"), "scope": F.lit("global"), "threshold": F.col("id") * 1.0}).drop("id")
    side = lambda letter, term: many.withColumns({"rule_id": F.concat(F.lit(letter), "rule_no"), "business_term": F.lit(term)})
    new, old = side("N", "net revenue"), side("R", old_term)
    held = lambda rows: rows.select("rule_id", "workspace_id", "domain_id", F.lit(0).alias("pos"), F.lit("orders.status").alias("field"), F.when(F.col("operation") == "include", "equals").otherwise("not_equals").alias("operator"), F.lit("open").alias("value"))
    return {"new_rules": new, "rules": old, "conditions": held(old), "new_conditions": held(new), "new_candidates": spark.createDataFrame([], "rule_id string, pos int, text string")}


ALL = {(f"N{n}", f"R{o}") for n in range(2 * N) for o in range(2 * N)}
UNLIKE = {(n, o) for n, o in ALL if (int(n[1:]) + int(o[1:])) % 2}
WANT = {
    "sim_15_comparisons": ALL,
    "sim_13_conflict": ALL,
    "sim_12_opposed": ALL,
    "sim_11_contradictions": UNLIKE,
    "sim_08_relationship": ALL,
    "sim_07_pair_features": ALL,
}


def _told(rows):
    rows = rows.selectExpr("split(comparison_id, '-')[0] AS new_id", "split(comparison_id, '-')[1] AS old_id") if "new_id" not in rows.columns else rows
    return sorted((r.new_id, r.old_id) for r in rows.collect())


@pytest.mark.parametrize("key", WANT)
def test_every_pair_is_there(spark, sf, monkeypatch, key):
    given = _given(spark, sf)
    assert _told(operators.apply(spark, key, **given)) == sorted(WANT[key])
    monkeypatch.setattr(pairs, "RUN", 3)
    rows = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert rows(operators.apply(spark, key, **given)) == rows(plans.run(spark, operators.OPERATORS[key], VIEWS, given))


RATIO = {
    "sim_13_conflict": ALL,
    "sim_11_contradictions": UNLIKE,
}


@pytest.mark.parametrize("key", RATIO)
def test_every_pair_of_like_terms_is_there(spark, sf, key):
    given = _given(spark, sf, old_term="net revenues")
    assert _told(fuzzy.similar_rules(spark, key, given["new_rules"], given["rules"], **given)) == sorted(RATIO[key])


def test_rollup_names_every_rule_in_conflict(spark, sf, monkeypatch):
    monkeypatch.setattr(pairs, "RUN", 3)
    found = {r.new_id: r for r in operators.apply(spark, "sim_14_conflict_rollup", **_given(spark, sf)).collect()}
    assert {(n, o) for n, r in found.items() for o in r.conflicting.split(",")} == UNLIKE
    assert all(r.n_direct == len(r.conflicting.split(",")) == N for r in found.values())
