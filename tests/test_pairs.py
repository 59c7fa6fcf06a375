from pyspark.sql import functions as F

from rulewright import operators
from rulewright.operators import pairs
from rulewright.plans import sql as plans
from rulewright.sources.adapters import VIEWS


def _inputs(spark, sf):
    """Rules of two kinds in one term, each many times over, some ids for several rules."""
    rules = plans.run(spark, "SELECT * FROM rules", VIEWS, plans.tables(spark, sf, "part"))
    one = rules.where("rule_no IN (8, 20)").withColumns({"workspace_id": F.lit("w"), "domain_id": F.lit("d"), "business_term": F.lit("t")})
    many = one.crossJoin(spark.range(30)).withColumns({"rule_no": F.col("rule_no") * 100 + F.col("id"), "rule_id": F.concat("rule_id", F.lit("/"), (F.col("id") % 28).cast("string"))}).drop("id")
    held = many.select("rule_id", "workspace_id", "domain_id", F.lit(0).alias("pos"), F.lit("orders.status").alias("field"), F.when(F.col("rule_no") < 2000, "equals").otherwise("not_equals").alias("operator"), F.lit("open").alias("value")).distinct()
    none = spark.createDataFrame([], "rule_id string, pos int, text string")
    return {"new_rules": many.where("rule_no % 3 = 0"), "rules": many, "conditions": held, "new_conditions": held, "new_candidates": none}


def _rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_rules_alike_are_one_class(spark, sf):
    classes = pairs.Classes(spark, _inputs(spark, sf))
    assert (classes.new.count(), classes.old.count(), classes.reps["met"].count()) == (2, 2, 4)


def test_same_as_sql_when_ids_repeat(spark, sf):
    given = _inputs(spark, sf)
    for key in ("sim_08_relationship", "sim_09_best_match", "sim_15_comparisons", "sim_14_recommendations"):
        assert _rows(operators.apply(spark, key, **given)) == _rows(plans.run(spark, operators.OPERATORS[key], VIEWS, given)), key


def test_profiles_say_what_pairs_of_classes_get(spark, sf):
    """Rules of the same facts in many terms: facts are compared once for all terms, and no row of a pair holds a class's rules."""
    one = _inputs(spark, sf)
    spread = lambda rows: rows.crossJoin(spark.range(6).withColumnRenamed("id", "g")).withColumn("rule_id", F.concat("rule_id", F.lit("/t"), F.col("g").cast("string")))
    given = {k: spread(v).withColumn("business_term", F.concat(F.lit("t"), F.col("g").cast("string"))).drop("g") if k.endswith("rules") else spread(v).drop("g") for k, v in one.items()}
    classes = pairs.Classes(spark, given)
    assert (classes.new.count(), classes.old.count(), classes.met.count()) == (12, 12, 4)
    told = classes.conflicts("kind", "confidence")
    assert told.count() == 24 and told.agg(F.max(F.size("new_members"))).first()[0] == 1
    for key in ("sim_14_conflict_rollup",):
        assert _rows(operators.apply(spark, key, **given)) == _rows(plans.run(spark, operators.OPERATORS[key], VIEWS, given)), key


def test_groups_of_many_new_classes_meet_in_parts(spark, sf, monkeypatch):
    given = _inputs(spark, sf)
    whole = {key: _rows(operators.apply(spark, key, **given)) for key in ("sim_13_conflict",)}
    monkeypatch.setattr(pairs, "PART", 1)
    assert whole == {key: _rows(operators.apply(spark, key, **given)) for key in whole}
