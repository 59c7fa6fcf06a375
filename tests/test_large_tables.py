"""What only shows on tables larger than those of the other tests: long keys, many rules of one kind."""

from pyspark.sql import functions as F

from rulewright import operators
from rulewright.operators import judged
from rulewright.plans import sql as plans
from rulewright.sources.adapters import VIEWS


def _view(spark, name, **inputs):
    return plans.run(spark, f"SELECT * FROM {name}", VIEWS, inputs)


def test_rules_of_long_keys_have_ids_of_their_own(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    long = part.unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 1_000_000)).unionByName(part.withColumn("p_partkey", (F.col("p_partkey") + 1) * 1_000_000))
    for name in ("rules", "new_rules"):
        rules = _view(spark, name, part=long.distinct())
        assert rules.select("rule_id").distinct().count() == rules.select("rule_no").distinct().count()
    assert _view(spark, "rules", part=long).where("rule_no = 1000020").first()["rule_id"] == "R1000020"
    assert _view(spark, "rules", part=long).where("rule_no = 20").first()["rule_id"] == "R000020"
    met = _view(spark, "known_conflicts", part=long).where("first_id = 'R1000019'").first()
    assert met["second_id"] == "R1000020"
    assert _view(spark, "new_conditions", part=long).where("rule_id = 'N1000020'").count() == _view(spark, "conditions", part=long).where("rule_id = 'R1000020'").count() > 0


def _many(spark, sf):
    """Rules of few kinds, 40 of each in one term; some ids stand for two rules."""
    rules = _view(spark, "rules", part=spark.read.parquet(f"{sf}/part.parquet")).where("rule_no IN (8, 20, 100, 120)").withColumns({"workspace_id": F.lit("w"), "domain_id": F.lit("d"), "business_term": F.lit("t")})
    many = rules.crossJoin(spark.range(40)).withColumns({"rule_no": F.col("rule_no") * 100 + F.col("id"), "rule_id": F.concat("rule_id", F.lit("/"), (F.col("id") % 38).cast("string"))}).drop("id")
    held = many.select("rule_id", "workspace_id", "domain_id", F.lit(0).alias("pos"), F.lit("orders.status").alias("field"), F.when(F.col("rule_no") < 2000, "equals").otherwise("not_equals").alias("operator"), F.lit("open").alias("value")).distinct()
    new = many.where("rule_no % 3 = 0").withColumn("scope", F.when(F.col("rule_no") % 2 == 0, "departmental").otherwise(F.col("scope")))
    return {"new_rules": new, "rules": many, "conditions": held, "new_conditions": held, "new_candidates": spark.createDataFrame([], "rule_id string, pos int, text string")}


def test_judgements_by_classes_are_those_of_all_pairs(spark, sf):
    given = _many(spark, sf)
    rows = lambda df: sorted(str(tuple(r)) for r in df.collect())
    for key in judged.WAYS:
        assert rows(operators.apply(spark, key, **given)) == rows(plans.run(spark, operators.OPERATORS[key], VIEWS, given)), key


def test_pairs_grow_with_classes_not_with_rules(spark, sf):
    given = _many(spark, sf)
    n_new, n_old = given["new_rules"].count(), given["rules"].count()
    assert operators.apply(spark, "sim_08_relationship", **given).count() <= 8 * 4 < n_new * n_old
    labels, classes = operators.apply(spark, "evl_08_pair_labels", **given).collect(), operators.apply(spark, "evl_08_classes", **given).collect()
    assert len(labels) <= 16 and sum(r.n_1 for r in labels if r.id_1 == r.id_2) == n_old == len(classes)
    assert {r.id_1 for r in labels} == {r.first_id for r in classes}


def test_rollup_names_first_rules_and_counts_all(spark, sf):
    given = _many(spark, sf)
    got, firsts = operators.apply(spark, "sim_14_conflict_rollup", **given).collect(), {r.first_id for r in operators.apply(spark, "sim_07_classes", **given).where("side = 'old'").collect()}
    assert got and all(set(r.conflicting.split(",")) <= firsts for r in got if r.conflicting)
    assert max(r.n_direct + r.n_potential for r in got) > 40 > max(len((r.conflicting or "").split(",")) for r in got)
