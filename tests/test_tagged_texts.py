"""ext_20_normalise_components answers each distinct text once, and gives the answer to all records that have it."""

from rulewright import operators
from rulewright.operators import tagged
from rulewright.plans import sql as plans
from rulewright.sources.adapters import VIEWS


def test_same_as_sql_for_repeated_texts_and_ids(spark, monkeypatch):
    texts = ["Revenue should exclude status equals open above 100", "Only include customers where status is active", "", None, "revenue  above 7"]
    rows = [(i, texts[i % 5], ("ecommerce", "support", None)[i % 3], f"R{i % 4}") for i in range(40)]
    rows += [(3, texts[1], "ecommerce", "R1"), (None, texts[0], "ecommerce", "R1"), (41, texts[1], "ecommerce", "none"), (42, texts[1], "ecommerce", None)]
    records = spark.createDataFrame(rows, "feedback_id long, feedback_text string, domain string, rule_id string")
    named = [(f"R{i}", p, k, m) for i in (0, 1, 2) for p, k, m in ((1, "BUSINESS_TERM", "revenue"), (2, "FIELD", "status"), (4, "VALUE", "open" if i else "active"), (5, "OPERATION", "exclude"))]
    given = {"records": records, "rule_mentions": spark.createDataFrame(named, "rule_id string, priority int, label string, mention string")}
    ran = []
    monkeypatch.setattr(tagged, "_run", lambda s, k, g, run=tagged._run: ran.append(g["records"].count()) or run(s, k, g))
    told = lambda df: sorted(str(tuple(r)) for r in df.collect())
    got = told(operators.apply(spark, "ext_20_normalise_components", **given))
    assert got == told(plans.run(spark, operators.OPERATORS["ext_20_normalise_components"], VIEWS, given)) and len(got) >= 20
    assert ran[0] < 35 and ran[1:] == [2]
