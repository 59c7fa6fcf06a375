from rulewright.operators import learn


def test_each_distinct_text_is_answered_once_and_every_row_stays(spark, monkeypatch):
    texts = ["exclude refunds", "what is churn", None, ""]
    rows = [(f"F{i}", texts[i % 4], ["business_rule", "question", None, None][i % 4], ["filter_rule", None, None, None][i % 4]) for i in range(40)]
    records, answered, kept = spark.createDataFrame(rows, "feedback_id string, feedback_text string, feedback_type string, rule_category string"), [], learn._kept
    monkeypatch.setattr(learn, "_kept", lambda frame, tag: answered.append((tag, frame.count())) or kept(frame, tag))
    found = learn.predict(learn.train(records, 64), records)
    assert answered == [("features", 40), ("told", 4)]
    assert sorted(r.feedback_id for r in found.collect()) == sorted(r[0] for r in rows)
    assert {r.predicted_type for r in found.where("feedback_text = 'what is churn'").collect()} == {"question"}
