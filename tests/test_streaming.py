"""Streams against their batch forms: files in any order, batches that are run twice, late rows."""

import datetime as dt

from pyspark.sql import functions as F

from rulewright.plans import sql as plans
from rulewright.streaming import job, live
from test_operators import rows

FEEDBACK = "feedback_id long, workspace_id string, created_at timestamp, submitted_by long, feedback_text string"
TEXTS = ["Revenue should exclude cancelled orders above 100", "Only include customers where status is active", "What is the definition of churn?", "The report page is broken", "asdf qwer zxcv tyui", "Only include customers where status is active and colour is red", " ", None, "x" * 10_001]


def some_feedback(spark):
    data = [(i, "w", dt.datetime(2024, 1, 1, 0, i), 1, t) for i, t in enumerate(TEXTS)] + [(0, "w", dt.datetime(2024, 1, 2), 1, "sent twice"), (None, "w", None, 1, "no id"), (50, None, None, 1, "no workspace")]
    return spark.createDataFrame(data, FEEDBACK)


def batch_form(spark, feedback, name):
    return plans.run(spark, f"SELECT * FROM {name}", job.JOB, {"feedback": feedback})


def test_a_batch_that_is_run_twice_changes_nothing(spark, tmp_path):
    feedback = some_feedback(spark)
    done = job.FeedbackJob(spark, str(tmp_path / "job"))
    for _ in range(2):
        done.step(feedback, 0)
        for name in job.TABLES:
            assert rows(done.table(name).toPandas()) == rows(batch_form(spark, feedback, name).toPandas()), name
    assert [tuple(r) for r in done.progress().collect()] == [(0, 12, 6, 6, 6, done.table("extracted").count(), 6, done.table("routed").count())]
    reasons = {(r.feedback_id, r.reason) for r in done.table("failed").collect()}
    assert reasons == {(6, "empty_text"), (7, "empty_text"), (8, "too_long"), (0, "repeated_id"), (None, "missing_id"), (50, "missing_workspace")}
    status = {r.feedback_id: r.schema_status for r in done.table("validated").collect()}
    assert status[1] == "PASS" and status[5] == "PARTIAL" and status[2] == "N/A"


def test_an_unfinished_batch_is_not_read(spark, tmp_path):
    done = job.FeedbackJob(spark, str(tmp_path / "job"))
    done.step(some_feedback(spark), 0)
    before = done.table("classified").count()
    done.table("classified").limit(2).write.parquet(str(tmp_path / "job/classified/batch=1"))
    assert done.table("classified").count() == before


def test_files_in_several_batches_and_a_second_run(spark, tmp_path):
    feedback, at = some_feedback(spark).where("feedback_id < 9").dropDuplicates(["feedback_id"]), str(tmp_path / "in")
    for i in range(3):
        feedback.where(F.col("feedback_id") % 3 == i).coalesce(1).write.mode("append").parquet(at)
    stream = lambda: spark.readStream.schema(feedback.schema).option("maxFilesPerTrigger", 1).parquet(at)
    done = job.FeedbackJob(spark, str(tmp_path / "job")).run(stream())
    assert done.progress().count() == 3
    done.run(stream())
    for name in ("failed", "classified", "extracted", "routed"):
        assert rows(done.table(name).toPandas()) == rows(batch_form(spark, feedback, name).toPandas()), name


def event_files(spark, tmp_path, parts):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    for part in parts:
        data = [(i, t, u, e, 1.0, f'{{"k": {k}}}') for i, t, u, e, k in part]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def hour(h, m=0, s=0):
    return dt.datetime(2024, 1, 1, h, m, s)


def test_exactly_the_limit_is_accepted_in_the_order_of_time(spark, tmp_path):
    """Files are not in the order of time; of equal times the smaller event counts first."""
    late = [(i, hour(1, 30, i), 1, "view", i) for i in range(30, 40)]
    early = [(i, hour(1, 10, i), 1, "view", i) for i in range(10)] + [(90, hour(1, 10, 3), 1, "view", 3), (91, hour(2), 1, "view", 0), (92, hour(1, 5), 2, "view", 0), (93, hour(1, 5), 2, "click", 0)]
    folder = event_files(spark, tmp_path, [late, early])
    step = lambda s: live.limited(s.select(F.col("event_type").alias("policy"), F.col("user_id").alias("subject"), "ts", "event_id"), {"view": 5}, late="3 hours")
    found, dropped = live.settle(spark, folder, step)
    assert dropped == 0 and sorted((r.policy, r.subject, r.window_start.hour, r.event_id, r.place, r.n) for r in found.collect()) == [
        ("view", 1, 1, 0, 1, 21), ("view", 1, 1, 1, 2, 21), ("view", 1, 1, 2, 3, 21), ("view", 1, 1, 3, 4, 21), ("view", 1, 1, 90, 5, 21), ("view", 1, 2, 91, 1, 1), ("view", 2, 1, 92, 1, 1)]


def test_late_requests_are_counted_and_change_nothing(spark, tmp_path):
    folder = event_files(spark, tmp_path, [[(1, hour(1), 1, "view", 0)], [(2, hour(20), 1, "view", 0)], [(3, hour(21), 1, "view", 0)], [(4, hour(1, 1), 1, "view", 0), (5, hour(21), 1, "view", 0)]])
    step = lambda s: live.limited(s.select(F.col("event_type").alias("policy"), F.col("user_id").alias("subject"), "ts", "event_id"), {"view": 5})
    found, dropped = live.settle(spark, folder, step)
    ids = {r.event_id for r in found.collect()}
    assert ids | {4} == {1, 2, 3, 4, 5} and dropped == (4 not in ids)


def test_the_earliest_request_of_a_key_is_kept_and_keys_are_forgotten(spark, tmp_path):
    parts = [[(7, hour(3), 0, "view", 1), (8, hour(2, 59), 0, "view", 1)], [(1, hour(2), 5, "view", 1), (2, hour(2), 5, "view", 2), (3, hour(4), 1, "view", 1)], [(9, hour(12), 0, "view", 1), (10, hour(12, 1), 0, "view", 1)]]
    folder = event_files(spark, tmp_path, parts)
    pick = lambda s: s.select((F.col("user_id") % 5).alias("tenant"), F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1)).alias("request_key"), "ts", "event_id")
    found, _ = live.settle(spark, folder, lambda s: live.accepted(pick(s), keep=10**7, late="20 hours"), 3)
    assert sorted(tuple(r) for r in found.where("event_id > 0").collect()) == [(0, 1, 1), (0, 2, 2), (1, 1, 3)]
