"""Queries that write files or tables and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rulewright import operators
from rulewright.plans import sql as plans
from rulewright.sources import files
from rulewright.sources.adapters import VIEWS

from .datagen import OPS as DATASETS

_VIEWS = VIEWS | {
    name: plans.View(name, text)
    for name, text in {
        # lines as a careless client sends them: some are cut off, some are blank
        "sent_lines": """
SELECT event_id, CASE WHEN event_id % 10 = 3 THEN substring(line, 1, length(line) - 5) WHEN event_id % 17 = 0 THEN ' ' ELSE line END AS line FROM (
  SELECT event_id, concat('{"event_id": ', CAST(event_id AS STRING), ', "event_type": "', event_type, '", "user_id": ', CAST(user_id AS STRING), '}') AS line FROM events) e""",
        "judged_records": f"""
SELECT r.feedback_id, r.feedback_text, r.feedback_type, r.rule_family_id, s.split, CASE WHEN trim(r.feedback_text) = '' THEN 'empty' WHEN r.feedback_type = 'irrelevant_spam' THEN 'spam' WHEN r.requires_clarification THEN 'unclear' END AS reason
FROM records r JOIN ({DATASETS["gen_12_split_by_size"]}) s ON s.feedback_id = r.feedback_id""",
        "index_before": f"SELECT rule_id, spaced AS text FROM ({operators.OPERATORS['sim_01_canonical_text']}) t",
        # every tenth rule is changed, every tenth is gone, and some are new
        "index_after": """
SELECT rule_id, CASE WHEN substring(rule_id, 7, 1) = '0' THEN concat(text, ' revised') ELSE text END AS text FROM index_before WHERE substring(rule_id, 7, 1) <> '1' UNION ALL SELECT concat('Z', substring(rule_id, 2, 6)), text FROM index_before WHERE substring(rule_id, 7, 1) = '2'""",
    }.items()
}


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = f"SELECT * FROM {name}"
    return plans.run(spark, text, _VIEWS, plans.tables(spark, sf_dir, plans.complete(text, _VIEWS)))


def src_01_corrupt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written to files and read as JSON: good rows, and the text of lines that don't parse; blank lines are no lines."""
    at = files.scratch(spark, "lines")
    _view(spark, sf_dir, "sent_lines").select("line").write.text(at)
    schema = StructType([StructField("event_id", LongType()), StructField("event_type", StringType()), StructField("user_id", LongType())])
    good, bad = files.read_json_lines(spark, at, schema)
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return good.select(F.lit("good").alias("outcome"), *good.columns, F.lit(None).cast("string").alias("line")).unionByName(bad.select(F.lit("bad").alias("outcome"), *none, "line"))


def src_09_written_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as a dataset of splits and rejects with its manifest, read back."""
    at = files.scratch(spark, "dataset")
    files.write_dataset(_view(spark, sf_dir, "judged_records").withColumnRenamed("reason", "_reason"), at)
    return files.read_dataset(spark, at)


def sim_02_changed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second refresh of the vector index of the rules' texts writes."""
    index = files.VectorIndex(spark, files.scratch(spark, "vectors"))
    index.refresh(_view(spark, sf_dir, "index_before"))
    return index.refresh(_view(spark, sf_dir, "index_after"))


def _oracle(text: str) -> str:
    return plans.other_text(plans.complete(text, _VIEWS))


QUERIES = {"src_01_corrupt_lines": src_01_corrupt_lines, "src_09_written_dataset": src_09_written_dataset, "sim_02_changed_only": sim_02_changed_only}
ORACLES = {
    "src_01_corrupt_lines": _oracle("SELECT CASE WHEN event_id % 10 = 3 THEN 'bad' ELSE 'good' END AS outcome, CASE WHEN event_id % 10 <> 3 THEN event_id END AS event_id, CASE WHEN event_id % 10 <> 3 THEN JSON(line, event_type) END AS event_type, CASE WHEN event_id % 10 <> 3 THEN CAST(JSON(line, user_id) AS BIGINT) END AS user_id, CASE WHEN event_id % 10 = 3 THEN line END AS line FROM sent_lines WHERE trim(line) <> ''"),
    "src_09_written_dataset": _oracle("SELECT part, count(*) AS n, count(*) AS n_listed, part = 'rejected' AS has_internal FROM (SELECT CASE WHEN reason IS NULL THEN concat('accepted/', split) ELSE 'rejected' END AS part FROM judged_records) p GROUP BY part"),
    "sim_02_changed_only": _oracle("SELECT coalesce(b.rule_id, a.rule_id) AS rule_id, CASE WHEN b.rule_id IS NULL THEN 'inserted' WHEN a.rule_id IS NULL THEN 'removed' ELSE 'updated' END AS action FROM index_before b FULL OUTER JOIN index_after a ON a.rule_id = b.rule_id WHERE b.rule_id IS NULL OR a.rule_id IS NULL OR a.text <> b.text"),
}
