"""Readers and writers of the file formats around the tables, and a scratch folder that executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path under spark.checkpoint.dir; only where that is unset (one machine) under a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def read_json_lines(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the text of lines that don't parse. Blank lines are skipped."""
    kept = StructType([*schema.fields, StructField("_bad", StringType())])
    # parsed from text, as the JSON source doesn't answer queries for bad lines alone
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return lines.where("r._bad is null").select("r.*").drop("_bad"), lines.where("r._bad is not null").select(F.col("value").alias("line"))


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """term, definition and references of glossary documents: a block per heading of level 3."""
    blocks = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "(?m)^### ")).alias("pos", "block")).where("pos > 0")
    return blocks.select(
        F.trim(F.regexp_extract("block", "^([^\n]+)", 1)).alias("term"), F.trim(F.regexp_extract("block", r"(?i)definition[:*\s]+([^\n]+)", 1)).alias("definition"),
        F.array_distinct(F.regexp_extract_all("block", F.lit("`([a-z_]+[.][a-z_]+)`"), 1)).alias("refs"), F.col("pos").cast("int"),
    )


def write_splits(records: DataFrame, path: str, keep_internal: bool = False) -> None:
    """Records as JSON lines in a folder per split; columns that start with _ are internal."""
    columns = [c for c in records.columns if keep_internal or not c.startswith("_")]
    records.select(*columns).write.partitionBy("split").json(path)


def write_dataset(records: DataFrame, path: str) -> None:
    """Records (with split and _reason, which is null for those that are accepted) as a dataset: accepted ones by split without
    their internal columns, rejected ones with them, and last a manifest of how many records each part holds. A dataset
    without a manifest isn't finished."""
    write_splits(records.where("_reason is null"), f"{path}/accepted")
    records.where("_reason is not null").write.json(f"{path}/rejected")
    part = F.when(F.col("_reason").isNull(), F.concat(F.lit("accepted/"), "split")).otherwise("rejected")
    records.groupBy(part.alias("part")).agg(F.count("*").alias("n")).coalesce(1).write.json(f"{path}/manifest")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """part, n (records found), n_listed (in the manifest), has_internal of each part of a dataset."""
    parts = []
    for name, split in (("accepted", True), ("rejected", False)):
        rows = spark.read.text(f"{path}/{name}")
        part = F.concat(F.lit("accepted/"), "split") if split else F.lit(name)
        internal = F.exists(F.json_object_keys("value"), lambda k: k.startswith("_"))
        parts.append(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.max(internal).alias("has_internal")))
    listed = spark.read.schema("part string, n bigint").json(f"{path}/manifest").withColumnRenamed("n", "n_listed")
    return parts[0].unionByName(parts[1]).join(listed, "part", "full")


class VectorIndex:
    """Hashed term vectors of texts by id, kept as what each refresh changed; the last change of an id counts."""

    def __init__(self, spark: SparkSession, path: str, features: int = 1 << 12):
        self.spark, self.path, self.features = spark, path, features

    def _versions(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException:  # nothing has been written yet
            return None

    def current(self, versions: DataFrame) -> DataFrame:
        """rule_id, hash and vector of every id that is not removed."""
        last = F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("version")))
        return versions.withColumn("_rn", last).where("_rn = 1 and action <> 'removed'").select("rule_id", "hash", "vector")

    def refresh(self, texts: DataFrame) -> DataFrame:
        """Bring the index to texts (rule_id, text; ids are unique): rule_id and action (inserted, updated, removed) of what
        was written, which is only what changed. Vectors are made for changed texts alone."""
        versions = self._versions()
        last = None if versions is None else versions.agg(F.max("version")).first()[0]
        n = 0 if last is None else last + 1
        now = texts.select("rule_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("new_hash"))
        if versions is None:
            found = now.withColumn("action", F.lit("inserted"))
        else:
            both = now.join(self.current(versions).drop("vector"), "rule_id", "full")
            action = F.when(F.col("hash").isNull(), "inserted").when(F.col("new_hash").isNull(), "removed").when(F.col("hash") != F.col("new_hash"), "updated")
            found = both.withColumn("action", action).where("action is not null")
        words = found.withColumn("words", F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\pL\pN_.]+"), lambda w: w != ""))
        made = Normalizer(inputCol="tf", outputCol="vector").transform(HashingTF(inputCol="words", outputCol="tf", numFeatures=self.features).transform(words))
        made.select("rule_id", "action", F.col("new_hash").alias("hash"), "vector").write.mode("overwrite").parquet(f"{self.path}/version={n}")
        return self.spark.read.parquet(f"{self.path}/version={n}").select("rule_id", "action")


def upsert(stored: DataFrame, new: DataFrame, key: str, refresh: list[str]) -> DataFrame:
    """stored with new rows added and the named columns of known rows refreshed; other columns keep their values."""
    old, fresh = stored.alias("o"), new.alias("n")
    value = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in refresh else F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None))
    return old.join(fresh, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*(value(c).alias(c) for c in stored.columns))
