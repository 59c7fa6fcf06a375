"""From raw documents to training sequences: each stage works on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
run() writes each stage's result as Parquet in the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.llm import common, langid, mixing, neardup, packing, pii

#: A document goes if it has no letter or if its n-grams fit no learned language better than this.
MIN_LANGUAGE_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too) and those that fit no language go; repeated rows are judged alike."""
    common.small_batches(spark)
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.identify(docs.withColumn("_row", F.struct(*docs.columns)), model)
    # without a single labelled document nothing is learned, and only texts without a letter can be told apart
    bad = (F.col("lang_pred") == "und") | (F.col("score") < MIN_LANGUAGE_SCORE) if model.languages else ~F.coalesce(F.col("_row.text"), F.lit("")).rlike(r"\p{L}")
    return found.where(~bad).select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal or near-equal texts stays; rows without an id or a word all do."""
    common.small_batches(spark)
    return neardup.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kinds in brackets, n_chars follows; every row stays, a null text as null."""
    common.small_batches(spark)
    masked = pii.mask(docs, pii.train(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the budget of each domain, language and source takes; null columns are groups of their own, repeated rows are read each."""
    common.small_batches(spark)
    return mixing.select_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary length of every row; a null or empty text has its end id alone."""
    common.small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixture", mixture), ("pack", pack)]

#: Models, signatures and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
