"""Dataset building that SQL texts in datagen only do in part: families of duplicates, top-up to a floor, downsampling to a share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulewright import operators

from .datagen import FLOOR, WRAPPERS
from .fuzzy import view

#: The share of tokens without a label that downsampling leaves.
O_SHARE = 0.7


def duplicate_families(records: DataFrame) -> DataFrame:
    """A row per record of a family of two or more: feedback_id, rule_family_id, n, representative (the one of least record_no).

    Any two rows of a family are duplicates of each other, so n rows stand for its n * (n - 1) / 2 pairs.
    """
    known = records.where("rule_family_id <> ''").select("feedback_id", "rule_family_id", "record_no")
    families = known.groupBy("rule_family_id").agg(F.count("*").alias("n"), F.min(F.struct("record_no", "feedback_id")).alias("first")).where("n > 1")
    return known.join(families, "rule_family_id").select("feedback_id", "rule_family_id", "n", F.col("first.feedback_id").alias("representative"))


def representative_pairs(records: DataFrame) -> DataFrame:
    """One pair per record but the representative of its family; they link all of a family."""
    rows = duplicate_families(records).where("feedback_id <> representative")
    return rows.select(F.concat_ws("-", "representative", "feedback_id").alias("pair_id"), F.col("representative").alias("feedback_id_1"), F.col("feedback_id").alias("feedback_id_2"), "rule_family_id", F.lit("duplicate").alias("relationship"))


def top_up(records: DataFrame, floor: int = FLOOR) -> DataFrame:
    """What each class lacks to the floor: feedback_type, n, need, place (from 0), feedback_id of the seed, feedback_text.

    Seeds (ranked by md5) go round, with the next wrapper each round. Only classes under the floor are ranked, so a
    class has fewer than `floor` rows there. A class without any text gets nothing.
    """
    lacking = records.groupBy("feedback_type").agg(F.count("*").alias("n"), F.count_if(F.rtrim("feedback_text") != "").alias("n_seeds")).where(F.col("n") < floor).where("n_seeds > 0")
    place = F.row_number().over(Window.partitionBy("feedback_type").orderBy(F.md5("feedback_id"), "feedback_id")) - 1
    seeds = records.where(F.rtrim("feedback_text") != "").join(F.broadcast(lacking.select("feedback_type")), "feedback_type").select("feedback_type", "feedback_id", "feedback_text", place.alias("seed"))
    wanted = lacking.withColumn("need", floor - F.col("n")).withColumn("place", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("need") - 1)))
    wanted = wanted.withColumn("seed", F.expr("place % n_seeds")).withColumn("wrapper", F.expr(f"(place div n_seeds) % {len(WRAPPERS)}"))
    wrapper = F.element_at(F.array(*map(F.lit, WRAPPERS)), (F.col("wrapper") + 1).cast("int"))
    return wanted.join(seeds, ["feedback_type", "seed"]).select("feedback_type", "n", "need", "place", "feedback_id", F.replace(wrapper, F.lit("{text}"), F.rtrim("feedback_text")).alias("feedback_text"))


def downsample(tokens: DataFrame, share: float = O_SHARE) -> DataFrame:
    """All labelled tokens, and as many of label O (by md5 of feedback_id and pos) as make O `share` of what stays; all if it has less."""
    counted = tokens.agg(F.count_if(F.col("label") == "O").alias("n_o"), F.count_if(F.col("label") != "O").alias("n_other"))
    rate = counted.select((F.col("n_other") * (share / (1 - share)) / F.greatest("n_o", F.lit(1))).alias("rate"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("/", "feedback_id", "pos")), 1, 8), 16, 10).cast("double") / 2.0**32
    return tokens.crossJoin(F.broadcast(rate)).where((F.col("label") != "O") | (drawn < F.col("rate"))).select(*tokens.columns)


def gen_15_duplicate_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_families(view(spark, sf_dir, "records"))


def gen_15_representative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representative_pairs(view(spark, sf_dir, "records"))


def gen_07_top_up_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = view(spark, sf_dir, "records")
    largest = records.groupBy("feedback_type").count().agg(F.max("count")).first()[0] or 0
    return top_up(records, max(FLOOR, largest // 2))


def gen_19_downsample_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return downsample(operators.from_tables(spark, "gen_18_token_labels", sf_dir))


QUERIES = {"gen_15_duplicate_families": gen_15_duplicate_families, "gen_15_representative_pairs": gen_15_representative_pairs, "gen_07_top_up_floor": gen_07_top_up_floor, "gen_19_downsample_share": gen_19_downsample_share}
_TOKENS = operators.oracle("gen_18_token_labels")
_PLACE = "CAST(concat('0x', substring(md5(concat(CAST(feedback_id AS VARCHAR), '/', CAST(pos AS VARCHAR))), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE)"
ORACLES = {
    "gen_15_duplicate_families": f"SELECT feedback_id, rule_family_id, n, representative FROM ({operators.oracle('gen_15_duplicate_pairs')})",
    "gen_15_representative_pairs": f"SELECT concat(representative, '-', feedback_id) AS pair_id, representative AS feedback_id_1, feedback_id AS feedback_id_2, rule_family_id, 'duplicate' AS relationship FROM ({operators.oracle('gen_15_duplicate_pairs')}) WHERE feedback_id <> representative",
    "gen_07_top_up_floor": operators.oracle("gen_07_top_up").replace("SELECT feedback_type, n, need, seed + tok * n AS place", "SELECT feedback_type, n, need, CAST(seed + tok * n AS BIGINT) AS place"),
    "gen_19_downsample_share": f"WITH t_ AS ({_TOKENS}) SELECT t.* FROM t_ t CROSS JOIN (SELECT count_if(label <> 'O') * {O_SHARE / (1 - O_SHARE)!r} / greatest(count_if(label = 'O'), 1) AS rate FROM t_) r WHERE t.label <> 'O' OR {_PLACE} < r.rate",
}
