"""Operators on the sequence ratio: always over distinct pairs, after exact bounds by length and shared characters."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulewright import operators
from rulewright.functions.text import char_tokens, normalise_unicode, ratio_bound, sequence_ratio
from rulewright.plans import sql as plans
from rulewright.sources.adapters import VIEWS

from . import pairs


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = f"SELECT * FROM {name}"
    return plans.run(spark, text, VIEWS, plans.tables(spark, sf_dir, plans.complete(text, VIEWS)))


def similar_terms(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """a, b, ratio of distinct terms (columns a and b) whose ratio is over `least` (0 to 1).

    A ratio over `least` needs over least * n / (2 - least) of a term's n characters in the other one, whatever its
    length. So two such terms share one of their first n - that + 1 tokens (a character and its occurrence) in any
    common order: terms are paired by those, rare ones first, and no pair over `least` is missed.
    """

    def keyed(terms: DataFrame, c: str) -> DataFrame:
        known = terms.select(c).where(F.col(c).isNotNull()).distinct().withColumn(f"t{c}", char_tokens(F.col(c)))
        n = F.size(f"t{c}")
        first = F.slice(f"t{c}", F.lit(1), n - F.greatest(F.ceil(n * (least / (2 - least)) - 1e-9), F.lit(1)).cast("int") + 1)
        return known.withColumn("key", F.explode(F.when(n > 0, first).otherwise(F.array(F.lit("")))))

    shared = 2.0 * F.size(F.array_intersect("ta", "tb")) / F.greatest(F.size("ta") + F.size("tb"), F.lit(1))
    near = (F.col("a") == F.col("b")) | ((ratio_bound(F.col("a"), F.col("b")) > least) & (shared > least))
    pairs = keyed(left, "a").join(keyed(right, "b"), "key").where(near).select("a", "b").distinct()
    return pairs.withColumn("ratio", sequence_ratio(F.col("a"), F.col("b"))).where(F.col("ratio") > least)


def txt_01_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.length(normalise_unicode(F.col("text"))).cast("long").alias("n_chars"), F.md5(normalise_unicode(F.col("text"))).alias("hash"))


#: What is taken off the end of a word before it is looked up.
ENDS = ".,!?;:"


def words_of(text: Column) -> Column:
    """The words of a text as they are looked up: between blanks, in lower case, without marks at the end."""
    return F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(F.lower(w), f"[{ENDS}]+$", ""))


def corrections(words: DataFrame, terms: DataFrame, least: float = 0.8) -> DataFrame:
    """token, correction, ratio of distinct words (column a) that are no term (column b) nor a plural of one: the nearest term,
    if its ratio is over `least`; of equal ratios the first by name. Short words and short terms count like any other."""
    terms = terms.select("b").where("b <> ''").distinct()
    known = words.select("a").where("a <> ''").distinct().join(terms.withColumnRenamed("b", "a").hint("merge"), "a", "left_anti")
    stem = lambda end, put, test=True: F.when(F.col("a").endswith(end) & F.lit(test), F.concat(F.expr(f"substring(a, 1, length(a) - {len(end)})"), F.lit(put)))
    bases = F.array_compact(F.array(stem("ies", "y"), stem("es", ""), F.when(~F.col("a").endswith("ss"), stem("s", ""))))
    plurals = known.select("a", F.explode(bases).alias("b")).where("b <> ''").join(terms.hint("merge"), "b").select("a")
    near = similar_terms(known.join(plurals.distinct().hint("merge"), "a", "left_anti"), terms, least)
    return near.groupBy("a").agg(F.min(F.struct((-F.col("ratio")).alias("far"), "b")).alias("best")).select(F.col("a").alias("token"), F.col("best.b").alias("correction"), (-F.col("best.far")).alias("ratio"))


def corrected(texts: DataFrame, terms: DataFrame, least: float = 0.8) -> DataFrame:
    """feedback_id, corrected and changes of texts (feedback_id, text): every word with a correction is replaced wherever it
    stands as a whole word, in any case, in the order in which words first occur. Null texts stay null; ids are unique."""
    placed = texts.select("feedback_id", F.posexplode(words_of(F.col("text"))).alias("pos", "token"))
    found = corrections(placed.select(F.col("token").alias("a")), terms, least)
    each = placed.join(found.hint("merge"), "token").groupBy("feedback_id", "token", "correction").agg(F.min("pos").alias("pos"))
    fixes = each.groupBy("feedback_id").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "correction"))).alias("fixes"))
    put = lambda t, f: F.regexp_replace(t, F.concat(F.lit(r"(?i)\b\Q"), f["token"], F.lit(r"\E\b")), F.regexp_replace(f["correction"], r"([\\$])", r"\\$1"))
    both = texts.join(fixes.hint("merge"), "feedback_id", "left").withColumn("fixes", F.coalesce("fixes", F.expr("cast(array() as array<struct<pos: int, token: string, correction: string>>)")))
    return both.select("feedback_id", F.aggregate("fixes", F.col("text"), put).alias("corrected"), F.array_join(F.transform("fixes", lambda f: F.concat(f["token"], F.lit("->"), f["correction"])), ",").alias("changes"))


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.from_tables(spark, "src_04_vocabulary", sf_dir).select(F.col("term").alias("b"))


def txt_04_fuzzy_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of all feedback that are no terms, how often each occurs, and its correction, if it has one."""
    words, terms = view(spark, sf_dir, "feedback").select(F.explode(words_of(F.col("feedback_text"))).alias("a")), _vocabulary(spark, sf_dir)
    counted = words.where("a <> ''").groupBy(F.col("a").alias("token")).agg(F.count("*").alias("n")).join(terms.select(F.col("b").alias("token")).distinct().hint("merge"), "token", "left_anti")
    return counted.join(corrections(words, terms).hint("merge"), "token", "left").select("token", "n", "correction", F.round("ratio", 6).alias("ratio"))


def txt_04_corrected_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All feedback, after the fixed corrections, with what is near a term put right in the text."""
    texts = operators.from_tables(spark, "txt_03_spelling", sf_dir).select("feedback_id", F.col("corrected").alias("text"))
    return corrected(texts, _vocabulary(spark, sf_dir))


def sim_06_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = view(spark, sf_dir, "rules").select("business_term").distinct()
    return similar_terms(terms.withColumnRenamed("business_term", "a"), terms.withColumnRenamed("business_term", "b"), 0.6).withColumn("ratio", F.round("ratio", 6))


#: Operators over rule pairs whose SQL pairs equal terms; each has a form beside it that pairs terms of ratio over 0.85.
RATIO_FORMS = ("sim_07_pair_features", "sim_08_relationship", "sim_09_best_match", "sim_11_contradictions", "sim_12_opposed", "sim_13_conflict", "sim_14_conflict_rollup", "sim_15_comparisons")


def similar_rules(spark: SparkSession, key: str, new_terms: DataFrame, old_terms: DataFrame, **inputs: DataFrame) -> DataFrame:
    """An operator of RATIO_FORMS over rule pairs whose terms (column business_term, null counts as empty) have a ratio over 0.85."""
    if key not in RATIO_FORMS:
        raise ValueError(f"{key} does not pair rules by term")
    term = F.lower(F.coalesce("business_term", F.lit("")))
    return pairs.run(spark, key, inputs, similar_terms(new_terms.select(term.alias("a")), old_terms.select(term.alias("b")), 0.85))


def _ratio_form(key: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = plans.tables(spark, sf_dir, plans.complete(operators.OPERATORS[key], VIEWS))
    return similar_rules(spark, key, view(spark, sf_dir, "new_rules"), view(spark, sf_dir, "rules"), **inputs)


def _profiles(rules: DataFrame, conditions: DataFrame, side: str) -> DataFrame:
    """rules with what a match looks at, each name with side before it: term, operation, column, fields of the conditions (sorted, repeats kept)."""
    fields = conditions.groupBy("rule_id").agg(F.sort_array(F.collect_list(F.lower(F.coalesce("field", F.lit(""))))).alias(f"{side}_fields"))
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    found = rules.join(fields, "rule_id", "left").withColumn(f"{side}_fields", F.coalesce(f"{side}_fields", F.array().cast("array<string>")))
    return found.select("rule_id", "rule_no", "workspace_id", text("business_term").alias(f"{side}_term"), text("operation").alias(f"{side}_operation"), F.col("affected_column").alias(f"{side}_column"), f"{side}_fields")


def _firsts(old: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n rules of each group by number: no other can be among the n best, as its score is that of its group."""
    return old.withColumn("_rn", F.row_number().over(Window.partitionBy("workspace_id", *keys).orderBy("rule_no"))).where(F.col("_rn") <= n).drop("_rn")


def _same_table() -> Column:
    return F.when(F.col("new_column") == F.col("old_column"), 1.0).otherwise(0.5)


def weighted_matches(new: DataFrame, new_conditions: DataFrame, old: DataFrame, old_conditions: DataFrame) -> DataFrame:
    """Best old rule per new rule of its workspace, with a score that isn't capped: new_id, workspace_id, rule_id, score; over 0.5 only.

    0.4 of a term ratio over 0.7, 0.3 for the operation or 0.2 of an operation ratio over 0.6, 0.2 of the entities, and
    0.1 for each condition of the new rule whose field is, holds or lies in a field of the old rule's conditions. Rules
    of one profile score alike, so distinct profiles are compared: with the term where its ratio counts, and without
    the term elsewhere, where the score doesn't depend on it.
    """
    n, o = _profiles(new, new_conditions, "new"), _profiles(old, old_conditions, "old")
    n_keys, o_keys = ["new_operation", "new_column", "new_fields"], ["old_operation", "old_column", "old_fields"]
    operations = similar_terms(n.select(F.col("new_operation").alias("a")).where("a <> ''"), o.select(F.col("old_operation").alias("b")).where("b <> ''"), 0.6)
    operations = F.broadcast(operations.select(F.col("a").alias("new_operation"), F.col("b").alias("old_operation"), F.col("ratio").alias("operation_ratio")))
    terms = similar_terms(n.select(F.col("new_term").alias("a")), o.select(F.col("old_term").alias("b")), 0.7).select(F.col("a").alias("new_term"), F.col("b").alias("old_term"), "ratio")
    held = F.filter("new_fields", lambda f: F.exists("old_fields", lambda g: F.contains(f, g) | F.contains(g, f)))
    alike = F.when(F.col("new_operation") == F.col("old_operation"), 0.3).otherwise(F.coalesce(0.2 * F.col("operation_ratio"), F.lit(0.0)))

    def best(pairs: DataFrame, keys: list[str]) -> DataFrame:
        scored = pairs.join(operations, ["new_operation", "old_operation"], "left").withColumn("score", F.coalesce(0.4 * F.col("ratio"), F.lit(0.0)) + alike + 0.2 * _same_table() + 0.1 * F.size(held))
        place = F.row_number().over(Window.partitionBy("workspace_id", *keys).orderBy(F.desc(F.round("score", 9)), "rule_no"))
        return scored.withColumn("_rn", place).where("_rn = 1 and score > 0.5 + 1e-9").select("workspace_id", *keys, F.col("rule_id").alias("old_id"), "rule_no", "score")

    old_ids = lambda keys: _firsts(o, keys, 1).select("workspace_id", *keys, "rule_id", "rule_no")
    with_term = n.select("workspace_id", "new_term", *n_keys).distinct().join(terms, "new_term").join(old_ids(["old_term", *o_keys]), ["workspace_id", "old_term"])
    without = n.select("workspace_id", *n_keys).distinct().join(old_ids(o_keys), "workspace_id").withColumn("ratio", F.lit(None).cast("double"))
    asked = n.select(F.col("rule_id").alias("new_id"), "workspace_id", "new_term", *n_keys)
    both = asked.join(best(with_term, ["new_term", *n_keys]), ["workspace_id", "new_term", *n_keys]).unionByName(asked.join(best(without, n_keys), ["workspace_id", *n_keys]))
    final = F.row_number().over(Window.partitionBy("new_id").orderBy(F.desc(F.round("score", 9)), "rule_no"))
    return both.withColumn("_rn", final).where("_rn = 1").select("new_id", "workspace_id", F.col("old_id").alias("rule_id"), "score")


def related_rules(new: DataFrame, old: DataFrame, k: int = 5, least: float = 0.3) -> DataFrame:
    """Up to k related old rules per new rule of its workspace: 0.6 term ratio + 0.4 entities, over `least`. new_id, rule_id, score, place.

    The score depends on terms and columns alone: distinct ones are compared, with the first k rules of each. Every
    column overlaps by half at least, so the term ratio decides from (least - 0.4) / 0.6 or (least - 0.2) / 0.6 on.
    """
    bare = lambda rules: rules.sparkSession.createDataFrame([], "rule_id string, field string")
    n, o = _profiles(new, bare(new), "new").drop("new_fields"), _profiles(old, bare(old), "old").drop("old_fields")
    groups, asked = _firsts(o, ["old_term", "old_column"], k), n.select("workspace_id", "new_term", "new_column").distinct()
    ratio = similar_terms(n.select(F.col("new_term").alias("a")), o.select(F.col("old_term").alias("b")), max(0.0, (least - 0.2) / 0.6 - 1e-9))
    ratio = ratio.select(F.col("a").alias("new_term"), F.col("b").alias("old_term"), "ratio")
    near = asked.join(ratio, "new_term").join(groups, ["workspace_id", "old_term"])
    # the same column carries a score over `least` with any term: pairs of too unlike terms get their ratio here
    same = asked.join(groups, (asked["workspace_id"] == groups["workspace_id"]) & (asked["new_column"] == groups["old_column"])).drop(groups["workspace_id"])
    rest = same.join(ratio, ["new_term", "old_term"], "left_anti")
    low = rest.select("new_term", "old_term").distinct().withColumn("ratio", sequence_ratio(F.col("new_term"), F.col("old_term")))
    pairs = near.unionByName(rest.join(low, ["new_term", "old_term"])).withColumn("score", 0.6 * F.col("ratio") + 0.4 * _same_table()).where(F.col("score") > least + 1e-9)
    keys = ["workspace_id", "new_term", "new_column"]
    best = pairs.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), "rule_no"))).where(F.col("place") <= k)
    rules = n.select(F.col("rule_id").alias("new_id"), *[F.coalesce(c, F.lit("")).alias(c) if c == "new_column" else F.col(c) for c in keys])
    return rules.join(best.select(*[F.coalesce(c, F.lit("")).alias(c) if c == "new_column" else F.col(c) for c in keys], "rule_id", "score", "place"), keys).select("new_id", "rule_id", "score", "place")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_matches(view(spark, sf_dir, "new_rules"), view(spark, sf_dir, "new_conditions"), view(spark, sf_dir, "rules").where("status = 'active'"), view(spark, sf_dir, "conditions"))


def sim_17_weighted_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best active rule per new rule by weights 0.4 term, 0.3 operation, 0.2 entities, 0.1 for each condition; over 0.5 only."""
    return _matches(spark, sf_dir).select("new_id", "rule_id", F.round(F.least("score", F.lit(1.0)), 6).alias("score"))


def sim_17_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rules, matched ones, their share and their mean score (not capped) by workspace."""
    found = _matches(spark, sf_dir).groupBy("workspace_id").agg(F.count("*").alias("n_matched"), F.avg("score").alias("mean_score"))
    rules = view(spark, sf_dir, "new_rules").groupBy("workspace_id").agg(F.count("*").alias("n_rules"))
    n = F.coalesce("n_matched", F.lit(0))
    return rules.join(found, "workspace_id", "left").select("workspace_id", "n_rules", n.alias("n_matched"), F.round(n / F.col("n_rules"), 6).alias("coverage"), F.round(F.coalesce("mean_score", F.lit(0.0)), 6).alias("confidence"))


def sim_18_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five related active rules per new rule: 0.6 term ratio + 0.4 entities, over 0.3."""
    found = related_rules(view(spark, sf_dir, "new_rules"), view(spark, sf_dir, "rules").where("status = 'active'"))
    return found.withColumn("score", F.round("score", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"{key}_ratio": partial(_ratio_form, key) for key in RATIO_FORMS}
QUERIES |= {"txt_01_unicode": txt_01_unicode, "txt_04_fuzzy_correction": txt_04_fuzzy_correction, "txt_04_corrected_text": txt_04_corrected_text, "sim_06_ratio": sim_06_ratio, "sim_17_weighted_match": sim_17_weighted_match, "sim_17_coverage": sim_17_coverage, "sim_18_related": sim_18_related}
