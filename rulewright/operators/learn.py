"""Training and scoring of the bag-of-words classifier: two targets on the same features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, IDF, NGram, RegexTokenizer, SQLTransformer, StopWordsRemover, StringIndexer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright import operators

from .fuzzy import view
from .pairs import _kept

TARGETS = ("feedback_type", "rule_category")


@dataclass
class Classifier:
    features: PipelineModel
    targets: dict[str, tuple[StringIndexerModel, LogisticRegressionModel]]


def train_side(family: Column, feedback_id: Column) -> Column:
    """Whether a record is to be learned from: families are whole on either side, a record without one is its own family."""
    return F.conv(F.substring(F.md5(F.coalesce(F.nullif(family, F.lit("")), feedback_id.cast("string"))), 1, 4), 16, 10).cast("int") % 2 == 0


def train(records: DataFrame, features: int = 1 << 14) -> Classifier:
    """TF-IDF of words and word pairs, and a logistic regression for each target with classes weighted against their
    frequency; a null label is the class of empty text. A count per label and one pass per iteration: nothing but the
    coefficients is collected."""
    pipeline = Pipeline(stages=[
        SQLTransformer(statement="SELECT *, coalesce(feedback_text, '') AS known_text FROM __THIS__"), RegexTokenizer(inputCol="known_text", outputCol="words", pattern="[^a-z0-9_]+"), StopWordsRemover(inputCol="words", outputCol="kept"), NGram(n=2, inputCol="kept", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(kept, pairs) AS terms FROM __THIS__"), HashingTF(inputCol="terms", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="features"),
    ])
    labelled = records.select("feedback_text", *(F.coalesce(t, F.lit("")).alias(t) for t in TARGETS))
    fitted = pipeline.fit(labelled)
    ready, targets = _kept(fitted.transform(labelled).select("features", *TARGETS), "features"), {}
    for target in TARGETS:
        index = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep").fit(ready)
        counts = ready.groupBy(target).agg(F.count("*").alias("n"))
        total = counts.agg(F.sum("n"), F.count("*")).first()
        weight = F.lit(float(total[0] or 1)) / (F.lit(float(total[1] or 1)) * F.col("n"))
        weighted = index.transform(ready.join(counts.hint("broadcast"), target)).withColumn("weight", weight)
        targets[target] = (index, LogisticRegression(weightCol="weight", maxIter=20, regParam=0.001).fit(weighted))
    return Classifier(fitted, targets)


def predict(model: Classifier, rows: DataFrame) -> DataFrame:
    """Each distinct text is answered once. rows with predicted_type, predicted_category, confidence (the mean of the two largest probabilities, 4 places) and
    whether it is an actionable rule."""
    found = model.features.transform(rows.select("feedback_text").distinct())
    for target in TARGETS:
        index, fitted = model.targets[target]
        short = target.rsplit("_", 1)[1]
        fitted = fitted.copy({fitted.predictionCol: f"at_{short}", fitted.probabilityCol: f"p_{short}", fitted.rawPredictionCol: f"raw_{short}"})
        labels = F.array(*map(F.lit, index.labels)) if index.labels else F.array(F.lit(""))
        found = fitted.transform(found).withColumn(f"predicted_{short}", F.coalesce(F.get(labels, F.col(f"at_{short}").cast("int")), F.lit("")))
    mean = sum(F.array_max(vector_to_array(f"p_{t.rsplit('_', 1)[1]}")) for t in TARGETS) / len(TARGETS)
    found = found.withColumns({"confidence": F.round(mean, 4), "predicted_actionable": F.col("predicted_type") == "business_rule"})
    told = found.select(F.col("feedback_text").alias("told_of"), "predicted_type", "predicted_category", "confidence", "predicted_actionable")
    return rows.join(_kept(told, "told").hint("merge"), F.col("feedback_text").eqNullSafe(F.col("told_of"))).drop("told_of")


def outputs(model: Classifier, feedback: DataFrame) -> DataFrame:
    """A model's answers as the cascade takes them: feedback_id, feedback_type, rule_category, confidence."""
    return predict(model, feedback.select("feedback_id", "feedback_text")).select("feedback_id", F.col("predicted_type").alias("feedback_type"), F.col("predicted_category").alias("rule_category"), "confidence")


def _learned(spark: SparkSession, sf_dir: str) -> tuple[Classifier, DataFrame]:
    """A model of the families that train, and the records of the others."""
    records, side = view(spark, sf_dir, "records"), train_side(F.col("rule_family_id"), F.col("feedback_id"))
    return train(records.where(side)), records.where(~side)


def cls_07_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out accuracy by target and class: families train or test as a whole."""
    model, others = _learned(spark, sf_dir)
    scored = predict(model, others)
    each = [scored.select(F.lit(t).alias("target"), F.coalesce(t, F.lit("")).alias("class"), (F.coalesce(t, F.lit("")) == F.col(f"predicted_{t.rsplit('_', 1)[1]}")).cast("double").alias("right")) for t in TARGETS]
    return each[0].unionByName(each[1]).groupBy("target", "class").agg(F.count("*").alias("n"), F.round(F.avg("right"), 6).alias("accuracy"))


def cls_08_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both targets of the records that the model hasn't seen."""
    model, others = _learned(spark, sf_dir)
    return predict(model, others).select("feedback_id", "predicted_type", "predicted_category", "confidence", "predicted_actionable")


def cls_06_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade over all feedback with the trained model's answers."""
    feedback = view(spark, sf_dir, "feedback")
    return operators.apply(spark, "cls_06_cascade", feedback=feedback, model_outputs=outputs(_learned(spark, sf_dir)[0], feedback))


def evl_01_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support, precision, recall and F1 by class of the trained model on the families that it hasn't seen: EVL-01 on CLS-08."""
    model, others = _learned(spark, sf_dir)
    judged = predict(model, others).select(F.col("feedback_type").alias("expected_lang"), F.col("predicted_type").alias("predicted_lang"))
    return operators.apply(spark, "evl_01_per_class", predictions=judged)


QUERIES = {"evl_01_trained": evl_01_trained, "cls_07_train": cls_07_train, "cls_08_score": cls_08_score, "cls_06_trained": cls_06_trained}
