"""Churn classification: modelling table, split, fit, score and evaluation."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
    LogisticRegression,
    LogisticRegressionModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starcell.functions import arguments
from starcell.functions.labels import band_label
from starcell.functions.numeric import as_column, round_half_up
from starcell.operators.features import Preprocessor
from starcell.operators.quality import null_counts, require_zero
from starcell.plans.marts import PLAN_COLUMNS
from starcell.plans.ordering import totals_before
from starcell.plans.sizing import broadcast_if_small
from starcell.session import write_and_read

TARGET = "churn_flag"
IDENTIFIERS = ("customerID",)
NUMERIC = {"tenure": 0, "monthly_charges": None, "total_charges": None}
CATEGORICAL = ("gender", "SeniorCitizen", "Partner", "Dependents", *PLAN_COLUMNS, "tenure_band")

# Texts for the direction of a coefficient beyond +-0.05.
DIRECTIONS = (
    (0.05, "Associated with higher predicted churn probability"),
    (-0.05, "Associated with lower predicted churn probability (retention)"),
    (None, "Negligible direct directional effect"),
)


def modelling_table(fact: DataFrame, customer: DataFrame, plan: DataFrame) -> DataFrame:
    """The customer mart as one wide row per account, with its tenure band."""
    who = customer.select("customer_key", "customerID", "gender", "SeniorCitizen", "Partner",
                          "Dependents", "tenure")
    what = plan.select("plan_key", *PLAN_COLUMNS)
    # The plan side is counted small or joined by shuffle; accounts are as many as facts.
    rows = fact.join(broadcast_if_small(what), "plan_key").join(broadcast_if_small(who), "customer_key")
    return rows.select("customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure",
                       *PLAN_COLUMNS, "monthly_charges", "total_charges", TARGET,
                       band_label("tenure").alias("tenure_band"))


def feature_columns(columns: Sequence[str], target: str = TARGET,
                    identifiers: Sequence[str] = IDENTIFIERS) -> list[str]:
    """Columns a model may see: neither target nor identifiers."""
    if target not in columns:
        raise ValueError(f"target column {target!r} is missing")
    return [c for c in columns if c != target and c not in identifiers]


def require_no_leak(features: Sequence[str], target: str = TARGET,
                    identifiers: Sequence[str] = IDENTIFIERS) -> None:
    leaked = [c for c in (target, *identifiers) if c in features]
    if leaked:
        raise ValueError(f"features leak {leaked}")


def split_hash(key, seed: int) -> Column:
    """A hash that SQL engines agree on."""
    return F.md5(F.concat(as_column(key).cast("string"), F.lit(str(seed))))


def hashed_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Approximate split without a shuffle: the hash decides row by row."""
    arguments.number(test_size, "test_size", 0.0, 1.0)
    place = F.conv(F.substring(split_hash(key, seed), 1, 12), 16, 10).cast("bigint") / float(16**12)
    return df.withColumn("split", F.when(place < test_size, "test").otherwise("train"))


def split_quotas(sizes: DataFrame, label: str, test_size: float) -> DataFrame:
    """Test rows per class: shares of ceil(test_size * n) by largest remainder."""
    everything = Window.partitionBy()
    all_rows = F.sum("class_rows").over(everything)
    wanted = F.ceil(all_rows * test_size)
    rows = sizes.withColumn("__fair", wanted * F.col("class_rows") / all_rows).withColumn(
        "__want", wanted).withColumn("__low", F.floor("__fair"))
    rest = Window.orderBy(F.desc(F.col("__fair") - F.col("__low")), label)
    spare = F.col("__want") - F.sum("__low").over(everything)
    extra = F.when(F.row_number().over(rest) <= spare, 1).otherwise(0)
    return rows.select(label, (F.col("__low") + extra).alias("quota"))


def _quota_edges(counts: DataFrame, quotas: DataFrame, label: str, part: str) -> DataFrame:
    """Per class: the bucket in which its quota ends, and what is left of the quota before it.

    `counts` has (label, part, n), of which there are few per class.
    """
    ordered = Window.partitionBy(label).orderBy(part)
    upto = counts.withColumn("__upto", F.sum("n").over(ordered))
    edges = upto.join(quotas, label).where(
        (F.col("__upto") >= F.col("quota")) & (F.col("__upto") - F.col("n") < F.col("quota")))
    return edges.select(label, part, (F.col("quota") - F.col("__upto") + F.col("n")).alias("quota"))


def stratified_split(df: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int = 42,
                     bucket_digits: int = 4) -> DataFrame:
    """Exact split per class: the rows with the smallest hashes are the test set.

    Rows are counted per class and hash bucket. The quota of a class ends inside one
    bucket; buckets before it are test, those after it train. The rows of that bucket are
    counted by the next digits of their hash, and only those of the bucket in which the
    quota ends then (one row in 16^(2 * bucket_digits)) are ranked. No class passes
    through a task.
    """
    arguments.number(test_size, "test_size", 0.0, 1.0)
    hashed = df.withColumn("__hash", split_hash(key, seed)).withColumns({
        "__bucket": F.substring("__hash", 1, bucket_digits),
        "__fine": F.substring("__hash", bucket_digits + 1, bucket_digits)})
    held = write_and_read(hashed.groupBy(label, "__bucket").agg(F.count(F.lit(1)).alias("n")), "split-buckets")
    sizes = held.groupBy(label).agg(F.sum("n").alias("class_rows"))
    edges = write_and_read(_quota_edges(held, split_quotas(sizes, label, test_size), label, "__bucket"),
                           "split-edges")
    fine = (hashed.join(broadcast_if_small(edges.drop("quota")), [label, "__bucket"])
            .groupBy(label, "__fine").agg(F.count(F.lit(1)).alias("n")))
    ends = _quota_edges(fine, edges.select(label, "quota"), label, "__fine")
    ends = write_and_read(edges.drop("quota").join(ends, label).select(
        F.col(label).alias("__label"), F.col("__bucket").alias("__edge"), F.col("__fine").alias("__end"),
        F.col("quota").alias("__left")), "split-ends")
    rows = hashed.join(broadcast_if_small(ends), hashed[label] == ends["__label"], "left")
    place, edge = F.concat("__bucket", "__fine"), F.concat("__edge", "__end")
    on_edge = F.coalesce(place == edge, F.lit(False))
    clear = rows.where(~on_edge).withColumn("split", F.when(place < edge, "test").otherwise("train"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("__hash", key))
    last = rows.where(on_edge).withColumn("__rank", rank).withColumn(
        "split", F.when(F.col("__rank") <= F.col("__left"), "test").otherwise("train"))
    names = [*df.columns, "split"]
    return clear.select(*names).unionByName(last.select(*names))


def class_distribution(df: DataFrame, label: str = TARGET, split: str = "split") -> DataFrame:
    """Rows and share per split and class."""
    counts = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("row_count"))
    whole = F.sum("row_count").over(Window.partitionBy(split))
    return counts.withColumn("share_pct", round_half_up(F.col("row_count") / whole * 100.0, 2))


def balanced_weights(df: DataFrame, label: str = TARGET) -> DataFrame:
    """(label, weight) per class: rows / (classes * rows of the class)."""
    counts = write_and_read(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), "class-counts")
    rows, classes = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    return counts.select(label, (F.lit(float(rows)) / (F.lit(float(classes)) * F.col("n"))).alias("weight"))


def with_weights(df: DataFrame, weights: DataFrame, label: str = TARGET) -> DataFrame:
    """Adds each row's class weight; a class without one, NULL included, has none."""
    side = weights.withColumnRenamed(label, "__class")
    joined = df.drop("weight").join(broadcast_if_small(side), F.col(label) == F.col("__class"), "left")
    return joined.drop("__class")


def fit_logistic(train: DataFrame, label: str = TARGET, strength: float = 1.0,
                 max_iter: int = 1000) -> LogisticRegressionModel:
    """Ridge logistic regression; balanced weights sum to the rows, hence 1 / (strength * rows)."""
    return LogisticRegression(
        featuresCol="features", labelCol=label, weightCol="weight", maxIter=max_iter, tol=1e-8,
        elasticNetParam=0.0, regParam=1.0 / (strength * train.count()), standardization=False).fit(train)


def fit_tree(train: DataFrame, label: str = TARGET, max_depth: int = 5, min_leaf: int = 30,
             seed: int = 42, max_bins: int = 256) -> DecisionTreeClassificationModel:
    return DecisionTreeClassifier(
        featuresCol="features", labelCol=label, weightCol="weight", maxDepth=max_depth,
        minInstancesPerNode=min_leaf, impurity="gini", seed=seed, maxBins=max_bins).fit(train)


def score(model, df: DataFrame, keep: Sequence[str] = (TARGET,)) -> DataFrame:
    """Hard label and probability of the positive class."""
    scored = model.transform(df)
    return scored.select(*keep, F.col("prediction").cast("int").alias("prediction"),
                         vector_to_array("probability")[1].alias("probability"))


def confusion(df: DataFrame, label: str = TARGET, prediction: str = "prediction",
              by: Sequence[str] = ()) -> DataFrame:
    truth, guess = F.col(label), F.col(prediction)
    return df.groupBy(*by).agg(
        F.count_if((truth == 0) & (guess == 0)).alias("true_negative"),
        F.count_if((truth == 0) & (guess == 1)).alias("false_positive"),
        F.count_if((truth == 1) & (guess == 0)).alias("false_negative"),
        F.count_if((truth == 1) & (guess == 1)).alias("true_positive"))


def classification_metrics(matrix: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from confusion counts; 0 on an empty denominator."""
    tn, fp, fn, tp = (F.col(c) for c in
                      ("true_negative", "false_positive", "false_negative", "true_positive"))

    def ratio(part: Column, whole: Column) -> Column:
        return round_half_up(F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0)), 4)

    return matrix.withColumns({
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1_score": ratio(2 * tp, 2 * tp + fp + fn),
    })


def roc_auc(df: DataFrame, label: str = TARGET, probability: str = "probability") -> DataFrame:
    """Area under the ROC curve with ties counted half, in one row.

    Rows are counted per distinct score first; the negatives below each score then
    come from a running total in score order.
    """
    groups = df.groupBy(F.col(probability).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    groups = write_and_read(groups, "scores")
    ranked = totals_before(groups, ["score"], "neg", "below")
    pos, neg, below = (F.col(c).cast("decimal(19,0)") for c in ("pos", "neg", "below"))
    area = ranked.agg(F.sum(pos * (below * 2 + neg)).alias("area"), F.sum("pos").alias("p"),
                      F.sum("neg").alias("n"))
    pairs = F.col("p").cast("double") * F.col("n") * 2.0
    return area.select(round_half_up(F.try_divide(F.col("area").cast("double"), pairs), 4).alias("roc_auc"))


def feature_table(spark: SparkSession, names: Sequence[str], importances: Sequence[float],
                  coefficients: Sequence[float]) -> DataFrame:
    """Importance, coefficient, direction and ranks, one row per model feature."""
    named = spark.createDataFrame(list(enumerate(names)), "place bigint, feature string")
    return named_features(named, importances, coefficients)


def named_features(names: DataFrame, importances: Sequence[float], coefficients: Sequence[float]) -> DataFrame:
    """The same for names in a table (place, feature)."""
    rows = [(place, float(i), float(c)) for place, (i, c) in enumerate(zip(importances, coefficients))]
    figures = names.sparkSession.createDataFrame(rows, "place bigint, dt_importance double, lr_coefficient double")
    return rank_features(names.join(figures, "place").drop("place"))


def rank_features(df: DataFrame) -> DataFrame:
    coef = F.col("lr_coefficient")
    (high, raises), (low, lowers), (_, neither) = DIRECTIONS
    direction = F.when(coef > high, raises).when(coef < low, lowers).otherwise(neither)
    df = df.withColumn("lr_abs_coef", F.abs(coef)).withColumn("association_direction", direction)
    return df.withColumns({
        "relative_dt_rank": F.rank().over(Window.orderBy(F.desc("dt_importance"))),
        "relative_lr_rank": F.rank().over(Window.orderBy(F.desc("lr_abs_coef"))),
    }).orderBy(F.desc("dt_importance"), F.desc("lr_abs_coef"), "feature")


def evaluate(scored: Mapping[str, DataFrame]) -> DataFrame:
    """Confusion counts, metrics and ROC-AUC per model, from rows with the class, a prediction and a probability.

    A model without rows, or of one class only, has no ROC-AUC (NULL).
    """
    if not scored:
        raise ValueError("no scored models given")
    lines = None
    for name, rows in scored.items():
        rows = write_and_read(rows, "scored")
        line = classification_metrics(confusion(rows)).select(F.lit(name).alias("model"), "*")
        line = line.withColumn("roc_auc", F.lit(roc_auc(rows).first()["roc_auc"]).cast("double"))
        lines = line if lines is None else lines.unionByName(line)
    return lines


@dataclass(frozen=True)
class ChurnModels:
    """What one training run leaves behind."""

    preprocessor: Preprocessor
    logistic: LogisticRegressionModel
    tree: DecisionTreeClassificationModel
    train: DataFrame
    test: DataFrame

    def models(self) -> dict:
        return {"logistic_regression": self.logistic, "decision_tree": self.tree}

    def scored(self) -> dict[str, DataFrame]:
        return {name: score(model, self.test) for name, model in self.models().items()}

    def evaluation(self) -> DataFrame:
        """One row of metrics per model on the test split."""
        return evaluate(self.scored())

    def features(self, spark: SparkSession) -> DataFrame:
        return named_features(self.preprocessor.names(), self.tree.featureImportances.toArray(),
                              self.logistic.coefficients.toArray())

    def save(self, spark: SparkSession, folder: str) -> None:
        self.logistic.write().overwrite().save(os.path.join(folder, "churn_logistic_regression"))
        self.tree.write().overwrite().save(os.path.join(folder, "churn_decision_tree"))
        self.preprocessor.as_rows(spark).write.mode("overwrite").parquet(
            os.path.join(folder, "churn_preprocessor"))


def load_models(spark: SparkSession, folder: str) -> tuple:
    """(preprocessor, logistic model, tree model) from a folder written by `save`."""
    stored = spark.read.parquet(os.path.join(folder, "churn_preprocessor"))
    return (Preprocessor.from_rows(stored),
            LogisticRegressionModel.load(os.path.join(folder, "churn_logistic_regression")),
            DecisionTreeClassificationModel.load(os.path.join(folder, "churn_decision_tree")))


def train_models(table: DataFrame, test_size: float = 0.2, seed: int = 42,
                 numeric: Mapping[str, int | None] = NUMERIC,
                 categorical: Sequence[str] = CATEGORICAL, key: str = "customerID",
                 target: str = TARGET) -> ChurnModels:
    """Split, fit the preprocessing on the training rows alone, and fit both models."""
    features = feature_columns(table.columns, target, (key,))
    require_no_leak([*numeric, *categorical], target, (key,))
    # Checked, counted and split in several passes; the joins behind it run once.
    table = write_and_read(table, "modelling")
    require_zero(null_counts(table, features), "null_count", "missing feature values")
    split = write_and_read(stratified_split(table, target, key, test_size, seed), "split")
    train, test = (split.where(F.col("split") == part) for part in ("train", "test"))
    preprocessor = Preprocessor.fit(train, numeric, categorical)
    weights = balanced_weights(train, target)
    # Stored, not cached: each fit keeps these rows in a form of its own while it lasts, and a cached copy
    # beside it would only take the memory that it needs.
    ready = write_and_read(with_weights(preprocessor.apply(train, [target]), weights, target), "train")
    logistic, tree = fit_logistic(ready, target), fit_tree(ready, target, seed=seed)
    return ChurnModels(preprocessor, logistic, tree, ready, preprocessor.apply(test, [target]))
