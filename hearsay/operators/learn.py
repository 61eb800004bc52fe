"""Features, splits, models and their evaluation tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from hearsay.operators.trees import grow_forest, predict_forest


def features(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="skip").transform(df)


def split(df: DataFrame, key: str, train: float = 0.8, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of the key: the same row lands on the same side in every run and partitioning."""
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 10_000
    cut = int(train * 10_000)
    return df.where(draw < cut), df.where(draw >= cut)


def linear_coefficients(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """One-feature least squares with built-in aggregates."""
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2_train"), F.count(F.lit(1)).alias("n_train"),
    )


def linear_evaluation(train: DataFrame, test: DataFrame, x: str, y: str) -> DataFrame:
    """Fit on one part, RMSE and R2 on the other, in one lazy plan."""
    fitted = linear_coefficients(train, x, y)
    scored = test.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where(
        F.col("_x").isNotNull() & F.col("_y").isNotNull()
    )
    slope, intercept = fitted.select("slope").scalar(), fitted.select("intercept").scalar()
    err = F.col("_y") - (slope * F.col("_x") + intercept)
    sums = scored.agg(
        F.count(F.lit(1)).alias("n"), F.sum(err * err).alias("ssr"), F.var_pop("_y").alias("v")
    )
    return sums.select(
        "n", F.sqrt(F.col("ssr") / F.col("n")).alias("rmse"),
        (1 - F.try_divide(F.col("ssr"), F.col("v") * F.col("n"))).alias("r2"),
    )


def fit_linear(train: DataFrame, cols: Sequence[str], y: str):
    """Multi-feature linear regression as a pipeline model."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="skip"),
        LinearRegression(featuresCol="features", labelCol=y),
    ]).fit(train)


def fit_forest(train: DataFrame, cols: Sequence[str], label: str, seed: int = 123, **params):
    return _pipeline(RandomForestClassifier(featuresCol="features", labelCol=label, seed=seed, **params), cols).fit(train)


def _pipeline(estimator: Estimator, cols: Sequence[str]) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="skip"), estimator,
    ])


def label_classes(df: DataFrame, label: str, most: int = 100) -> list[float]:
    """The distinct labels in order; more than `most` of them are no classes."""
    found = df.select(F.col(label).cast("double").alias("c")).where("c IS NOT NULL").distinct().orderBy("c").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{label} has more than {most} values")
    return [r["c"] for r in found]


def fit_per_group(df: DataFrame, group: str, values: Sequence | None, cols: Sequence[str], label: str, key: str,
                  train: float = 0.8, seed: int = 123, trees: int = 20, depth: int = 5) -> DataFrame:
    """A forest per group; predictions on each group's test part.

    All groups, or those in `values`, grow together: one job per level, however
    many groups there are. Rows that `grow_forest` leaves out of training get a
    prediction when their features are whole; a group without training rows has none.
    """
    part = df.where(F.col(group).isNotNull()) if values is None else df.where(F.col(group).isin(list(values)))
    fit_rows, test_rows = split(part, key, train, seed)
    forest = grow_forest(fit_rows, cols, label, [group], key, trees=trees, depth=depth, classes=label_classes(fit_rows, label),
                         subset=math.ceil(math.sqrt(len(cols))), seed=seed)
    scored = predict_forest(forest, test_rows).where("prediction IS NOT NULL")
    return scored.select(group, key, F.col(label).cast("double").alias("label"), "prediction")


def compare_trees(train: DataFrame, test: DataFrame, cols: Sequence[str], label: str, key: str, settings: Mapping[str, Mapping],
                  metric: str = "accuracy") -> DataFrame:
    """One row per named setting of `grow_forest` with its accuracy or RMSE on the test part."""
    if metric not in ("accuracy", "rmse"):
        raise ValueError(f"unknown metric {metric!r}")
    classes = label_classes(train, label) if metric == "accuracy" else None
    out = None
    for name, setting in settings.items():
        scored = predict_forest(grow_forest(train, cols, label, row_key=key, classes=classes, **setting), test).where("prediction IS NOT NULL")
        row = scored.agg(_metric(label, metric)).select(F.lit(name).alias("model"), metric)
        out = row if out is None else out.unionByName(row)
    return out


def _metric(label: str, metric: str) -> Column:
    err = F.col("prediction") - F.col(label).cast("double")
    return (F.avg((err == 0).cast("double")) if metric == "accuracy" else F.sqrt(F.avg(err * err))).alias(metric)


def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction", keys: Sequence[str] = ()) -> DataFrame:
    hit = (F.col(label) == F.col(prediction)).cast("double")
    return pred.groupBy(*keys).agg(F.avg(hit).alias("accuracy"))


def confusion_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction", keys: Sequence[str] = ()) -> DataFrame:
    return pred.groupBy(*keys, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(pred: DataFrame, classes: Sequence, label: str = "label", prediction: str = "prediction",
                     keys: Sequence[str] = ()) -> DataFrame:
    """Rows are true classes, one column per predicted class."""
    counts = confusion_counts(pred, label, prediction, keys)
    return counts.groupBy(*keys, "label").pivot("prediction", list(classes)).agg(F.sum("n")).fillna(0)


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                          keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages.

    Built from the confusion counts, a table of classes squared; undefined
    figures are zero.
    """
    keys = list(keys)
    counts = confusion_counts(pred, label, prediction, keys)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = counts.select(*keys, F.explode(F.array(
        F.struct(F.col("label").cast("string").alias("class"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("prediction").cast("string").alias("class"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
    )).alias("_s")).select(*keys, "_s.*")
    per = sides.groupBy(*keys, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide("tp", "predicted"), zero)
    recall = F.coalesce(F.try_divide("tp", "support"), zero)
    per = per.withColumns({"precision": precision, "recall": recall})
    p, r, n = F.col("precision"), F.col("recall"), F.col("support")
    per = per.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), zero))
    rows = per.select(*keys, "class", "precision", "recall", "f1", F.col("support").cast("double").alias("support"))

    def weighted(c):
        return F.sum(F.col(c) * n) / F.sum(n)

    hits, support = F.sum("tp") / F.sum("support"), F.sum("support").cast("double").alias("support")
    averages = per.groupBy(*keys).agg(F.array(
        F.struct(F.lit("accuracy").alias("class"), hits.alias("precision"), hits.alias("recall"), hits.alias("f1"), hits.alias("support")),
        F.struct(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), support),
        F.struct(F.lit("weighted avg").alias("class"), weighted("precision").alias("precision"), weighted("recall").alias("recall"), weighted("f1").alias("f1"), support),
    ).alias("_a"))
    return rows.unionByName(averages.select(*keys, F.explode("_a").alias("_a")).select(*keys, "_a.*"))


def default_classifiers(label: str, seed: int = 123) -> dict[str, Estimator]:
    return {
        "Random Forest Classification #1": RandomForestClassifier(labelCol=label, seed=seed),
        "Random Forest Classification #2": RandomForestClassifier(labelCol=label, seed=seed, numTrees=50, maxDepth=8),
        "Logistic Regression": LogisticRegression(labelCol=label),
        "Decision Tree Classification": DecisionTreeClassifier(labelCol=label, seed=seed),
    }


def default_regressors(label: str, seed: int = 123) -> dict[str, Estimator]:
    return {
        "Random Forest Regression #1": RandomForestRegressor(labelCol=label, seed=seed),
        "Linear Regression": LinearRegression(labelCol=label),
        "Random Forest Regression #2": RandomForestRegressor(labelCol=label, seed=seed, numTrees=50, maxDepth=8),
    }


def compare_models(train: DataFrame, test: DataFrame, cols: Sequence[str], label: str,
                   models: Mapping[str, Estimator], metric: str = "accuracy") -> DataFrame:
    """One row per model with its accuracy or RMSE on the test part."""
    if metric not in ("accuracy", "rmse"):
        raise ValueError(f"unknown metric {metric!r}")
    out = None
    for name, estimator in models.items():
        scored = _pipeline(estimator, cols).fit(train).transform(test)
        row = scored.agg(_metric(label, metric)).select(F.lit(name).alias("model"), metric)
        out = row if out is None else out.unionByName(row)
    return out
