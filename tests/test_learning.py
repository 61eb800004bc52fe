"""Splits, evaluation tables and models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearsay.operators import learn as L, sentiment as N, tokens as T


def test_split_does_not_depend_on_partitioning(spark):
    df = spark.range(1000)
    a = {r.id for r in L.split(df, "id")[0].collect()}
    b = {r.id for r in L.split(df.repartition(5), "id")[0].collect()}
    rest = {r.id for r in L.split(df, "id")[1].collect()}
    assert a == b and not a & rest and len(a) + len(rest) == 1000
    assert 750 < len(a) < 850


def test_classification_report_values(spark):
    pairs = [(0, 0)] * 2 + [(0, 1)] * 1 + [(1, 1)] * 6 + [(2, 1)] * 1
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "label double, prediction double")
    out = {r["class"]: r for r in L.classification_report(df).collect()}
    assert (out["0.0"].precision, out["0.0"].recall, out["0.0"].support) == (1.0, pytest.approx(2 / 3), 3.0)
    assert (out["2.0"].precision, out["2.0"].recall, out["2.0"].f1) == (0.0, 0.0, 0.0)
    assert out["accuracy"].precision == out["accuracy"].support == pytest.approx(0.8)
    assert out["macro avg"].precision == pytest.approx((1 + 0.75 + 0) / 3)
    assert out["weighted avg"].recall == pytest.approx(0.8)
    assert L.accuracy(df).first().accuracy == pytest.approx(0.8)
    matrix = {r.label: (r["0.0"], r["1.0"], r["2.0"]) for r in L.confusion_matrix(df, [0.0, 1.0, 2.0]).collect()}
    assert matrix == {0.0: (2, 1, 0), 1.0: (0, 6, 0), 2.0: (0, 1, 0)}


def test_linear_evaluation_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(size=200)
    y = 2 * x + 1 + 0.1 * rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    row = L.linear_evaluation(df, df, "x", "y").first()
    slope, intercept = np.polyfit(x, y, 1)
    err = y - (slope * x + intercept)
    assert row.rmse == pytest.approx(np.sqrt(np.mean(err**2)))
    assert row.r2 == pytest.approx(1 - np.sum(err**2) / np.sum((y - y.mean()) ** 2))


def test_learned_sentiment_separates_words(spark):
    data = [(i, ["good", f"w{i % 7}"] if i % 2 else ["bad", f"w{i % 7}"], float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(data, "id int, words array<string>, y double")
    model = N.train_sentiment(df, "words", "y", n_features=1 << 10)
    out = N.apply_sentiment(model, df, ["negative", "positive"]).collect()
    assert all(r.sentiment == ("positive" if r.id % 2 else "negative") for r in out)
    assert all(abs(sum(r.sentiment_scores.values()) - 1) < 1e-9 for r in out)


def test_topics_have_words_and_mixtures_sum_to_one(spark):
    data = [(i, ["lip", "gloss", "shade"] * 3 if i % 2 else ["ship", "order", "store"] * 3) for i in range(40)]
    df = spark.createDataFrame(data, "id int, words array<string>")
    words, mixtures = T.topic_model(df, "id", "words", k=2, n_words=3)
    assert words.count() == 6 and words.where(F.col("word").isNull()).count() == 0
    sums = mixtures.groupBy("id").agg(F.sum("weight").alias("s")).collect()
    assert len(sums) == 40 and all(abs(r.s - 1) < 1e-6 for r in sums)


def test_fit_per_group_and_compare(spark):
    df = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("brand"),
                                 (F.col("id") % 10).cast("double").alias("x"), F.when(F.col("id") % 10 > 4, 1.0).otherwise(0.0).alias("y"))
    pred = L.fit_per_group(df, "brand", ["a", "b"], ["x"], "y", "id")
    assert all(r.accuracy == 1.0 for r in L.accuracy(pred, keys=["brand"]).collect())
    train, test = L.split(df, "id")
    table = L.compare_models(train, test, ["x"], "y", L.default_classifiers("y")).collect()
    assert [r.model for r in table] == list(L.default_classifiers("y"))
    assert L.compare_models(train, test, ["x"], "y", {"lin": L.default_regressors("y")["Linear Regression"]}, "rmse").first().rmse < 0.5
