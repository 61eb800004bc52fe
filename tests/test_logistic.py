"""Word weights against the same rounds in numpy."""

import numpy as np
import pytest

from hearsay.operators import logistic as LR

TEXTS = {i: (["good", "fine"] if i % 2 else ["bad", "poor"]) * (1 + i % 3) + [f"w{i % 5}", "the"] + (["rare"] if i == 7 else []) for i in range(50)}
NOISY = {3, 10, 21}


def rows():
    return [(i, t, float((i % 2) ^ (i in NOISY))) for i, t in TEXTS.items()] + [(99, [], 1.0), (100, None, 0.0)]


def plain(data, rounds, penalty):
    words = sorted({w for _, t, _ in data for w in t or []})
    tf = np.array([[(t or []).count(w) for w in words] for _, t, _ in data], float)
    x = tf * np.log((len(data) + 1) / ((tf > 0).sum(0) + 1))
    x = np.column_stack([np.divide(x, x.sum(1, keepdims=True), out=np.zeros_like(x), where=x.sum(1, keepdims=True) > 0), np.ones(len(data))])
    y, w, own, losses = np.array([r[2] for r in data]), np.zeros(len(words) + 1), np.full(len(words) + 1, penalty), []
    own[-1] = 0
    for _ in range(rounds):
        m = x @ w
        p = 1 / (1 + np.exp(-m))
        losses.append(np.mean(np.log1p(np.exp(-np.abs(m))) + np.maximum(m, 0) - m * y) + (own * w * w).sum() / 2)
        bend = np.where(np.abs(m) < 1e-6, 0.25, (p - 0.5) / np.where(m == 0, 1, m))
        with np.errstate(invalid="ignore", divide="ignore"):
            step = (x.T @ (p - y) / len(y) + own * w) / (x.T @ (2 * bend) / len(y) + own)
        w = w - np.where(x.any(0), step, 0)
    return dict(zip([*words, ""], w)), losses, dict(zip([r[0] for r in data], 1 / (1 + np.exp(-(x @ w)))))


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_rounds_equal_numpy_and_the_loss_falls(spark, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        df = spark.createDataFrame(rows(), "id long, words array<string>, y double").repartition(3)
        model = LR.fit_words(df, "id", "words", "y", 6, 1e-3)
        weights, losses, scores = plain(rows(), 6, 1e-3)
        got = {r.word: r.weight for r in model.weights.collect()}
        assert all(got[w] == pytest.approx(weights[w], abs=1e-9) for w in got) and set(weights) - set(got) <= {"the"}
        assert model.losses == pytest.approx(losses) and all(b < a for a, b in zip(model.losses, model.losses[1:]))
        out = {r.id: r.probability for r in LR.score_words(model, df, "id", "words").collect()}
        assert out == pytest.approx(scores)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_words_separate_texts_nulls_stay_out_and_nothing_is_no_error(spark):
    odd = [(None, ["good"], 0.0), (200, ["good"], None), (201, [None, ""], 1.0)]
    df = spark.createDataFrame(rows() + odd, "id long, words array<string>, y double")
    model = LR.fit_words(df, "id", "words", "y", 12)
    got = {r.id: r.sentiment for r in LR.score_words(model, df, "id", "words").collect()}
    assert len(got) == 54 and all(got[i] == ("positive" if i % 2 else "negative") for i in range(50))
    none = LR.fit_words(df.limit(0), "id", "words", "y", 3)
    assert none.losses == [] and {r.probability for r in LR.score_words(none, df, "id", "words").collect()} == {0.5}
