"""Topics against the same updates in numpy."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from hearsay.operators import topics as P


def psi(x):
    """Digamma by steps up to a large argument."""
    x, out = np.array(x, float), 0.0
    for _ in range(60):
        out, x = out - 1 / x, x + 1
    return out + np.log(x) - 0.5 / x - 1 / (12 * x**2) + 1 / (120 * x**4)


def start(word, topic):
    return 0.5 + int(hashlib.md5(f"17-{topic}-{word}".encode()).hexdigest()[:8], 16) / 2**32


def plain_fit(texts, k, rounds, alpha, eta):
    docs, words = sorted(i for i, t in texts.items() if t), sorted({w for t in texts.values() for w in t})
    n = np.array([[Counter(texts[d])[w] for w in words] for d in docs], float)
    lam = np.array([[start(w, t) for t in range(k)] for w in words])
    gamma = np.full((len(docs), k), alpha)
    for _ in range(rounds):
        e = np.exp(psi(gamma) - psi(gamma.sum(1))[:, None])
        b = np.exp(psi(lam) - psi(lam.sum(0)))
        phi = e[:, None, :] * b[None]
        shares = n[:, :, None] * phi / phi.sum(2, keepdims=True)
        gamma, lam = alpha + shares.sum(1), eta + shares.sum(0)
    return dict(zip(docs, gamma)), dict(zip(words, lam))


def themed(seed=1, n=60):
    rng = np.random.default_rng(seed)
    themes = [["lip", "gloss", "shade", "tint"], ["ship", "order", "store", "box"], ["rain", "sun", "cloud", "wind"]]
    return {i: [str(w) for w in rng.choice(themes[i % 3], 25)] + [str(w) for w in rng.choice(sum(themes, []), 3)] for i in range(n)}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id int, words array<string>")


@pytest.mark.parametrize("threshold", ["-1", "10m"])
@pytest.mark.parametrize("rounds", [1, 4])
def test_rounds_equal_numpy(spark, rounds, threshold):
    texts = themed() | {100: [], 101: ["lip"]}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        fitted = P.fit_topics(frame(spark, texts), "id", "words", 3, rounds, alpha=0.3, eta=0.2)
        gamma, lam = plain_fit(texts, 3, rounds, 0.3, 0.2)
        for r in fitted.words.collect():
            assert [r.g0, r.g1, r.g2] == pytest.approx(list(lam[r.word]), rel=1e-8)
        for r in fitted.docs.collect():
            assert [r.g0, r.g1, r.g2] == pytest.approx(list(gamma.get(r.id, [0.3] * 3)), rel=1e-8)
        assert fitted.docs.count() == len(texts)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bound_rises_and_themes_come_apart(spark):
    texts = themed()
    fitted = P.fit_topics(frame(spark, texts), "id", "words", 3, 16, bounds=True)
    assert len(fitted.bounds) == 15 and all(b >= a - 1e-6 for a, b in zip(fitted.bounds, fitted.bounds[1:]))
    assert fitted.bounds[-1] > fitted.bounds[0] + 50
    tops = {}
    for r in P.topic_words(fitted, 4).collect():
        tops.setdefault(r.topic, set()).add(r.word)
    assert sorted(map(sorted, tops.values())) == sorted(map(sorted, [["lip", "gloss", "shade", "tint"], ["ship", "order", "store", "box"], ["rain", "sun", "cloud", "wind"]]))
    by = {}
    for r in P.topic_mixtures(fitted).collect():
        by.setdefault(r.id, {})[r.topic] = r.weight
    assert all(sum(m.values()) == pytest.approx(1) and max(m.values()) > 0.8 for m in by.values())
    assert all(max(by[i], key=by[i].get) == max(by[i % 3], key=by[i % 3].get) for i in by)


def test_other_documents_null_ids_tokens_and_rare_words(spark):
    fitted = P.fit_topics(frame(spark, themed()), "id", "words", 3, 12)
    other = spark.createDataFrame([(1, ["lip", "gloss", "unseen", None]), (2, ["rain", "sun"]), (3, []), (None, ["lip"]), (4, None)], "id int, words array<string>")
    got = {}
    for r in P.infer_mixtures(fitted, other, "id", "words").collect():
        got.setdefault(r.id, []).append(r.weight)
    assert set(got) == {1, 2, 3, 4} and got[3] == got[4] == pytest.approx([1 / 3] * 3)
    assert np.argmax(got[1]) != np.argmax(got[2])
    rare = P.fit_topics(frame(spark, themed() | {99: ["once"]}), "id", "words", 2, 1, min_df=2)
    assert rare.words.where("word = 'once'").count() == 0
    none = P.fit_topics(other.limit(0), "id", "words", 2, 2)
    assert P.topic_words(none).count() == 0 and P.topic_mixtures(none).count() == 0


def test_special_functions(spark):
    import math

    x = [0.01, 0.1, 0.5, 1.0, 2.5, 10.0, 1e4]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select("x", P.digamma("x").alias("p"), P.log_gamma("x").alias("g")).collect()
    for r in rows:
        assert r.p == pytest.approx(P.digamma_of(r.x), rel=1e-12)
        assert r.p == pytest.approx(float(psi(r.x)), rel=1e-8) and r.g == pytest.approx(math.lgamma(r.x), rel=1e-9, abs=1e-9)
