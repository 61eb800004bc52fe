"""Topic rounds over several groups: what passes between groups and homes, and what stays on disk."""

import os
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearsay.operators import coded as K, linked as L, topics as P
from hearsay.session import shared_dir
from tests.test_topics import frame, plain_fit, themed


@pytest.fixture
def many_groups(monkeypatch):
    monkeypatch.setattr(K, "GROUP_TOKENS", 10)
    monkeypatch.setattr(L, "TOGETHER", 2)


def test_many_groups_equal_numpy_and_leave_no_round_on_disk(spark, many_groups):
    texts = themed(n=30) | {100: [], 101: ["lip"], 102: ["only", "here"], 103: ["only", "lip", "lip"]}
    rows = [(i, t[:len(t) // 2]) for i, t in texts.items()] + [(i, t[len(t) // 2:]) for i, t in texts.items()] + [(None, ["lip"]), (101, None)]
    before = set(os.listdir(shared_dir(spark)))
    kept = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    fitted = P.fit_topics(spark.createDataFrame(rows, "id int, words array<string>"), "id", "words", 3, 3, alpha=0.3, eta=0.2)
    left = sorted(n.rsplit("-", 1)[0] for n in set(os.listdir(shared_dir(spark))) - before)
    assert left == ["topic-docs", "topic-words"]
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == kept
    gamma, lam = plain_fit(texts, 3, 3, 0.3, 0.2)
    assert {r.word: [r.g0, r.g1, r.g2] for r in fitted.words.collect()} == {w: pytest.approx(list(v), rel=1e-8) for w, v in lam.items()}
    assert {r.id: [r.g0, r.g1, r.g2] for r in fitted.docs.collect()} == {i: pytest.approx(list(gamma.get(i, [0.3] * 3)), rel=1e-8) for i in texts}


def test_a_group_and_a_home_share_one_row_and_each_word_once(spark, many_groups):
    texts = themed(n=40)
    coded = K.code_words(frame(spark, texts), "id", "words")
    linked = L.link_words(coded, coded.words, 3, 17)
    groups = set(linked.group_of.values())
    assert len(linked.group_of) == coded.groups > 16 and 1 < len(groups) < coded.groups
    rows = linked.links.collect()
    assert len({(r["_p"], r["_at"]) for r in rows}) == len(rows)
    home = {(r["_p"], r["_i"]): r.word for r in linked.words.collect()}
    assert sorted(home.values()) == sorted({w for t in texts.values() for w in t})
    got = Counter((r["_at"], home[r["_p"], i]) for r in rows for i in np.frombuffer(r.places, "i4").tolist())
    group = {r.id: linked.group_of[r["_p"]] for r in coded.rows.select("id", "_p").collect()}
    assert got == Counter({(group[i], w) for i, t in texts.items() for w in t})
    linked.free()


def test_a_round_sends_bytes_not_words(spark, many_groups):
    coded = K.code_words(frame(spark, themed(n=40)), "id", "words")
    linked = L.link_words(coded, coded.words, 3, 17)
    state = P._round(linked, linked.level, None, P._totals(linked.level, 3), 0.3, 0.2)
    groups = len(set(linked.group_of.values()))
    assert state.where(~F.col("doc")).count() <= groups and groups < state.where("doc").count() <= coded.groups
    sizes = defaultdict(int)
    for r in state.collect():
        sizes[r.doc] += len(L.unpacked(pa.scalar(bytes(r["values"])), 3))
    assert sizes == {False: linked.words.count(), True: 40}
    linked.free()


def test_packed_vectors_lose_nothing():
    values = np.random.default_rng(1).gamma(0.1, size=(999, 4)) * 10.0 ** np.arange(-300, 100, 100)
    values[0] = [0.0, -0.0, np.inf, 5e-324]
    near = 0.1 + 1e-6 * np.random.default_rng(2).random((5000, 4))
    for v in (values, near, np.empty((0, 4))):
        assert L.unpacked(pa.scalar(L.packed(v)), 4).tobytes() == v.tobytes() and L.unpacked(pa.scalar(L.packed(v)), 4).shape == v.shape
    assert len(L.packed(near)) < 0.8 * near.nbytes


def test_numbers_of_groups_fall_in_different_partitions(spark):
    for n in (1, 2, 7, 40):
        keys = K.spread_keys(spark, n)
        at = spark.createDataFrame([(k,) for k in keys], "k int").select(F.pmod(F.hash("k"), F.lit(n)).alias("at")).collect()
        assert len(keys) == n and {r["at"] for r in at} == set(range(n))
