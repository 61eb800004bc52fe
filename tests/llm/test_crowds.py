"""Texts around a large group of near copies, a little too far from its centre to be linked to it."""

import pytest
from pyspark.sql import functions as F

from hearsay.llm import similar_texts
from tests.llm.test_operators import plain_similar


@pytest.fixture(scope="module")
def crowd():
    base, texts = [f"red{k}" for k in range(200)], []
    for i in range(60):  # one word in 200 differs: near the middle
        texts.append([f"x{i}" if k == 20 + 2 * i else w for k, w in enumerate(base)])
    for i in range(60):  # four words differ: unlike most, every fifth like one that has three of these
        far = [f"y{i}.{k % 7}" if k in (5 + i, 70 + i, 100 + i // 2, 140 + i // 2) else w for k, w in enumerate(base)]
        texts += [far] + [[base[140 + i // 2] if k == 140 + i // 2 else w for k, w in enumerate(far)]] * (i % 5 == 0)
    return [" ".join(t) for t in texts] + ["another text with no shingle of these", "", None]


def test_few_pairs_meet_in_a_crowd_and_all_links_stay(spark, crowd, monkeypatch):
    met, plain = {}, similar_texts.materialise

    def kept(df, label, *args):
        out = met[label] = plain(df, label, *args)
        return out

    monkeypatch.setattr(similar_texts, "materialise", kept)
    docs = spark.createDataFrame([*enumerate(crowd), (0, crowd[0]), (None, crowd[1])], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.group for r in similar_texts.similar_groups(docs, "doc_id", "text", hub=5, crowd=3).where("doc_id IS NOT NULL").collect()}
    group = plain_similar(list(enumerate(crowd)))
    assert {frozenset(i for i in got if got[i] == g) for g in got.values()} == {frozenset(i for i in group if group[i] == g) for g in group.values()}
    assert met["met-pairs"].count() < 16 * len(crowd)


def test_rarest_shingles_and_sketches_lose_no_similar_pair(spark):
    import random

    random.seed(5)
    sets = [sorted(random.sample(range(-40, 40), random.randint(1, 12))) for _ in range(120)]
    sets += [sorted({*s[1:], *([90] if k % 3 else [])} or {7}) for k, s in enumerate(sets)]
    frame = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "node long, shingles array<long>")
    nodes = frame.select("node", F.lit(0).cast("long").alias("f0"), F.lit(0).cast("long").alias("f1"), F.size("shingles").alias("n"), F.col("node").alias("part"))
    pairs = {(r.a, r.b) for r in similar_texts._crowd_pairs(nodes, frame, 0.8).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).collect()}
    want = {(a, b) for b in range(len(sets)) for a in range(b) if len(u := {*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})}
    assert want and want <= pairs and len(pairs) < len(sets) * (len(sets) - 1) / 20


def test_few_pairs_meet_in_a_crowd_without_a_large_part(spark, monkeypatch):
    """Texts around a middle that is none of them: nearly all are a part of their own."""
    base, met, plain = [f"red{k}" for k in range(200)], {}, similar_texts.materialise

    def kept(df, label, *args):
        out = met[label] = plain(df, label, *args)
        return out

    monkeypatch.setattr(similar_texts, "materialise", kept)
    texts = [[f"y{i}.{k}" if k in (5 + i % 50, 70 + i % 41, 120 + i % 37, 160 + i % 29) else w for k, w in enumerate(base)] for i in range(150)]
    texts += [[*t[:-1], "end"] for t in texts[::10]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.group for r in similar_texts.similar_groups(docs, "doc_id", "text", crowd=3).collect()}
    group = plain_similar([(k, " ".join(t)) for k, t in enumerate(texts)])
    assert {frozenset(i for i in got if got[i] == g) for g in got.values()} == {frozenset(i for i in group if group[i] == g) for g in group.values()}
    assert met["met-pairs"].count() < 4 * len(texts)


def test_pairs_of_a_crowd_are_those_of_different_parts(spark):
    """Whichever part has a shingle most often, pairs across parts stay, smaller node first, and none within a part."""
    import random

    random.seed(6)
    bases = [random.sample(range(100), 20) for _ in range(3)]
    sets = [sorted({*random.choice(bases)} ^ {*random.sample(range(100), 1)}) for _ in range(150)]
    part = [0 if k % 4 else k % 3 for k in range(len(sets))]
    frame = spark.createDataFrame([(k, s, p) for k, (s, p) in enumerate(zip(sets, part))], "node long, shingles array<long>, part long")
    nodes = frame.select("node", F.lit(0).cast("long").alias("f0"), F.lit(0).cast("long").alias("f1"), F.size("shingles").alias("n"), "part")
    pairs = {(r.a, r.b) for r in similar_texts._crowd_pairs(nodes, frame.drop("part"), 0.8).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).collect()}
    like = lambda a, b: len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})
    assert {(a, b) for b in range(len(sets)) for a in range(b) if part[a] != part[b] and like(a, b)} <= pairs
    assert all(a < b and part[a] != part[b] for a, b in pairs)
