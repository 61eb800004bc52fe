"""Trees grown in one job for all groups, against plain trees grown one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearsay.operators import learn as L, trees as T


def impurity(y, w, classes):
    n = w.sum()
    if not n:
        return 0.0
    if classes is None:
        return (w * y * y).sum() - (w * y).sum() ** 2 / n
    return n - sum((w[y == c].sum()) ** 2 for c in classes) / n


def plain_tree(x, y, w, cuts, depth, classes):
    if w.sum() == 0:
        return None
    value = np.array([w[y == c].sum() / w.sum() for c in classes]) if classes is not None else np.array([(w * y).sum() / w.sum()])
    best = None
    if depth:
        whole = impurity(y, w, classes)
        for f, cs in enumerate(cuts):
            for c in cs:
                left = x[:, f] <= c
                if whole <= 0 or not w[left].sum() or not w[~left].sum():
                    continue
                gain = round(1 - (impurity(y[left], w[left], classes) + impurity(y[~left], w[~left], classes)) / whole, 9)
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, f, c)
    if best is None:
        return value
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], plain_tree(x[left], y[left], w[left], cuts, depth - 1, classes), plain_tree(x[~left], y[~left], w[~left], cuts, depth - 1, classes)


def walk(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def frame(spark, rows=900):
    rng = np.random.default_rng(5)
    group = np.where(rng.random(rows) < 0.4, "hot", np.array([f"g{i}" for i in rng.integers(0, 12, rows)]))
    x = np.round(rng.normal(size=(rows, 3)), 1)
    y = ((x[:, 0] > 0).astype(int) + (x[:, 1] * x[:, 2] > 0.2)).astype(float)
    data = [(i, str(g), *map(float, a), float(b)) for i, (g, a, b) in enumerate(zip(group, x, y))]
    return spark.createDataFrame(data, "id long, g string, a double, b double, c double, y double"), group, x, y


CUTS = {"a": [-1, -0.5, 0, 0.5, 1], "b": [-1, 0, 1], "c": [-1, 0, 1]}


@pytest.mark.parametrize("classes", [[0.0, 1.0, 2.0], None])
@pytest.mark.parametrize("small", [2_000_000, 1])
def test_one_tree_per_group_is_the_plain_tree(spark, classes, small, monkeypatch):
    monkeypatch.setattr(T, "BROADCAST_ELEMENTS", small)  # 1: no group fits a broadcast
    df, group, x, y = frame(spark)
    forest = T.grow_forest(df, ["a", "b", "c"], "y", ["g"], depth=3, classes=classes, cuts=CUTS)
    got = {r.id: r for r in T.predict_forest(forest, df, scores="s").collect()}
    assert len(got) == len(y)
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        tree = plain_tree(x[at], y[at], np.ones(len(at)), list(CUTS.values()), 3, classes)
        for i in at:
            leaf = walk(tree, x[i])
            assert got[i].s == pytest.approx(list(leaf)), (g, i)
            assert got[i].prediction == (pytest.approx(leaf[0]) if classes is None else classes[int(np.argmax(leaf))])


def test_forest_is_the_mean_of_plain_trees_on_the_same_samples(spark):
    df, group, x, y = frame(spark, 400)
    classes, trees, seed = [0.0, 1.0, 2.0], 4, 9
    forest = T.grow_forest(df.repartition(7), ["a", "b", "c"], "y", ["g"], "id", trees=trees, depth=2, classes=classes, cuts=CUTS, seed=seed)
    draw = [F.pmod(F.xxhash64("id", F.lit(t), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) for t in range(trees)]
    drawn = np.array([list(r)[1:] for r in df.select("id", *draw).orderBy("id").collect()])
    weight = (drawn[:, :, None] >= np.array(T.POISSON)).sum(2).astype(float)
    got = {r.id: r.s for r in T.predict_forest(forest, df, scores="s").collect()}
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        grown = [plain_tree(x[at], y[at], weight[at, t], list(CUTS.values()), 2, classes) for t in range(trees)]
        if any(tree is None for tree in grown):
            continue
        for i in at:
            assert got[i] == pytest.approx(list(np.mean([walk(tree, x[i]) for tree in grown], axis=0)))


def test_feature_subsets_quantile_cuts_and_rows_that_are_left_out(spark):
    df, group, _, y = frame(spark)
    odd = spark.createDataFrame([(-1, "g1", None, 0.0, 0.0, 1.0), (-2, None, 0.0, 0.0, 0.0, 1.0), (-3, "g2", 0.0, float("nan"), 0.0, 1.0), (-4, "g3", 0.0, 0.0, 0.0, None), (-5, "new", 0.0, 0.0, 0.0, 1.0)], df.schema)
    forest = T.grow_forest(df.unionByName(odd.where("id > -5")), ["a", "b", "c"], "y", ["g"], "id", trees=15, depth=5, classes=[0, 1, 2], subset=2)
    out = {r.id: r.prediction for r in T.predict_forest(forest, df.unionByName(odd)).collect()}
    assert out[-1] is None and out[-2] is None and out[-3] is None and out[-4] is not None and out[-5] is None
    hit = np.array([out[i] == y[i] for i in range(len(y))])
    assert hit[group == "hot"].mean() > 0.9
    assert forest.groups.agg(F.sum("n")).first()[0] == len(y)


def test_all_groups_grow_in_one_job_per_level(spark):
    """The number of written levels depends on the depth, not on groups or trees."""
    df, *_ = frame(spark)
    seen = []
    keep = T.write_table
    try:
        T.write_table = lambda d, label: seen.append(label) or keep(d, label)
        T.grow_forest(df, ["a", "b"], "y", ["g"], "id", trees=6, depth=3, classes=[0, 1, 2])
    finally:
        T.write_table = keep
    assert seen.count("tree-level") == 3


def test_one_class_no_split_and_no_rows(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", 1.0, 1.0 if i % 2 else float(i % 4)) for i in range(20)], "id long, g string, x double, y double")
    forest = T.grow_forest(df, ["x"], "y", ["g"], depth=2, classes=[0, 1, 2])
    assert {r.g: r.prediction for r in T.predict_forest(forest, df).collect()} == {"a": 1.0, "b": 0.0}
    none = T.grow_forest(df.limit(0), ["x"], "y", ["g"], depth=2, classes=[0, 1, 2])
    assert none.groups.count() == 0 and T.predict_forest(none, df).where("prediction IS NOT NULL").count() == 0
    whole = T.grow_forest(df, ["id"], "y", depth=1)
    assert T.predict_forest(whole, df).count() == 20


def test_compare_trees(spark):
    df, *_ = frame(spark)
    train, test = L.split(df, "id")
    table = {r.model: r.accuracy for r in L.compare_trees(train, test, ["a", "b", "c"], "y", "id", {"stump": {"depth": 1}, "forest": {"trees": 10, "depth": 5, "subset": 2}}).collect()}
    assert table["forest"] > table["stump"]
    with pytest.raises(ValueError):
        L.label_classes(spark.range(500), "id")
