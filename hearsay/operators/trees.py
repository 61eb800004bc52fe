"""Decision trees and forests for many groups at once, grown level by level from histograms.

One job per level counts (group, tree, node, feature, bin) for all groups and
trees together, from the rows or, where many have equal labels and bins, from sums of
these made once; the counts are partial sums before they are shuffled, so a group
with most of the rows is no heavier than its histogram. The driver sees no
group, tree or node: splits are rows of a written table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from hearsay.operators.skew import is_small, join_hot_split
from hearsay.session import write_table

#: Cumulative Poisson(1) probabilities: how often a bootstrap sample holds a row.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)
#: What a broadcast of per-group trees may hold, in array elements.
BROADCAST_ELEMENTS = 2_000_000
#: Rows a cell of equal label and bins holds on average at least, for rows to be grown by cells.
MEETING = 4
#: Shares of impurity are compared to this many digits; equal ones go to the first feature and the lowest cut.
DIGITS = 9


@dataclass(frozen=True)
class Forest:
    """`groups`: one row per group with `n`, its training rows, and its trees as arrays over tree * width + node."""

    groups: DataFrame
    keys: tuple[str, ...]
    features: tuple[str, ...]
    classes: tuple[float, ...] | None
    trees: int
    depth: int

    @property
    def width(self) -> int:
        return 2 ** (self.depth + 1)


def grow_forest(
    df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str] = (), row_key: str | None = None, trees: int = 1,
    depth: int = 5, bins: int = 32, classes: Sequence[float] | None = None, cuts: Mapping[str, Sequence[float]] | None = None,
    subset: int | None = None, min_rows: int = 1, seed: int = 123,
) -> Forest:
    """A forest for every value of `keys`; one for all rows when there are none.

    With `classes` the trees classify by Gini impurity, without they regress by
    squared error. Cuts are `bins` quantiles of each group and feature unless
    given. With several trees each sees a bootstrap sample drawn by a hash of
    `row_key`, and each node `subset` features drawn by a hash of its place, so
    a run on other partitions gives the same trees. Rows with a null key, a null
    label, a label outside `classes`, or a null or not-a-number feature are left out.
    """
    if trees > 1 and row_key is None:
        raise ValueError("several trees need a row_key to draw samples by")
    if depth < 1:
        raise ValueError("a tree needs a depth of at least 1")
    df, names, features = _with_key(df, keys), _names(keys), list(features)
    x = [F.col(c).cast("double") for c in features]
    y = F.col(label).cast("double")
    valid = reduce(Column.__and__, [c.isNotNull() & ~F.isnan(c) for c in [*x, y]] + [F.col(k).isNotNull() for k in names])
    if classes is not None:
        valid = valid & y.isin([float(c) for c in classes])
    row = F.col(row_key) if row_key else F.lit(0)
    rows = df.where(valid).select(*names, row.alias("_row"), y.alias("_y"), F.array(*x).alias("_x"))
    if cuts is None:
        shares = [i / bins for i in range(1, bins)]
        each = F.array(*[F.array_distinct(F.percentile_approx(F.get("_x", F.lit(i)), shares, 10_000)) for i in range(len(features))])
    else:
        each = F.array(*[F.array(*[F.lit(float(c)) for c in sorted(cuts[f])]) for f in features])
    found = write_table(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), each.alias("_cuts")), "cuts")
    below = F.zip_with("_x", "_cuts", lambda v, c: F.size(F.filter(c, lambda e: e < v)))
    binned = _key_join(rows, found, names, bins * len(features)).withColumn("_b", below)
    binned = write_table(binned.select(*names, "_row", "_y", "_b"), "binned")

    statistics = [(F.col("_y") == float(c)).cast("double") for c in classes] if classes is not None else [F.lit(1.0), F.col("_y"), F.col("_y") * F.col("_y")]
    impurity = _gini if classes is not None else _squared_error
    width = 2 ** (depth + 1)
    levels: list[DataFrame] = []
    cells = _cells(binned, names, trees, seed) if classes is not None else None
    for level in range(depth):
        here = _at_nodes(binned, levels, names, trees, width, level, seed) if cells is None else _cells_at_nodes(cells, levels, names, trees, width, level)
        split = _best_splits(here, names, statistics, impurity, len(features), subset, min_rows, seed)
        levels.append(write_table(split, "tree-level"))
        if levels[-1].where("_feature IS NOT NULL").isEmpty():
            break
    nodes = reduce(DataFrame.unionByName, levels).join(found, names)
    nodes = nodes.withColumn("_cut", F.get(F.get("_cuts", F.col("_feature")), F.col("_bin")))
    groups = _with_leaves(nodes, names, trees, width, classes is not None).join(found.select(*names, "n"), names)
    named = None if classes is None else tuple(float(c) for c in classes)
    return Forest(write_table(groups, "forest"), tuple(keys), tuple(features), named, trees, depth)


def predict_forest(forest: Forest, df: DataFrame, prediction: str = "prediction", scores: str | None = None) -> DataFrame:
    """All columns and the prediction: the class with the largest mean share of the trees' leaves (the first of equal ones), or their mean.

    Rows of groups without a forest, and rows with a null or not-a-number
    feature, get a null. `scores` names a column of class shares.
    """
    x = [F.col(c).cast("double") for c in forest.features]
    valid = reduce(Column.__and__, [c.isNotNull() & ~F.isnan(c) for c in x])
    rows = _with_key(df, forest.keys).withColumn("_x", F.when(valid, F.array(*x)))
    known = _key_join(rows, forest.groups, _names(forest.keys), forest.trees * forest.width * 3, how="left")
    width = F.lit(forest.width)

    def step(tree: Column, node: Column) -> Column:
        at = tree * width + node
        feature = F.get("_feature", at)
        return F.when(feature.isNull(), node).otherwise(node * 2 + (F.get("_x", feature) > F.get("_cut", at)).cast("int"))

    depth = F.sequence(F.lit(1), F.lit(forest.depth))
    leaf = lambda t: F.get("_value", t * width + F.aggregate(depth, F.lit(1), lambda n, _: step(t, n)))
    leaves = F.transform(F.sequence(F.lit(0), F.lit(forest.trees - 1)), leaf)
    size = len(forest.classes) if forest.classes is not None else 1
    start = F.array(*[F.lit(0.0)] * size)
    mean = F.transform(F.aggregate(leaves, start, lambda a, v: F.zip_with(a, v, lambda p, q: p + q)), lambda s: s / forest.trees)
    out = known.withColumn("_mean", F.when(F.col("_x").isNotNull() & F.col("_value").isNotNull(), mean))
    if forest.classes is None:
        chosen = F.get("_mean", F.lit(0))
    else:
        named = F.array(*[F.lit(c) for c in forest.classes])
        chosen = F.get(named, (F.array_position("_mean", F.array_max("_mean")) - 1).cast("int"))
    out = out.withColumn(prediction, chosen)
    return (out.withColumn(scores, F.col("_mean")) if scores else out).drop("_x", "_mean", "_feature", "_cut", "_value", "_one")


def _names(keys: Sequence[str]) -> list[str]:
    return list(keys) or ["_one"]


def _with_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Without keys, all rows are one group."""
    return df if keys else df.withColumn("_one", F.lit(0))


def _key_join(rows: DataFrame, groups: DataFrame, keys: list[str], elements: int, how: str = "inner") -> DataFrame:
    """Rows with the columns of their group, but `n`, its rows: by broadcast while the counted groups have few array
    elements, beyond that by a join that leaves the rows of hot groups where they are."""
    if is_small(groups, BROADCAST_ELEMENTS // elements):
        return rows.join(F.broadcast(groups.drop("n")), keys, how)
    return join_hot_split(rows, groups, keys, "n", how=how).drop("n")


def _weight(tree: Column, trees: int, seed: int) -> Column:
    """How often the tree's bootstrap sample holds the row."""
    if trees == 1:
        return F.lit(1.0)
    draw = F.pmod(F.xxhash64("_row", tree, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return F.size(F.filter(F.array(*[F.lit(p) for p in POISSON]), lambda p: p <= draw)).cast("double")


def _reached(tree: Column, width: int, level: int) -> Column:
    """The node that a row's bins lead to, `level` splits down."""
    def step(node: Column) -> Column:
        at = tree * width + node
        feature = F.get("_feature", at)
        return F.when(feature.isNull(), node).otherwise(node * 2 + (F.get("_b", feature) > F.get("_bin", at)).cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(level)), F.lit(1), lambda n, _: step(n))


def _cells(rows: DataFrame, keys: list[str], trees: int, seed: int) -> DataFrame | None:
    """One row per group, label, bins and tree with the summed weights of its sampled rows, where that is far fewer
    than the rows; they go down a tree together. None where most rows have bins of their own."""
    counted = rows.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(*keys, "_y", "_b")).alias("cells")).first()
    if counted["cells"] * MEETING > counted["n"]:
        return None
    draws = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("_tree"), _weight(t, trees, seed).alias("_w")))
    drawn = rows.select(*keys, "_y", "_b", F.explode(draws).alias("_s")).select(*keys, "_y", "_b", "_s.*").where("_w > 0")
    return write_table(drawn.groupBy(*keys, "_y", "_b", "_tree").agg(F.sum("_w").alias("_w")), "sampled-cells")


def _cells_at_nodes(cells: DataFrame, levels: list[DataFrame], keys: list[str], trees: int, width: int, level: int) -> DataFrame:
    """As `_at_nodes`, of cells."""
    if not levels:
        return cells.withColumn("_node", F.lit(1))
    here = _key_join(cells, write_table(_with_splits(levels, keys, trees, width), "grown"), keys, trees * width * 2)
    return here.select(*keys, "_y", "_b", "_tree", "_w", _reached(F.col("_tree"), width, level).alias("_node")).where(F.col("_node") >= 2**level)


def _at_nodes(rows: DataFrame, levels: list[DataFrame], keys: list[str], trees: int, width: int, level: int, seed: int) -> DataFrame:
    """One row per sampled row and tree, with the node of this level it has reached.

    Weights and nodes of all trees are one small array, made before the rows are
    expanded, so that the trees themselves are not copied with every row.
    """
    here = rows
    if levels:
        here = _key_join(here, write_table(_with_splits(levels, keys, trees, width), "grown"), keys, trees * width * 2)

    reached = (lambda t: _reached(t, width, level)) if levels else (lambda t: F.lit(1))
    spots = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("_tree"), _weight(t, trees, seed).alias("_w"), reached(t).alias("_node")))
    spots = F.filter(spots, lambda s: (s["_w"] > 0) & (s["_node"] >= 2**level))
    small = here.select(*keys, "_y", "_b", spots.alias("_spots"))
    return small.select(*keys, "_y", "_b", F.explode("_spots").alias("_s")).select(*keys, "_y", "_b", "_s.*")


def _gini(s: list[Column]) -> Column:
    n = reduce(Column.__add__, s)
    return n - F.coalesce(F.try_divide(reduce(Column.__add__, [c * c for c in s]), n), F.lit(0.0))


def _squared_error(s: list[Column]) -> Column:
    return s[2] - F.coalesce(F.try_divide(s[1] * s[1], s[0]), F.lit(0.0))


def _best_splits(
    here: DataFrame, keys: list[str], statistics: list[Column], impurity, features: int, subset: int | None, min_rows: int, seed: int,
) -> DataFrame:
    """keys, _tree, _node, _all, and of the best split _feature, _bin, _left, _right; null where none lowers the impurity."""
    node = [*keys, "_tree", "_node"]
    k = len(statistics)
    one = here.select(*node, *[(F.col("_w") * s).alias(f"_s{i}") for i, s in enumerate(statistics)], F.posexplode("_b").alias("_feature", "_bin"))
    counts = one.groupBy(*node, "_feature", "_bin").agg(*[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(k)])
    whole = Window.partitionBy(*node, "_feature")
    upto = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.select(*node, "_feature", "_bin", *[F.sum(f"_s{i}").over(upto).alias(f"_l{i}") for i in range(k)], *[F.sum(f"_s{i}").over(whole).alias(f"_a{i}") for i in range(k)])
    left, all_ = [F.col(f"_l{i}") for i in range(k)], [F.col(f"_a{i}") for i in range(k)]
    right = [a - b for a, b in zip(all_, left)]
    size = (lambda s: reduce(Column.__add__, s)) if impurity is _gini else (lambda s: s[0])
    gain = F.round(1 - F.try_divide(impurity(left) + impurity(right), impurity(all_)), DIGITS)
    fits = (gain > 0) & (size(left) >= min_rows) & (size(right) >= min_rows)
    if subset is not None and subset < features:
        place = lambda f: F.xxhash64(F.lit(seed), F.col("_tree"), F.col("_node"), f)
        ahead = reduce(Column.__add__, [(place(F.lit(g)) < place(F.col("_feature"))).cast("int") for g in range(features)])
        fits = fits & (ahead < subset)
    found = F.struct(gain.alias("gain"), (-F.col("_feature")).alias("f"), (-F.col("_bin")).alias("b"), F.array(*left).alias("l"), F.array(*right).alias("r"))
    best = sums.groupBy(*node).agg(F.max(F.when(fits, found)).alias("_best"), F.max(F.when(F.col("_feature") == 0, F.array(*all_))).alias("_all"))
    return best.select(*node, "_all", (-F.col("_best.f")).alias("_feature"), (-F.col("_best.b")).alias("_bin"), F.col("_best.l").alias("_left"), F.col("_best.r").alias("_right"))


def _spread(entries: DataFrame, keys: list[str], slots: int, *columns: str) -> DataFrame:
    """One row per group, for each column an array over the slots, null where there is no entry."""
    held = entries.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct(*columns)))).alias("_m"), F.first("n").alias("n"))
    dense = held.select(*keys, "n", F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.element_at("_m", i)).alias("_a"))
    field = lambda c: lambda e: e[c]
    return dense.select(*keys, "n", *[F.transform("_a", field(c)).alias(c) for c in columns])


def _with_splits(levels: list[DataFrame], keys: list[str], trees: int, width: int) -> DataFrame:
    """Per group the splits so far, as arrays over tree * width + node; `n` is the weight of its first tree."""
    nodes = reduce(DataFrame.unionByName, levels)
    n = F.max(F.when(F.col("_node") == 1, F.aggregate("_all", F.lit(0.0), lambda a, e: a + F.abs(e)))).over(Window.partitionBy(*keys)).cast("long")
    at = F.col("_tree") * width + F.col("_node")
    return _spread(nodes.withColumns({"n": n, "at": at}).where("_feature IS NOT NULL"), keys, trees * width, "_feature", "_bin")


def _with_leaves(nodes: DataFrame, keys: list[str], trees: int, width: int, shares: bool) -> DataFrame:
    """Per group `_feature` and `_cut` of the nodes that split and `_value`, class shares or mean, of all nodes."""
    at, none = F.col("_tree") * width + F.col("_node"), F.lit(None)
    child = F.col("_tree") * width + F.col("_node") * 2
    one = F.array(
        F.struct(at.alias("at"), F.col("_feature"), F.col("_cut"), F.when(F.col("_node") == 1, F.col("_all")).alias("s")),
        *[F.struct((child + i).alias("at"), none.cast("int").alias("_feature"), none.cast("double").alias("_cut"), F.col(side).alias("s")) for i, side in enumerate(("_left", "_right"))],
    )
    each = nodes.select(*keys, F.explode(one).alias("e")).groupBy(*keys, F.col("e.at").alias("at")).agg(*[F.max(f"e.{c}").alias(c) for c in ("_feature", "_cut", "s")])
    total = F.aggregate("s", F.lit(0.0), lambda a, e: a + e)
    value = F.transform("s", lambda e: e / total) if shares else F.array(F.get("s", F.lit(1)) / F.get("s", F.lit(0)))
    return _spread(each.where("s IS NOT NULL").withColumns({"_value": value, "n": F.lit(0)}), keys, trees * width, "_feature", "_cut", "_value").drop("n")
