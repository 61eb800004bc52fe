"""M rows of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay.catalog import inputs as I
from hearsay.catalog.aggregates import rounded
from hearsay.catalog.registry import query
from hearsay.operators import learn as L, trees as T

ORDER_SQL = "o AS (SELECT o_orderkey, o_custkey, o_totalprice, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y FROM orders)"
DRAW = "('0x' || substr(md5('{seed}-' || {key}), 1, 8))::BIGINT % 10000"


@query("m1_features", "SELECT l_orderkey, l_linenumber, l_quantity AS x0, l_discount AS x1 FROM lineitem")
def m1(spark, sf):
    from pyspark.ml.functions import vector_to_array

    df = L.features(I.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), ["l_quantity", "l_discount"])
    return df.select("l_orderkey", "l_linenumber", vector_to_array("features")[0].alias("x0"), vector_to_array("features")[1].alias("x1"))


@query("m2_split", f"SELECT o_orderkey, {DRAW.format(seed=1, key='o_orderkey')} < 8000 AS train FROM orders")
def m2(spark, sf):
    train, test = L.split(I.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return train.withColumn("train", F.lit(True)).unionByName(test.withColumn("train", F.lit(False)))


def lines(spark, sf):
    df = I.table(spark, sf, "lineitem")
    return df.withColumn("key", F.concat_ws("/", "l_orderkey", "l_linenumber"))


LINES_SQL = f"""l AS (SELECT l_orderkey || '/' || l_linenumber AS key, l_quantity AS x, l_extendedprice AS y FROM lineitem),
s AS (SELECT *, {DRAW.format(seed=1, key='key')} < 8000 AS train FROM l),
c AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM s WHERE train)"""


@query("m3_linear_evaluation", f"""WITH {LINES_SQL}, e AS (SELECT y, y - (a + b * x) AS e FROM s, c WHERE NOT train)
SELECT count(*)::BIGINT AS n, round(sqrt(avg(e * e)), 4) AS rmse, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2 FROM e""")
def m3(spark, sf):
    train, test = L.split(lines(spark, sf), "key")
    out = L.linear_evaluation(train, test, "l_quantity", "l_extendedprice")
    return out.select("n", F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


@query("m3_linear_coefficients", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, "
       "round(regr_r2(l_extendedprice, l_quantity), 6) AS r2_train, count(*)::BIGINT AS n_train FROM lineitem GROUP BY 1")
def m3b(spark, sf):
    out = L.linear_coefficients(I.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return out.withColumns({"slope": F.round("slope", 4), "intercept": F.round("intercept", 3), "r2_train": F.round("r2_train", 6)})


@query("m3_linear_model_one_feature", f"WITH {LINES_SQL} SELECT key, round(a + b * x, 2) AS prediction FROM s, c WHERE NOT train")
def m3d(spark, sf):
    train, test = L.split(lines(spark, sf), "key")
    model = L.fit_linear(train, ["l_quantity"], "l_extendedprice")
    return model.transform(test).select("key", F.round("prediction", 2).alias("prediction"))


TWO_FEATURES_SQL = f"""WITH l AS (SELECT l_orderkey || '/' || l_linenumber AS key, l_quantity::DOUBLE AS x, l_discount::DOUBLE AS z, l_extendedprice::DOUBLE AS y FROM lineitem),
s AS (SELECT *, {DRAW.format(seed=1, key='key')} < 8000 AS train FROM l),
v AS (SELECT avg(y) AS my, avg(x) AS mx, avg(z) AS mz, var_pop(x) AS a, var_pop(z) AS b, covar_pop(x, z) AS c, covar_pop(y, x) AS yx, covar_pop(y, z) AS yz FROM s WHERE train),
f AS (SELECT *, (yx * b - yz * c) / (a * b - c * c) AS bx, (yz * a - yx * c) / (a * b - c * c) AS bz FROM v)
SELECT key, round(my + bx * (x - mx) + bz * (z - mz), 2) AS prediction FROM s, f WHERE NOT train"""


@query("m3_linear_model_two_features", TWO_FEATURES_SQL)
def m3e(spark, sf):
    train, test = L.split(lines(spark, sf), "key")
    model = L.fit_linear(train, ["l_quantity", "l_discount"], "l_extendedprice")
    return model.transform(test).select("key", F.round("prediction", 2).alias("prediction"))


@query("m3_linear_model", TWO_FEATURES_SQL.replace(", 2) AS prediction", ", 3) AS prediction"))
def m3c(spark, sf):
    train, test = L.split(lines(spark, sf), "key")
    model = L.fit_linear(train, ["l_quantity", "l_discount"], "l_extendedprice")
    return model.transform(test).select("key", F.round("prediction", 3).alias("prediction"))


def classed_events(spark, sf):
    """Events with a three-way class of the value, and an hour feature."""
    e = I.table(spark, sf, "events")
    return e.select("event_id", "event_type", F.hour("ts").alias("hour"), F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("k"),
                    F.when(F.col("value") < 20, 0.0).when(F.col("value") < 60, 1.0).otherwise(2.0).alias("y"))


@query("m4_fit_per_group")
def m4(spark, sf):
    return L.fit_per_group(classed_events(spark, sf), "event_type", None, ["k", "hour"], "y", "event_id")


CUTS = {"k": [float(c) for c in range(0, 100, 5)], "hour": [float(c) for c in range(23)]}
CLASSES = [0.0, 1.0, 2.0]


def tree_sql(depth: int, group: str, train: str = "true", classes: list[float] | None = CLASSES) -> str:
    """Ending in `node`, every row's leaf, and `leaf`, the leaves' sums: trees over the fixed cuts, one per group, level by level."""
    sums = [f"sum((y = {c})::INT)::DOUBLE" for c in classes] if classes else ["count(*)::DOUBLE", "sum(y)", "sum(y * y)"]
    size = "+".join("{s}%d" % i for i in range(len(sums))) if classes else "{s}0"
    impure = (f"({size} - coalesce(({'+'.join('{s}%d*{s}%d' % (i, i) for i in range(len(sums)))}) / nullif({size}, 0), 0))" if classes
              else "({s}2 - coalesce({s}1*{s}1 / nullif({s}0, 0), 0))")
    parts = [f"""e AS (SELECT event_id, {group} AS g, hour(ts)::DOUBLE AS hour, nullif(regexp_extract(props, '([0-9]+)', 1), '')::DOUBLE AS k, value,
    CASE WHEN value < 20 THEN 0.0 WHEN value < 60 THEN 1.0 ELSE 2.0 END::DOUBLE AS y FROM events),
n0 AS (SELECT *, 1 AS node, {train} AS train FROM e WHERE k IS NOT NULL AND hour IS NOT NULL),
cuts AS (SELECT 0 AS f, unnest([{', '.join(map(str, CUTS['k']))}]) AS c UNION ALL SELECT 1, unnest([{', '.join(map(str, CUTS['hour']))}]))"""]
    for d in range(depth):
        every = ", ".join(f"{s} AS a{i}" for i, s in enumerate(sums))
        left = ", ".join(f"coalesce(sum(l{i}) FILTER (x <= c), 0) AS l{i}" for i in range(len(sums)))
        each = ", ".join(f"{s} AS l{i}" for i, s in enumerate(sums))
        right = {f"r{i}": f"(a{i} - l{i})" for i in range(len(sums))}
        spelled = lambda text, s: text.replace("{s}", s)
        rights, right_size = spelled(impure, "r"), spelled(size, "r")
        for name, value in right.items():
            rights, right_size = rights.replace(name, value), right_size.replace(name, value)
        parts.append(f"""h{d} AS (SELECT g, node, f, x, {each} FROM (SELECT g, node, y, 0 AS f, k AS x FROM n{d} WHERE train UNION ALL SELECT g, node, y, 1, hour FROM n{d} WHERE train)
    GROUP BY g, node, f, x),
t{d} AS (SELECT g, node, {every} FROM n{d} WHERE train GROUP BY g, node),
s{d} AS (SELECT g, node, f, c, {left} FROM h{d} JOIN cuts USING (f) GROUP BY g, node, f, c),
b{d} AS (SELECT g, node, f, c, round(1 - ({spelled(impure, 'l')} + {rights}) / nullif({spelled(impure, 'a')}, 0), 9) AS gain FROM s{d} JOIN t{d} USING (g, node)
    WHERE ({spelled(size, 'l')}) >= 1 AND ({right_size}) >= 1 AND gain > 0 QUALIFY row_number() OVER (PARTITION BY g, node ORDER BY gain DESC, f, c) = 1),
n{d + 1} AS (SELECT n.* REPLACE (CASE WHEN b.c IS NULL THEN n.node ELSE 2 * n.node + (CASE b.f WHEN 0 THEN n.k ELSE n.hour END > b.c)::INT END AS node)
    FROM n{d} n LEFT JOIN b{d} b ON n.g = b.g AND n.node = b.node AND n.node >= {2 ** d})""")
    parts.append(f"node AS (SELECT * FROM n{depth}), leaf AS (SELECT g, node, {', '.join(f'{s} AS a{i}' for i, s in enumerate(sums))} FROM node WHERE train GROUP BY g, node)")
    return ",\n".join(parts)


CLASS = "CASE WHEN a0 >= a1 AND a0 >= a2 THEN 0.0 WHEN a1 >= a2 THEN 1.0 ELSE 2.0 END::DOUBLE"


@query("m4_tree_per_group", f"WITH {tree_sql(3, 'event_type')} SELECT event_id, event_type, {CLASS} AS prediction, round(a1 / (a0 + a1 + a2), 9) AS share FROM node "
       "JOIN leaf USING (g, node) JOIN events USING (event_id)")
def m4b(spark, sf):
    """A tree of depth 3 for every kind of event, all in one job per level."""
    events = classed_events(spark, sf)
    forest = T.grow_forest(events, ["k", "hour"], "y", ["event_type"], depth=3, classes=CLASSES, cuts=CUTS)
    out = T.predict_forest(forest, events, scores="shares").where("prediction IS NOT NULL")
    return out.select("event_id", "event_type", "prediction", F.round(F.get("shares", F.lit(1)), 9).alias("share"))


USERS = "'u' || (user_id % 500)"


@query("m4_regression_tree_of_many_groups", f"WITH {tree_sql(2, USERS, classes=None)} SELECT event_id, round(a1 / a0, 6) AS prediction FROM node JOIN leaf USING (g, node)")
def m4c(spark, sf):
    """A regression tree of depth 2 for each of several hundred groups of users."""
    events = classed_events(spark, sf).join(I.table(spark, sf, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id") % 500).alias("g")), "event_id")
    forest = T.grow_forest(events, ["k", "hour"], "y", ["g"], depth=2, cuts=CUTS)
    return T.predict_forest(forest, events).where("prediction IS NOT NULL").select("event_id", F.round("prediction", 6).alias("prediction"))


def guesses(spark, sf):
    """A label and a rule-based guess for every order."""
    o = I.table(spark, sf, "orders")
    label = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    guess = F.when(F.col("o_totalprice") < 100000, 0).when(F.col("o_totalprice") < 250000, 1).otherwise(3)
    return o.select("o_orderpriority", label.alias("label"), guess.alias("prediction"))


GUESS_SQL = """g AS (SELECT o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label,
CASE WHEN o_totalprice < 100000 THEN 0 WHEN o_totalprice < 250000 THEN 1 ELSE 3 END AS prediction FROM orders)"""


@query("m5_accuracy", f"WITH {GUESS_SQL} SELECT o_orderpriority, round(avg((label = prediction)::INT), 6) AS accuracy FROM g GROUP BY 1")
def m5(spark, sf):
    return rounded(L.accuracy(guesses(spark, sf), keys=["o_orderpriority"]))


@query("m6_confusion_matrix", f"WITH {GUESS_SQL} SELECT label, " + ", ".join(f'(count(*) FILTER (prediction = {c}))::BIGINT AS "{c}"' for c in (0, 1, 2, 3)) + " FROM g GROUP BY 1")
def m6(spark, sf):
    return L.confusion_matrix(guesses(spark, sf), [0, 1, 2, 3])


@query("m7_classification_report", f"""WITH {GUESS_SQL}, cl AS (SELECT label AS c FROM g UNION SELECT prediction FROM g),
k AS (SELECT c, (SELECT count(*) FROM g WHERE label = c) AS support, (SELECT count(*) FROM g WHERE prediction = c) AS predicted, (SELECT count(*) FROM g WHERE label = c AND prediction = c) AS tp FROM cl),
pr AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM k), f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM pr)
SELECT c::VARCHAR AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support::DOUBLE AS support FROM f
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6) FROM f
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), sum(support)::DOUBLE FROM f
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::DOUBLE FROM f""")
def m7(spark, sf):
    return rounded(L.classification_report(guesses(spark, sf)))


TRAIN = DRAW.format(seed=123, key="event_id") + " < 8000"
STUMPS = {"stump": {"depth": 1, "cuts": CUTS}, "tree of depth 3": {"depth": 3, "cuts": CUTS}}


@query("m8_compare_trees", " UNION ALL ".join(f"""SELECT * FROM (WITH {tree_sql(d, "''", TRAIN)} SELECT '{name}' AS model, round(avg((y = {CLASS})::INT), 6) AS accuracy
FROM node JOIN leaf USING (g, node) WHERE NOT train)""" for d, name in ((1, "stump"), (3, "tree of depth 3"))))
def m8c(spark, sf):
    train, test = L.split(classed_events(spark, sf), "event_id", seed=123)
    return rounded(L.compare_trees(train, test, ["k", "hour"], "y", "event_id", STUMPS))


@query("m8_compare_regression_trees", " UNION ALL ".join(f"""SELECT * FROM (WITH {tree_sql(d, "''", TRAIN, None)} SELECT '{name}' AS model, round(sqrt(avg((y - a1 / a0) * (y - a1 / a0))), 6) AS rmse
FROM node JOIN leaf USING (g, node) WHERE NOT train)""" for d, name in ((1, "stump"), (3, "tree of depth 3"))))
def m8d(spark, sf):
    train, test = L.split(classed_events(spark, sf), "event_id", seed=123)
    return rounded(L.compare_trees(train, test, ["k", "hour"], "y", "event_id", STUMPS, "rmse"))


@query("m8_compare_classifiers")
def m8(spark, sf):
    train, test = L.split(classed_events(spark, sf), "event_id", seed=123)
    return rounded(L.compare_models(train, test, ["k", "hour"], "y", L.default_classifiers("y")))


@query("m8_compare_regressors")
def m8b(spark, sf):
    train, test = L.split(classed_events(spark, sf), "event_id", seed=123)
    return rounded(L.compare_models(train, test, ["k", "hour"], "y", L.default_regressors("y"), "rmse"))
