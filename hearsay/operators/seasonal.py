"""Seasonal ARIMA order search, refit and forecast, many series at once.

Differences, lags and residuals are Spark expressions. Spark sums one Gram of
lagged values per series and pair of differences, for starting values. The fits
are conditional least squares by the whole recursion, which depends on its
coefficients at every day: all orders of a series and pair of differences run
side by side over one array of its days, so a task is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from hearsay.functions import seasonal as S
from hearsay.operators.regress import _key_schema, _matrix, _per_row, gram
from hearsay.operators.series import over_days
from hearsay.session import cut_lineage

ORDERS = list(product((0, 1), repeat=6))
FORM = ["_d", "_sd"]


def _attach(rows: DataFrame, few: DataFrame, on: Sequence[str]) -> DataFrame:
    """Join that keeps null keys."""
    named = few.select(*[F.col(k).alias(f"_on{i}") for i, k in enumerate(on)], *[c for c in few.columns if c not in on])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_on{i}")) for i, k in enumerate(on)])
    return rows.join(named, same).drop(*[f"_on{i}" for i in range(len(on))])


def _differenced(df: DataFrame, keys: Sequence[str], day: str, value: str, period: int) -> DataFrame:
    """Every day once for each pair of plain (`_d`) and seasonal (`_sd`) differences.

    `_w` is the differenced value, `_t` its place in the differenced series,
    negative on the days that differencing loses.
    """
    w, y = over_days(keys, day), F.col(value).cast("double")
    forms = []
    for d, sd in product((0, 1), repeat=2):
        out = y - F.lag(y, 1).over(w) if d else y
        if sd:
            out = out - (F.lag(y, period).over(w) - F.lag(y, period + 1).over(w) if d else F.lag(y, period).over(w))
        forms.append(F.struct(F.lit(d).alias("_d"), F.lit(sd).alias("_sd"), F.lit(d + period * sd).alias("_lost"), out.alias("_w")))
    rows = df.select(*keys, day, y.alias("_y"), F.row_number().over(w).alias("_n"), F.array(*forms).alias("_f"))
    rows = rows.withColumn("_f", F.explode("_f"))
    return rows.select(*keys, day, "_y", "_f._d", "_f._sd", "_f._w", (F.col("_n") - 1 - F.col("_f._lost")).alias("_t"))


def _with_past(df: DataFrame, keys: Sequence[str], day: str, value: str, period: int, lags: Sequence[int]) -> tuple[DataFrame, list[str]]:
    """The differenced series and a column for each lag; a value before the series is zero."""
    if period < 2:
        raise ValueError("a season has two days or more")
    rows, w = _differenced(df, keys, day, value, period), over_days([*keys, *FORM], day)
    past = [F.when(F.col("_t") < lag, 0.0).otherwise(F.lag("_w", lag).over(w)).alias(f"_p{lag}") for lag in lags if lag]
    return rows.select("*", F.col("_w").alias("_p0"), *past), [f"_p{lag}" for lag in lags]


SCORED = "`order` string, aic double, bic double, order_spec array<int>, coefficients array<double>, sigma2 double, converged boolean"


def _scored(order: Sequence[int], period: int, fitted: dict) -> tuple:
    label = "(" + ", ".join(map(str, [*order, period])) + ")"
    return label, fitted["aic"], fitted["bic"], list(order), list(fitted["coef"]), fitted["sigma2"], fitted["converged"]


def _on_grams(df: DataFrame, keys: Sequence[str], day: str, value: str, period: int, orders: Sequence[tuple[int, ...]],
              lags: Sequence[int], schema: str, fill) -> DataFrame:
    """`fill(order, fitted)` rows of every order, fitted (None: it can't be) on the Gram of `lags` over the days after its burn-in."""
    rows, past = _with_past(df, keys, day, value, period, lags)
    starts = sorted({S.burn_in(o, period) for o in orders})
    ranged = rows.where(F.col("_t") >= starts[0]).withColumn("_from", F.greatest(
        F.lit(0), *[F.when(F.col("_t") >= start, start).otherwise(0) for start in starts]))
    grams = gram(ranged, [*keys, *FORM, "_from"], past)
    grams = grams.groupBy(*keys, *FORM).agg(F.collect_list(F.struct("_from", "gram")).alias("parts"))

    def solve(row):
        parts, out = [(p["_from"], _matrix(p["gram"])) for p in row.parts], []
        for order in orders:
            if (order[1], order[4]) != (row[len(keys)], row[len(keys) + 1]):
                continue
            usable = [m for start, m in parts if start >= S.burn_in(order, period)]
            whole = sum(usable) if usable else np.zeros((2, 2))
            fitted = S.fit(whole[1:, 1:], int(whole[0, 0]), order, lags, period)
            out += [(*row[: len(keys)], *made) for made in fill(order, fitted)]
        return out

    return _per_row(grams, solve, f"{_key_schema(df, keys)}, {schema}")


def _days(df: DataFrame, keys: Sequence[str], day: str, value: str, period: int) -> DataFrame:
    """One row per series and pair of differences: `_s`, its days in order, and `_x`, what the recursion sees of the differenced ones.

    That is the value and the three that autoregressive terms reach; null where
    one of them is null, zero where it lies before the first.
    """
    rows = _differenced(df, keys, day, value, period)
    whole = F.sort_array(F.collect_list(F.struct(F.col(day).alias("_day"), "_y", "_t", "_w")))
    rows = rows.groupBy(*keys, *FORM).agg(whole.alias("_s"))
    rows = rows.withColumn("_v", F.transform(F.filter("_s", lambda x: x["_t"] >= 0), lambda x: x["_w"]))

    def seen(_, t):
        near = F.array(*[F.when(t < lag, 0.0).otherwise(F.get("_v", t - lag)) for lag in (0, 1, period, period + 1)])
        return F.when(~F.exists(near, lambda v: v.isNull()), near)

    return rows.select(*keys, *FORM, "_s", F.transform("_v", seen).alias("_x"))


def _residual(x: Column, coef: Column, before) -> Column:
    """The residual of a day; `before` gives that of so many days before."""
    phi, theta, big_phi, big_theta = (coef[i] for i in range(4))
    own = x[0] - phi * x[1] - big_phi * x[2] + phi * big_phi * x[3]
    return own - theta * before(0) - big_theta * before(1) - theta * big_theta * before(2)


def sarima_grid(df: DataFrame, keys: Sequence[str], day: str, value: str, period: int = 20,
                orders: Sequence[tuple[int, ...]] = tuple(ORDERS), lags: Sequence[int] | None = None) -> DataFrame:
    """AIC, BIC, coefficients and variance of every order (p, d, q, P, D, Q) per series.

    Days must be complete. A day that is null, or has a null among the values
    its autoregressive terms reach, has no residual and is left out of the sums.
    Each order is fitted on the days after its burn-in, as by a state-space fit;
    without enough days, or without a rest to explain, an order is left out.
    Residuals come from the whole recursion. Every order is fitted from two
    starts, zero and the fit on moving averages expanded to a few lags
    (`functions.seasonal.reach`); the smaller sum counts. `lags`, from 0 on, asks
    for moving averages expanded to these lags instead, in one pass.
    """
    keys, orders = list(keys), [tuple(o) for o in orders]
    if lags is not None:
        return _on_grams(df, keys, day, value, period, orders, sorted(lags), SCORED,
                         lambda order, fitted: [_scored(order, period, fitted)] if fitted else [])
    names = [*keys, *FORM]
    near = _on_grams(df, keys, day, value, period, orders, S.reach(period), "_form_d int, _form_sd int, order_spec array<int>, coef array<double>",
                     lambda order, fitted: [(order[1], order[4], list(order), list(fitted["coef"] if fitted else np.zeros(4)))])
    near = near.withColumnsRenamed({"_form_d": "_d", "_form_sd": "_sd"}).groupBy(*names).agg(
        F.sort_array(F.collect_list(F.struct("order_spec", "coef"))).alias("starts"))
    days = _attach(_days(df, keys, day, value, period).select(*names, F.col("_x").alias("seen")), near, names)

    def solve(row):
        x = np.array([[np.nan] * 4 if v is None else v for v in row.seen], dtype=float).reshape(len(row.seen), 4)
        tasks = [(tuple(int(i) for i in s["order_spec"]), c) for s in row.starts for c in ([0.0] * 4, s["coef"])]
        best = {}
        for (order, _), fitted in zip(tasks, S.fit_whole(x, tasks, period)):
            if fitted and (order not in best or fitted["sigma2"] < best[order]["sigma2"]):
                best[order] = fitted
        return [(*row[: len(keys)], *_scored(order, period, fitted)) for order, fitted in best.items()]

    return _per_row(spread_groups(days), solve, f"{_key_schema(df, keys)}, {SCORED}")


def spread_groups(groups: DataFrame, most: int = 10_000) -> DataFrame:
    """A task per row, a series and a pair of differences, up to `most` tasks; a plain shuffle would be merged by its bytes."""
    held = cut_lineage(groups)
    numbered = held.withColumn("_place", F.monotonically_increasing_id())
    return numbered.repartitionByRange(max(1, min(held.count(), most)), "_place").drop("_place")


def best_order(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The order with the smallest AIC per series."""
    w = Window.partitionBy(*keys).orderBy("aic", "order")
    return grid.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def _chosen(df, keys, day, value, best, period):
    """The days of each series under its chosen order, with `_e`, the residual by the whole recursion."""
    best = best.select(*keys, F.col("order_spec")[1].alias("_d"), F.col("order_spec")[4].alias("_sd"), "order_spec", "coefficients", "sigma2")
    rows = _attach(_days(df, keys, day, value, period), best, [*keys, *FORM])

    def ahead(past, x):
        before = [F.coalesce(F.get(past, F.size(past) - lag), F.lit(0.0)) for lag in (1, period, period + 1)]
        made = _residual(x, F.col("coefficients"), lambda k: before[k])
        return F.concat(past, F.array(F.when(x.isNotNull(), made)))

    rows = rows.withColumn("_e", F.aggregate("_x", F.array().cast("array<double>"), ahead))
    rows = rows.select(*keys, "order_spec", "coefficients", "sigma2", "_e", F.explode("_s").alias("_s"))
    return rows.select(*keys, F.col("_s._day").alias(day), "_s._y", "_s._t", F.get("_e", F.col("_s._t").cast("int")).alias("_e"),
                       "order_spec", "coefficients", "sigma2")


def fit_best(df: DataFrame, keys: Sequence[str], day: str, value: str, best: DataFrame, period: int = 20,
             lags: Sequence[int] | None = None) -> DataFrame:
    """Each series under its chosen order, a row of `sarima_grid`: (keys, day, value, fitted, residual).

    There is no residual on rows lost to differencing, nor next to nulls. The
    recursion is whole, whatever `lags` the search started from.
    """
    rows = _chosen(df, list(keys), day, value, best, period)
    return rows.select(*keys, F.col(day).alias("day"), F.col("_y").alias("value"), (F.col("_y") - F.col("_e")).alias("fitted"),
                       F.col("_e").alias("residual"))


def forecast(df: DataFrame, keys: Sequence[str], day: str, value: str, best: DataFrame, period: int = 20,
             steps: int = 30, lags: Sequence[int] | None = None) -> DataFrame:
    """Forecast with 95 percent bounds: (keys, date, predicted_mean, lower_bound, upper_bound).

    The recursion sees the last 2 * period + 2 days; a series with a null value
    or residual among them has no forecast.
    """
    keys = list(keys)
    rows = _chosen(df, keys, day, value, best, period)
    rows = rows.withColumn("_r", F.row_number().over(over_days(keys, F.desc(day)))).where(F.col("_r") <= 2 * period + 2)
    shock = F.when(F.col("_t") < 0, 0.0).otherwise(F.col("_e"))
    recent = rows.groupBy(*keys, "order_spec", "coefficients", "sigma2").agg(
        F.max(day).alias("last_day"), F.sort_array(F.collect_list(F.struct(F.col(day).alias("_day"), "_y", shock.alias("_e")))).alias("_s"))
    recent = recent.select(*keys, "last_day", "order_spec", "coefficients", "sigma2",
                           F.col("_s._y").alias("past_values"), F.col("_s._e").alias("past_shocks"))
    recent = recent.where(~F.exists("past_values", lambda x: x.isNull()) & ~F.exists("past_shocks", lambda x: x.isNull()))

    def ahead(row):
        made = S.forecast(row.past_values, row.past_shocks, row.order_spec, row.coefficients, row.sigma2, period, steps)
        return [(*row[: len(keys)], row.last_day + pd.Timedelta(days=h), *bounds) for h, bounds in enumerate(made, 1)]

    return _per_row(recent, ahead, f"{_key_schema(df, keys)}, date date, predicted_mean double, lower_bound double, upper_bound double")
