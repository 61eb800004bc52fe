"""Lagged regressions per series, and the tests and forecasts built on them.

Lags come from Spark windows. The cross-product (Gram) matrix of a regression
is summed by Spark: every task reduces its batches to one matrix per series,
and the matrices are added element by element in a grouped aggregation. Only
that small finished matrix reaches the solver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from hearsay.functions.stats import (
    ADF_CRITICAL, adf_critical, adf_p_value, chi2_tail, default_adf_lags, durbin_levinson, solve_gram,
)
from hearsay.operators.series import _key_schema, _per_row, acf, over_days
from hearsay.session import ship_package


def with_lags(df: DataFrame, keys: Sequence[str], day: str, cols: Sequence[str], lags: int,
              before_start: float | None = None) -> DataFrame:
    """Columns `c_lag1 .. c_lagN` and the row's position `_t` (0-based) in its series.

    `before_start` stands in for values before the first row; a null inside the
    series stays null.
    """
    w = over_days(keys, day)
    lagged = [F.lag(c, i, before_start).over(w).alias(f"{c}_lag{i}") for c in cols for i in range(1, lags + 1)]
    return df.select("*", *lagged, (F.row_number().over(w) - 1).alias("_t"))


def gram(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Cross-product matrix of (1, *cols) per key: columns keys, `gram` (flat, row by row).

    Rows with a null in any of the columns are left out.
    """
    ship_package(df.sparkSession)
    keys, cols = list(keys), list(cols)
    rows = df.select(*keys, F.array(F.lit(1.0), *[F.col(c).cast("double") for c in cols]).alias("_x"))
    rows = rows.where(~F.exists("_x", lambda v: v.isNull()))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + ", gram array<double>"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, part in batch.groupby(keys, sort=False, dropna=False):
                x = np.stack(part["_x"].to_numpy())
                out.append((*key, (x.T @ x).ravel()))
            if out:
                yield pd.DataFrame(out, columns=[*keys, "gram"])

    cells = rows.mapInPandas(partial, schema).select(*keys, F.posexplode("gram").alias("_pos", "_v"))
    summed = cells.groupBy(*keys, "_pos").agg(F.sum("_v").alias("_v"))
    # One list of (columns + 1) squared numbers per key.
    return summed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_pos", "_v"))).alias("_s")).select(
        *keys, F.col("_s._v").alias("gram")
    )


def _matrix(flat) -> np.ndarray:
    side = math.isqrt(len(flat))
    return np.asarray(flat, dtype=float).reshape(side, side)


def lag_ols(df: DataFrame, keys: Sequence[str], day: str, y: str, xs: Sequence[str], lags: int) -> DataFrame:
    """Regress y on a constant and lags 1..n of the xs: one row per coefficient, with SSR and n."""
    lagged = with_lags(df, keys, day, xs, lags)
    cols = [f"{x}_lag{i}" for x in xs for i in range(1, lags + 1)]
    terms = ["const", *cols]

    def solve(row):
        m = _matrix(row.gram)
        beta, ssr, _ = solve_gram(m, list(range(len(terms))), len(terms))
        key = tuple(row[: len(keys)])
        return [(*key, t, float(b), ssr, int(m[0, 0])) for t, b in zip(terms, beta)]

    schema = f"{_key_schema(df, keys)}, term string, coefficient double, ssr double, n bigint"
    return _per_row(gram(lagged, keys, [*cols, y]), solve, schema)


def lag_ols_one(df: DataFrame, keys: Sequence[str], day: str, y: str, x: str, lag: int = 1) -> DataFrame:
    """One-lag regression with built-in aggregates only."""
    prior = df.select(*keys, F.col(y).alias("_y"), F.lag(x, lag).over(over_days(keys, day)).alias("_x"))
    prior = prior.where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    return prior.groupBy(*keys).agg(
        F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"),
        F.regr_r2("_y", "_x").alias("r2"), F.count(F.lit(1)).alias("n"),
    )


def pacf(df: DataFrame, keys: Sequence[str], day: str, value: str, nlags: int | None = None) -> DataFrame:
    """Partial autocorrelations by Durbin-Levinson on the autocorrelations, at all lags unless `nlags` says fewer."""
    rho = acf(df, keys, day, value, nlags).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("lag", "acf"))).alias("_s"), F.first("bound95").alias("bound95")
    ).select(*keys, F.col("_s.acf").alias("rho"), "bound95")

    def solve(row):
        key = tuple(row[: len(keys)])
        return [(*key, k, float(p), row.bound95) for k, p in enumerate(durbin_levinson(np.asarray(row.rho, float)))]

    return _per_row(rho, solve, f"{_key_schema(df, keys)}, lag int, pacf double, bound95 double")


def adf(df: DataFrame, keys: Sequence[str], day: str, value: str, max_lag: int | None = None,
        signif: float = 0.05) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant; lags chosen by AIC up to `max_lag`.

    All lag orders are compared on one common sample; the chosen one is then
    refitted on every row it can use. Both come from the same lagged table: the
    Gram is kept per range of starting rows, so a refit is a sum of Grams.
    Without `max_lag` the longest series decides, by `default_adf_lags`. A series
    that its lags explain without a rest, such as a straight line, has no result.
    """
    if max_lag is None:
        longest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"]
        max_lag = max(0, default_adf_lags(longest or 0))
    w = over_days(keys, day)
    base = df.select(*keys, day, F.col(value).cast("double").alias("_y"))
    first = F.row_number().over(w) == 1
    step = F.when(first, F.lit(0.0)).otherwise(F.col("_y") - F.lag("_y").over(w))
    base = base.select("*", step.alias("_dy"), F.lag("_y").over(w).alias("_level"))
    lagged = with_lags(base, keys, day, ["_dy"], max_lag, 0.0)
    cols = ["_level", *[f"_dy_lag{i}" for i in range(1, max_lag + 1)], "_dy"]
    # Row t can serve orders up to t - 1; rows at the start are grouped by that number.
    usable = F.least(F.col("_t") - 1, F.lit(max_lag))
    ranged = lagged.where(F.col("_t") >= 1).withColumn("_order", usable)
    grams = gram(ranged, [*keys, "_order"], cols)
    rows = grams.groupBy(*keys).agg(F.collect_list(F.struct("_order", "gram")).alias("parts"))

    def solve(row):
        key = tuple(row[: len(keys)])
        parts = {int(p["_order"]): _matrix(p["gram"]) for p in row.parts}
        y = max_lag + 2
        common = parts.get(max_lag)
        if common is None:
            return []
        n = common[0, 0]
        best = None
        for k in range(max_lag + 1):
            _, ssr, _ = solve_gram(common, list(range(2 + k)), y)
            if n <= 2 + k or ssr <= 1e-12 * common[y, y]:
                continue
            aic = n * (math.log(2 * math.pi * ssr / n) + 1) + 2 * (2 + k)
            if best is None or aic < best[0]:
                best = (aic, k)
        if best is None:
            return []
        k = best[1]
        full = sum(m for order, m in parts.items() if order >= k)
        beta, ssr, inv = solve_gram(full, list(range(2 + k)), y)
        n = int(full[0, 0])
        if ssr <= 1e-12 * full[y, y]:
            return []
        tau = beta[1] / math.sqrt(ssr / (n - 2 - k) * inv[1, 1])
        p = adf_p_value(tau)
        return [(*key, tau, p, k, n, *[adf_critical(level, n) for level in ADF_CRITICAL], p <= signif)]

    schema = (f"{_key_schema(df, keys)}, statistic double, p_value double, n_lags int, n_obs bigint, "
              "critical_1 double, critical_5 double, critical_10 double, stationary boolean")
    return _per_row(rows, solve, schema)


def granger_tests(df: DataFrame, keys: Sequence[str], day: str, cols: Sequence[str], max_lag: int = 12) -> DataFrame:
    """Chi-square statistic and p-value for each ordered pair of columns and each lag 1..max_lag.

    One Gram over the lags of all columns serves every pair and every lag: the
    restricted and the full regression are sub-matrices of it. Lag k may use
    rows from k on, so Grams are kept per range of starting rows and added.
    A lag with too few rows, or a full regression without a rest, has no result.
    """
    lagged = with_lags(df.select(*keys, day, *[F.col(c).cast("double").alias(c) for c in cols]), keys, day, cols, max_lag, 0.0)
    names = [f"{c}_lag{i}" for c in cols for i in range(1, max_lag + 1)]
    ranged = lagged.where(F.col("_t") >= 1).withColumn("_order", F.least("_t", F.lit(max_lag)))
    grams = gram(ranged, [*keys, "_order"], [*names, *cols])
    rows = grams.groupBy(*keys).agg(F.collect_list(F.struct("_order", "gram")).alias("parts"))
    at = {c: 1 + i * max_lag for i, c in enumerate(cols)}
    y_at = {c: 1 + len(names) + i for i, c in enumerate(cols)}

    def solve(row):
        key = tuple(row[: len(keys)])
        parts = {int(p["_order"]): _matrix(p["gram"]) for p in row.parts}
        out = []
        for k in range(1, max_lag + 1):
            found = [m for order, m in parts.items() if order >= k]
            full = sum(found) if found else None
            if full is None or full[0, 0] <= 2 * k + 1:
                continue
            n = full[0, 0]
            for y in cols:
                own = [0, *range(at[y], at[y] + k)]
                _, restricted, _ = solve_gram(full, own, y_at[y])
                for x in cols:
                    if x == y:
                        continue
                    _, joint, _ = solve_gram(full, [*own, *range(at[x], at[x] + k)], y_at[y])
                    stat = float(n * (restricted - joint) / joint) if joint > 0 else math.inf
                    out.append((*key, y, x, k, stat, chi2_tail(stat, k) if math.isfinite(stat) else 0.0))
        return out

    return _per_row(rows, solve, f"{_key_schema(df, keys)}, response string, cause string, lag int, statistic double, p_value double")


def granger_matrix(df: DataFrame, keys: Sequence[str], day: str, cols: Sequence[str], max_lag: int = 12,
                   digits: int = 4) -> DataFrame:
    """For each ordered pair, the smallest chi-square p-value over lags 1..max_lag; 1 for a column and itself."""
    tests = granger_tests(df, keys, day, cols, max_lag)
    pairs = tests.groupBy(*keys, "response", "cause").agg(F.min(F.round("p_value", digits)).alias("p_value"))
    own = F.explode(F.array(*[F.lit(c) for c in cols]))
    same = df.select(*keys).distinct().select(*keys, own.alias("response"))
    return pairs.unionByName(same.select(*keys, "response", F.col("response").alias("cause"), F.lit(1.0).alias("p_value")))


def _var_design(df, keys, day, cols, lags):
    lagged = with_lags(df.select(*keys, day, *[F.col(c).cast("double").alias(c) for c in cols]), keys, day, cols, lags, 0.0)
    names = [f"{c}_lag{i}" for i in range(1, lags + 1) for c in cols]
    return lagged, names


def _var_criteria(m: np.ndarray, order: int, k: int, width: int) -> tuple | None:
    n = m[0, 0]
    xs, ys = list(range(1 + order * k)), list(range(width, width + k))
    if n <= len(xs):
        return None
    beta = np.column_stack([solve_gram(m, xs, y)[0] for y in ys])
    sigma = (m[np.ix_(ys, ys)] - beta.T @ m[np.ix_(xs, ys)]) / n
    sign, log_det = np.linalg.slogdet(sigma)
    if sign <= 0:
        return None
    params = order * k * k + k
    fpe = ((n + len(xs)) / (n - len(xs))) ** k * math.exp(log_det)
    return (log_det + 2 * params / n, log_det + math.log(n) * params / n, fpe,
            log_det + 2 * math.log(math.log(n)) * params / n, int(n))


def var_select(df: DataFrame, keys: Sequence[str], day: str, cols: Sequence[str], max_lag: int = 20,
               common_sample: bool = True) -> DataFrame:
    """AIC, BIC, FPE and HQIC of vector autoregressions of order 1..max_lag.

    With `common_sample` all orders use the rows the longest can use; else each
    order uses every row it can. One Gram table serves all orders.
    """
    lagged, names = _var_design(df, keys, day, cols, max_lag)
    ranged = lagged.where(F.col("_t") >= 1).withColumn("_order", F.least("_t", F.lit(max_lag)))
    grams = gram(ranged, [*keys, "_order"], [*names, *cols])
    rows = grams.groupBy(*keys).agg(F.collect_list(F.struct("_order", "gram")).alias("parts"))
    k, width = len(cols), 1 + len(names)

    def solve(row):
        key = tuple(row[: len(keys)])
        parts = {int(p["_order"]): _matrix(p["gram"]) for p in row.parts}
        out = []
        for order in range(1, max_lag + 1):
            first = max_lag if common_sample else order
            found = [m for o, m in parts.items() if o >= first]
            scores = _var_criteria(sum(found), order, k, width) if found else None
            if scores:
                out.append((*key, order, *scores))
        return out

    return _per_row(rows, solve, f"{_key_schema(df, keys)}, lag_order int, aic double, bic double, fpe double, hqic double, n bigint")


def var_fit(df: DataFrame, keys: Sequence[str], day: str, cols: Sequence[str], order: int) -> DataFrame:
    """Coefficients of a vector autoregression: (keys, response, coefficients), constant first, then lag by lag."""
    lagged, names = _var_design(df, keys, day, cols, order)
    grams = gram(lagged.where(F.col("_t") >= order), keys, [*names, *cols])
    xs = list(range(1 + len(names)))

    def solve(row):
        m, key = _matrix(row.gram), tuple(row[: len(keys)])
        return [(*key, c, solve_gram(m, xs, len(xs) + i)[0].tolist()) for i, c in enumerate(cols)]

    return _per_row(grams, solve, f"{_key_schema(df, keys)}, response string, coefficients array<double>")


def var_residuals(df: DataFrame, keys: Sequence[str], day: str, cols: Sequence[str], order: int) -> DataFrame:
    """Residuals of the fit, long: (keys, day, response, residual). Fitted values are a Spark expression."""
    lagged, names = _var_design(df, keys, day, cols, order)
    rows = lagged.where(F.col("_t") >= order).select(
        *keys, day, F.array(F.lit(1.0), *names).alias("_x"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("response"), F.col(c).alias("actual")) for c in cols])).alias("_r"),
    ).select(*keys, day, "_x", "_r.*")
    fitted = rows.join(var_fit(df, keys, day, cols, order), [*keys, "response"])
    products = F.zip_with("_x", "coefficients", lambda x, b: x * b)
    estimate = F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)
    return fitted.select(*keys, day, "response", (F.col("actual") - estimate).alias("residual"))


def var_forecast(df: DataFrame, keys: Sequence[str], day: str, cols: Sequence[str], order: int = 13,
                 steps: int = 20) -> DataFrame:
    """Forecast `steps` days: (keys, step, day, *cols). The recursion sees only the last `order` rows."""
    w = over_days(keys, F.desc(day))
    last = df.select(*keys, day, *cols, F.row_number().over(w).alias("_r")).where(F.col("_r") <= order)
    history = last.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_r", F.array(*[F.col(c).cast("double") for c in cols]).alias("v")))).alias("_h"),
        F.max(day).alias("_last"),
    ).select(*keys, F.col("_h.v").alias("recent"), "_last")
    fit = var_fit(df, keys, day, cols, order)
    betas = fit.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("response", "coefficients"))).alias("_b")
    )
    betas = betas.select(*keys, F.array(*[F.col("_b")[c] for c in cols]).alias("betas"))
    rows = history.join(betas, list(keys))

    def solve(row):
        key = tuple(row[: len(keys)])
        recent = [np.asarray(v, float) for v in row.recent]
        if len(recent) < order:
            return []
        b = np.stack([np.asarray(c, float) for c in row.betas])
        out = []
        for step in range(1, steps + 1):
            nxt = b @ np.concatenate([[1.0], *recent[:order]])
            recent.insert(0, nxt)
            out.append((*key, step, row[len(keys) + 1] + pd.Timedelta(days=step), *map(float, nxt)))
        return out

    schema = f"{_key_schema(df, keys)}, step int, day date, " + ", ".join(f"{c} double" for c in cols)
    return _per_row(rows, solve, schema)
