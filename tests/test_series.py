"""Known answers for the daily-series operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearsay.functions import seasonal as SF, stats
from hearsay.operators import regress as G, seasonal as SE, series as S

DAY0 = dt.date(2021, 1, 1)


def frame(spark, cols, **series):
    rows = []
    for name, values in series.items():
        for i, v in enumerate(values):
            v = v if isinstance(v, tuple) else (v,)
            rows.append((name, DAY0 + dt.timedelta(days=i), *[None if x is None else float(x) for x in v]))
    return spark.createDataFrame(rows, "s string, day date, " + ", ".join(f"{c} double" for c in cols))


def ar1(n, phi, seed):
    noise = np.random.default_rng(seed).normal(size=n)
    out = np.zeros(n)
    for i in range(1, n):
        out[i] = phi * out[i - 1] + noise[i]
    return out


def test_impute_uses_two_days_each_side(spark):
    df = frame(spark, ["v"], a=[90, 100, None, 98, 103])
    assert S.impute_neighbors(df, ["s"], "day", "v").where(F.day("day") == 3).first().v == 97.75


def test_rolling_needs_full_window(spark):
    out = S.rolling_stats(frame(spark, ["v"], a=range(1, 12)), ["s"], "day", "v", 10).orderBy("day").collect()
    assert [r.rolling_mean for r in out] == [None] * 9 + [5.5, 6.5]
    assert out[9].rolling_std == pytest.approx(np.std(range(1, 11), ddof=1))


def test_undifference_restores_the_series(spark):
    values = [3, 7, 4, 9, 12, 5, 8]
    df = frame(spark, ["v"], a=values, b=[2 * v for v in values])
    head = df.where(F.col("day") <= DAY0 + dt.timedelta(days=2))
    diffs = S.difference(df, ["s"], "day", "v", 2).where(F.col("day") > DAY0 + dt.timedelta(days=2))
    back = S.undifference(diffs, S.last_values(head, ["s"], "day", "v"), ["s"], "day", "v_diff", 2, "level")
    assert [r.level for r in back.where("s = 'a'").orderBy("day").collect()] == values[3:]
    assert [r.level for r in back.where("s = 'b'").orderBy("day").collect()] == [2 * v for v in values[3:]]
    once = S.difference(df, ["s"], "day", "v", 1).where(F.col("day") > DAY0 + dt.timedelta(days=2))
    back = S.undifference(once, S.last_values(head, ["s"], "day", "v"), ["s"], "day", "v_diff", 1, "level")
    assert [r.level for r in back.where("s = 'a'").orderBy("day").collect()] == values[3:]


def test_regularize_fills_calendar(spark):
    df = frame(spark, ["v"], a=[1, 2, 3]).where(F.day("day") != 2)
    assert [r.v for r in S.regularize(df, ["s"], "day", "v").orderBy("day").collect()] == [1.0, None, 3.0]
    assert [r.v for r in S.regularize(df, ["s"], "day", "v", 0.0).orderBy("day").collect()] == [1.0, 0.0, 3.0]


def test_acf_and_pacf_of_ar1(spark):
    y = ar1(2000, 0.7, 3)
    df = frame(spark, ["v"], a=y)
    rho = {r.lag: r.acf for r in S.acf(df, ["s"], "day", "v", 5).collect()}
    d = y - y.mean()
    for k in range(6):
        assert rho[k] == pytest.approx(float(d[: len(d) - k] @ d[k:] / (d @ d)), abs=1e-10)
    partial = {r.lag: r.pacf for r in G.pacf(df, ["s"], "day", "v", 5).collect()}
    assert partial[1] == pytest.approx(rho[1]) and abs(partial[1] - 0.7) < 0.05
    assert all(abs(partial[k]) < 0.08 for k in range(2, 6))


def test_white_noise_stays_inside_bands(spark):
    y = np.random.default_rng(1).normal(size=1500)
    out = S.acf(frame(spark, ["v"], a=y), ["s"], "day", "v", 10).where("lag > 0").collect()
    assert all(abs(r.acf) < r.bound99 * 1.3 for r in out)


def test_decompose_recovers_weekly_pattern(spark):
    pattern = np.array([3, 1, -1, -2, 0, 1, -2], float)
    y = [10 + 0.5 * i + pattern[i % 7] for i in range(70)]
    out = S.decompose(frame(spark, ["v"], a=y), ["s"], "day", "v", 7).orderBy("day").collect()
    assert [r.seasonal for r in out[:7]] == pytest.approx(list(pattern - pattern.mean()), abs=1e-9)
    assert out[0].trend is None and out[10].trend == pytest.approx(15.0)
    assert max(abs(r.residual) for r in out if r.residual is not None) < 1e-9


def test_decompose_even_period(spark):
    y = [float(i) + (1 if i % 4 == 0 else 0) for i in range(24)]
    out = S.decompose(frame(spark, ["v"], a=y), ["s"], "day", "v", 4).orderBy("day").collect()
    weights = np.array([0.5, 1, 1, 1, 0.5]) / 4
    assert out[6].trend == pytest.approx(float(weights @ np.array(y[4:9])))


def test_durbin_watson(spark):
    out = S.durbin_watson(frame(spark, ["e"], a=[1, -1, 1, -1]), ["s"], "day", "e").first()
    assert out.durbin_watson == pytest.approx(3.0)


def test_forecast_accuracy_matches_numpy(spark):
    f, a = np.array([1.0, 2.5, 3.0, 5.0]), np.array([2.0, 2.0, 4.0, 4.0])
    df = frame(spark, ["f", "a"], x=list(zip(f, a)))
    row = S.forecast_accuracy(df, "f", "a").first()
    assert row.mape == pytest.approx(np.mean(np.abs(f - a) / np.abs(a)))
    assert row.mpe == pytest.approx(np.mean((f - a) / a))
    assert row.rmse == pytest.approx(np.sqrt(np.mean((f - a) ** 2)))
    assert row.corr == pytest.approx(np.corrcoef(f, a)[0, 1])
    assert row.minmax == pytest.approx(1 - np.mean(np.minimum(f, a) / np.maximum(f, a)))


def test_residual_density_integrates_to_one(spark):
    y = np.random.default_rng(4).normal(size=300)
    out = S.residual_density(frame(spark, ["e"], a=y), ["s"], "e", 60).orderBy("point").collect()
    step = out[1].x - out[0].x
    assert sum(r.density for r in out) * step == pytest.approx(1.0, abs=0.02)


@pytest.mark.parametrize("x,dof,p", [(3.841458820694124, 1, 0.05), (21.02606981748307, 12, 0.05), (5.0, 2, math.exp(-2.5)), (100.0, 2, math.exp(-50)), (0.0, 3, 1.0)])
def test_chi2_tail(x, dof, p):
    assert stats.chi2_tail(x, dof) == pytest.approx(p, rel=1e-9)


def test_adf_p_value_at_critical_values():
    assert stats.adf_p_value(-3.43035) == pytest.approx(0.01, abs=0.001)
    assert stats.adf_p_value(-2.86154) == pytest.approx(0.05, abs=0.002)


def ols(x, y):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    return beta, float(np.sum((y - x @ beta) ** 2))


def test_gram_equals_numpy(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(40, 2))
    df = frame(spark, ["a", "b"], p=[tuple(r) for r in data], q=[tuple(2 * r) for r in data])
    out = {r.s: np.array(r.gram).reshape(3, 3) for r in G.gram(df, ["s"], ["a", "b"]).collect()}
    x = np.column_stack([np.ones(40), data])
    assert np.allclose(out["p"], x.T @ x)
    x = np.column_stack([np.ones(40), 2 * data])
    assert np.allclose(out["q"], x.T @ x)


def test_lag_ols_matches_numpy_and_one_lag_form(spark):
    y = ar1(400, 0.6, 7) + 5
    df = frame(spark, ["v"], a=y)
    beta, ssr = ols(np.column_stack([np.ones(398), y[1:-1], y[:-2]]), y[2:])
    out = {r.term: r for r in G.lag_ols(df, ["s"], "day", "v", ["v"], 2).collect()}
    assert [out[t].coefficient for t in ("const", "v_lag1", "v_lag2")] == pytest.approx(list(beta), rel=1e-6)
    assert out["const"].ssr == pytest.approx(ssr, rel=1e-6) and out["const"].n == 398
    one = G.lag_ols_one(df, ["s"], "day", "v", "v").first()
    beta, _ = ols(np.column_stack([np.ones(399), y[:-1]]), y[1:])
    assert (one.intercept, one.slope) == pytest.approx(tuple(beta), rel=1e-8)


def adf_by_numpy(y, max_lag):
    dy = np.diff(y)
    def design(k, n):
        t = np.arange(len(dy) - n, len(dy))
        return np.column_stack([np.ones(n), y[t], *[dy[t - i] for i in range(1, k + 1)]]), dy[t]
    n = len(dy) - max_lag
    best = min(range(max_lag + 1), key=lambda k: n * math.log(ols(*[design(k, n)[0], design(k, n)[1]])[1] / n) + 2 * (k + 2))
    n = len(dy) - best
    x, target = design(best, n)
    beta, ssr = ols(x, target)
    return best, n, beta[1] / math.sqrt(ssr / (n - 2 - best) * np.linalg.inv(x.T @ x)[1, 1])


def test_adf_matches_direct_regression(spark):
    stationary, walk = ar1(300, 0.5, 11), np.cumsum(np.random.default_rng(12).normal(size=300))
    out = {r.s: r for r in G.adf(frame(spark, ["v"], st=stationary, rw=walk), ["s"], "day", "v", 6).collect()}
    for name, y in (("st", stationary), ("rw", walk)):
        lags, n, tau = adf_by_numpy(y, 6)
        assert (out[name].n_lags, out[name].n_obs) == (lags, n)
        assert out[name].statistic == pytest.approx(tau, rel=1e-6)
    assert out["st"].stationary and not out["rw"].stationary


def test_granger_finds_the_direction(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=500)
    y = np.concatenate([[0, 0], 0.8 * x[:-2]]) + 0.3 * rng.normal(size=500)
    out = {(r.response, r.cause): r.p_value for r in G.granger_matrix(frame(spark, ["x", "y"], a=list(zip(x, y))), ["s"], "day", ["x", "y"], 4).collect()}
    assert out["y", "x"] == 0.0 and out["x", "y"] > 0.01
    assert out["x", "x"] == out["y", "y"] == 1.0


def test_granger_matches_direct_regression(spark):
    rng = np.random.default_rng(14)
    x, y = rng.normal(size=120), rng.normal(size=120)
    expected = 1.0
    for k in (1, 2, 3):
        t = np.arange(k, 120)
        own = np.column_stack([np.ones(len(t)), *[y[t - i] for i in range(1, k + 1)]])
        both = np.column_stack([own, *[x[t - i] for i in range(1, k + 1)]])
        r, j = ols(own, y[t])[1], ols(both, y[t])[1]
        expected = min(expected, round(stats.chi2_tail(len(t) * (r - j) / j, k), 4))
    out = G.granger_matrix(frame(spark, ["x", "y"], a=list(zip(x, y))), ["s"], "day", ["x", "y"], 3)
    assert out.where("response = 'y' AND cause = 'x'").first().p_value == pytest.approx(expected, abs=1e-4)


def var_data(n=400):
    rng = np.random.default_rng(15)
    a = np.array([[0.5, 0.2], [-0.3, 0.4]])
    out = np.zeros((n, 2))
    for i in range(1, n):
        out[i] = a @ out[i - 1] + rng.normal(size=2)
    return a, out


def test_var_select_prefers_true_order_and_matches_numpy(spark):
    _, data = var_data()
    df = frame(spark, ["x", "y"], a=[tuple(r) for r in data])
    out = {r.lag_order: r for r in G.var_select(df, ["s"], "day", ["x", "y"], 5).collect()}
    assert min(out, key=lambda k: out[k].bic) == 1
    t = np.arange(5, 400)
    design = np.column_stack([np.ones(len(t)), data[t - 1], data[t - 2]])
    resid = data[t] - design @ np.linalg.lstsq(design, data[t], rcond=None)[0]
    log_det = math.log(np.linalg.det(resid.T @ resid / len(t)))
    assert out[2].aic == pytest.approx(log_det + 2 * 10 / len(t), rel=1e-8)
    assert out[2].fpe == pytest.approx(((len(t) + 5) / (len(t) - 5)) ** 2 * math.exp(log_det), rel=1e-8)
    own = {r.lag_order: r.n for r in G.var_select(df, ["s"], "day", ["x", "y"], 3, common_sample=False).collect()}
    assert own == {1: 399, 2: 398, 3: 397}


def test_var_forecast_and_residuals_match_numpy(spark):
    _, data = var_data()
    df = frame(spark, ["x", "y"], a=[tuple(r) for r in data])
    t = np.arange(2, 400)
    design = np.column_stack([np.ones(len(t)), data[t - 1], data[t - 2]])
    b = np.linalg.lstsq(design, data[t], rcond=None)[0]
    hist, ahead = [data[-1], data[-2]], []
    for _ in range(4):
        nxt = np.concatenate([[1.0], *hist[:2]]) @ b
        hist.insert(0, nxt)
        ahead.append(nxt)
    out = G.var_forecast(df, ["s"], "day", ["x", "y"], 2, 4).orderBy("step").collect()
    assert np.allclose([(r.x, r.y) for r in out], ahead, rtol=1e-6)
    assert out[0].day == DAY0 + dt.timedelta(days=400)
    resid = G.var_residuals(df, ["s"], "day", ["x", "y"], 2).where("response = 'y'").orderBy("day").collect()
    assert np.allclose([r.residual for r in resid], (data[t] - design @ b)[:, 1], atol=1e-7)


def test_a_gap_inside_the_series_is_left_out_not_zero(spark):
    y = list(ar1(200, 0.6, 21) + 50)
    y[100] = None
    out = G.var_select(frame(spark, ["v"], a=y), ["s"], "day", ["v"], 2).collect()
    assert all(r.n == 198 - 3 for r in out)


def seasonal_series(n=600, seed=8):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n + 21)
    w = e[21:] - 0.5 * e[20:-1] - 0.6 * e[1:-20] + 0.3 * e[:-21]
    y = np.zeros(n)
    for i in range(n):
        y[i] = w[i] + (y[i - 1] if i else 0) + (y[i - 20] if i >= 20 else 0) - (y[i - 21] if i >= 21 else 0)
    return y


def test_seasonal_search_finds_the_generating_order(spark):
    df = frame(spark, ["v"], a=seasonal_series())
    grid = SE.sarima_grid(df, ["s"], "day", "v", 20)
    assert grid.count() == 64
    scores = {r.order: r.aic for r in grid.collect()}
    best = SE.best_order(grid, ["s"]).first()
    assert scores["(0, 1, 1, 0, 1, 1, 20)"] <= best.aic + 4
    coef = grid.where(F.col("order") == "(0, 1, 1, 0, 1, 1, 20)").first().coefficients
    assert coef == pytest.approx([0, -0.5, 0, -0.6], abs=0.1)
    assert best.converged  # others may run to the edge of the unit interval


def test_seasonal_forecast_widens_and_follows_dates(spark):
    df = frame(spark, ["v"], a=seasonal_series(300))
    best = SE.sarima_grid(df, ["s"], "day", "v", 20, [(0, 1, 1, 0, 1, 1)])
    out = SE.forecast(df, ["s"], "day", "v", best, steps=30).orderBy("date").collect()
    widths = [r.upper_bound - r.lower_bound for r in out]
    assert len(out) == 30 and widths == sorted(widths)
    assert out[0].date == DAY0 + dt.timedelta(days=300)
    resid = SE.fit_best(df, ["s"], "day", "v", best).orderBy("day").collect()
    assert resid[0].residual is None and resid[-1].value == pytest.approx(resid[-1].fitted + resid[-1].residual)


def test_random_walk_forecast_is_flat():
    y = np.cumsum(np.random.default_rng(2).normal(size=100))
    out = SF.forecast(y, np.zeros(100), (0, 1, 0, 0, 0, 0), [0] * 4, 1.5, 20, 4)
    assert [m for m, _, _ in out] == pytest.approx([y[-1]] * 4)
    assert out[3][2] - out[3][0] == pytest.approx(2 * (out[0][2] - out[0][0]))


def test_moving_average_weights_invert():
    rng = np.random.default_rng(9)
    e = rng.normal(size=90)
    ma = np.convolve(e, [1, 0.4])[:90]
    seasonal = ma.copy()
    seasonal[20:] += 0.5 * ma[:-20]
    assert np.allclose(np.convolve(seasonal, SF.weights([0, 0.4, 0, 0.5], range(90), 20))[:90], e, atol=1e-8)


def filtered(w, coef, period):
    """Plain recursion: residuals of (phi, theta, Phi, Theta), zero before the start."""
    phi, theta, big_phi, big_theta = coef
    e = np.zeros(len(w))

    def at(x, i):
        return x[i] if i >= 0 else 0.0

    for t in range(len(w)):
        own = at(w, t) - phi * at(w, t - 1) - big_phi * at(w, t - period) + phi * big_phi * at(w, t - period - 1)
        e[t] = own - theta * at(e, t - 1) - big_theta * at(e, t - period) - theta * big_theta * at(e, t - period - 1)
    return e


@pytest.mark.parametrize("order", [(1, 1, 1, 0, 1, 1), (0, 1, 1, 0, 1, 1), (1, 0, 1, 1, 0, 1), (1, 0, 0, 1, 1, 0)])
def test_seasonal_fit_is_the_least_squares_of_the_plain_recursion(spark, order):
    y, period = seasonal_series(90), 7
    df, whole = frame(spark, ["v"], a=y), list(range(90))
    best = SE.sarima_grid(df, ["s"], "day", "v", period, [order], whole)
    row = best.first()
    w = np.diff(y) if order[1] else y
    w = w[period:] - w[:-period] if order[4] else w
    first = SF.burn_in(order, period)

    def ssr(coef):
        return float((filtered(w, coef, period)[first:] ** 2).sum())

    least = ssr(row.coefficients)
    assert row.sigma2 * (len(w) - first) == pytest.approx(least)
    for i in [i for i, has in enumerate((order[0], order[2], order[3], order[5])) if has]:
        for step in (-0.01, 0.01):
            moved = list(row.coefficients)
            moved[i] += step
            assert abs(moved[i]) >= SF.EDGE or ssr(moved) > least
    out = SE.fit_best(df, ["s"], "day", "v", best, period, whole).orderBy("day").collect()
    assert [r.residual for r in out if r.residual is not None] == pytest.approx(list(filtered(w, row.coefficients, period)), abs=1e-6)


@pytest.mark.parametrize("order", [(0, 1, 1, 0, 0, 0), (0, 1, 1, 0, 1, 1)])
def test_moving_averages_near_the_edge_use_the_whole_recursion(spark, order):
    y, period = np.random.default_rng(31).normal(size=400), 20
    df = frame(spark, ["v"], a=y)
    best = SE.sarima_grid(df, ["s"], "day", "v", period, [order])
    row = best.first()
    w = np.diff(y)
    w = w[period:] - w[:-period] if order[4] else w
    first = SF.burn_in(order, period)

    def ssr(coef):
        return float((filtered(w, coef, period)[first:] ** 2).sum())

    assert row.sigma2 * (len(w) - first) == pytest.approx(ssr(row.coefficients))
    grid = [(0, a, 0, b) for a in np.arange(-0.99, 0, 0.03) for b in ((0.0,) if not order[5] else np.arange(-0.99, 0, 0.11))]
    assert ssr(row.coefficients) <= min(map(ssr, grid)) * (1 + 1e-9)
    assert row.coefficients[1] < -0.9
    out = SE.fit_best(df, ["s"], "day", "v", best, period).orderBy("day").collect()
    assert [r.residual for r in out if r.residual is not None] == pytest.approx(list(filtered(w, row.coefficients, period)), abs=1e-6)


def test_seasonal_search_keeps_null_keys_and_survives_nulls_and_short_series(spark):
    y = list(seasonal_series(200))
    y[60] = None
    df = frame(spark, ["v"], a=y, b=[1.0, 2.0], c=[None] * 50, d=[4.0] * 60).withColumn("s", F.when(F.col("s") != "a", F.col("s")))
    grid = SE.sarima_grid(df, ["s"], "day", "v", 7).collect()
    assert None in {r.s for r in grid} and not {"b", "c"} & {r.s for r in grid}
    best = SE.best_order(SE.sarima_grid(df, ["s"], "day", "v", 7), ["s"])
    assert SE.forecast(df, ["s"], "day", "v", best, 7).where("s IS NULL").count() == 30
    assert SE.fit_best(df, ["s"], "day", "v", best, 7).where("s IS NULL").count() == 200


def test_constant_series_and_straight_line(spark):
    import datetime as dt

    from hearsay.operators.regress import adf
    from hearsay.operators.series import residual_density

    days = [dt.date(2024, 1, 1) + dt.timedelta(d) for d in range(60)]
    rows = [("flat", d, 0.0, 2.0 * i) for i, d in enumerate(days)] + [("own", d, float(i % 7), float((i * 37) % 11)) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "series string, day date, e double, v double")
    density = residual_density(df, ["series"], "e").collect()
    assert all(r.density is None for r in density if r.series == "flat")
    assert all(r.density >= 0 for r in density if r.series == "own")
    assert [r.series for r in adf(df, ["series"], "day", "v").collect()] == ["own"]
