"""Z rows of the inventory."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, functions as F

from hearsay.catalog import inputs as I
from hearsay.catalog.aggregates import GAPS_SQL, full_order_days, rounded
from hearsay.catalog.filters import day_text
from hearsay.catalog.registry import query
from hearsay.catalog import least_squares_sql as Q
from hearsay.functions.stats import ADF_CRITICAL, ADF_LARGE_P, ADF_SMALL_P, ADF_TAU_MAX, ADF_TAU_MIN, ADF_TAU_STAR
from hearsay.operators import regress as G, seasonal as SE, series as S
from hearsay.session import write_table

KEYS = ["series"]
FILLED_SQL = f"{GAPS_SQL}, filled AS (SELECT series, day, coalesce(n, 0.0) AS n FROM full_days)"


def filled(spark, sf):
    """Complete daily order counts per priority; a day without orders counts zero."""
    days = I.order_days(spark, sf).withColumn("n", F.col("n").cast("double"))
    return S.regularize(days, KEYS, "day", "n", fill=0.0)


def multivariate(spark, sf):
    """Three complete daily series per priority: orders, amount in thousands, customers."""
    days = I.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), (F.sum("o_totalprice") / 1000).alias("amount"),
        F.sum((F.col("o_orderstatus") == "F").cast("double")).alias("closed"))
    span = S.regularize(days.withColumn("v", F.struct("n", "amount", "closed")), KEYS, "day", "v")
    return span.select("series", "day", *[F.coalesce(F.col(f"v.{c}"), F.lit(0.0)).alias(c) for c in ("n", "amount", "closed")])


VARS = ["n", "amount", "closed"]
VARS_SQL = """w AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS day, count(*)::DOUBLE AS n, sum(o_totalprice) / 1000 AS amount, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS closed FROM orders GROUP BY ALL),
span AS (SELECT series, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM w GROUP BY 1),
many AS MATERIALIZED (SELECT series, day, coalesce(n, 0) AS n, coalesce(amount, 0) AS amount, coalesce(closed, 0) AS closed FROM span LEFT JOIN w USING (series, day))"""


@query("z1_regularize", f"WITH {GAPS_SQL} SELECT series, CAST(day AS VARCHAR) AS day, n FROM full_days")
def z1(spark, sf):
    return day_text(full_order_days(spark, sf))


#: All autocorrelations up to the last day, from the products of pairs of days.
ACF_SQL = f"""{FILLED_SQL}, c AS (SELECT series, n - avg(n) OVER (PARTITION BY series) AS d, row_number() OVER (PARTITION BY series ORDER BY day) AS t, count(*) OVER (PARTITION BY series) AS cnt FROM filled),
r AS (SELECT x.series, (y.t - x.t)::INT AS lag, sum(x.d * y.d) / any_value(z.s) AS acf, any_value(x.cnt) AS cnt FROM c x JOIN c y ON x.series = y.series AND y.t >= x.t
 JOIN (SELECT series, sum(d * d) AS s FROM c GROUP BY 1) z ON z.series = x.series GROUP BY ALL)"""


@query("z2_acf", f"""WITH {ACF_SQL} SELECT series, lag, round(acf, 6) AS acf, round({S.Z95} / sqrt(cnt), 6) AS bound95, round({S.Z99} / sqrt(cnt), 6) AS bound99,
round(CASE WHEN lag = 0 THEN 0 ELSE {S.Z95} * sqrt((1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN acf * acf END) OVER (PARTITION BY series ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / cnt) END, 6) AS bartlett95
FROM r""")
def z2(spark, sf):
    return rounded(S.acf(filled(spark, sf), KEYS, "day", "n"))


@query("z3_pacf", f"""WITH RECURSIVE {ACF_SQL}, rho AS MATERIALIZED (SELECT series, list(acf ORDER BY lag) AS rho, any_value(cnt) AS cnt FROM r GROUP BY 1),
dl(series, k, phi, pacf) AS (SELECT series, 0, []::DOUBLE[], 1.0::DOUBLE FROM rho UNION ALL
 SELECT series, k + 1, list_append(list_transform(list_zip(phi, list_reverse(phi)), lambda z: z[1] - top * z[2]), top), top FROM (
  SELECT dl.series, dl.k, dl.phi, (rho[k + 2] - coalesce(list_inner_product(phi, list_reverse(rho[2:k + 1])), 0)) / (1 - coalesce(list_inner_product(phi, rho[2:k + 1]), 0)) AS top
  FROM dl JOIN rho ON rho.series = dl.series WHERE dl.k + 1 < rho.cnt))
SELECT dl.series, k AS lag, round(pacf, 6) AS pacf, round({S.Z95} / sqrt(cnt), 6) AS bound95 FROM dl JOIN rho ON rho.series = dl.series""")
def z3(spark, sf):
    return rounded(G.pacf(filled(spark, sf), KEYS, "day", "n"))


RESID_SQL = "e AS (SELECT series, day, n - lag(n) OVER (PARTITION BY series ORDER BY day) AS e FROM filled)"


def adf_sql(source: str, value: str) -> str:
    """The whole test: lags by AIC on the rows that serve all, then the chosen order on all rows it can use."""
    most, poly = 60, lambda coef: " + ".join(f"{c} * pow(tau, {i})" for i, c in enumerate(coef))
    critical = ", ".join(f"round({' + '.join(f'{c} / pow(n, {i})' for i, c in enumerate(coef))}, 6) AS critical_{level[:-1]}" for level, coef in ADF_CRITICAL.items())
    past = ", ".join(f"coalesce(lag(dy, {i}) OVER w, 0)" for i in range(1, most + 1))
    m, side = "(SELECT lags + 3 FROM size)", "sqrt(len(a))::INT"
    return f"""d AS (SELECT series, day, {value}::DOUBLE AS y, lag({value}) OVER w AS y1, coalesce({value} - lag({value}) OVER w, 0)::DOUBLE AS dy FROM {source} WINDOW w AS (PARTITION BY series ORDER BY day)),
size AS MATERIALIZED (SELECT greatest(0, least(ceil(12 * pow(n / 100, 0.25))::INT, n // 2 - 2)) AS lags FROM (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM {source} GROUP BY series))),
p AS (SELECT series, dy, y1, row_number() OVER w - 1 AS t, [{past}] AS past FROM d WINDOW w AS (PARTITION BY series ORDER BY day)),
x AS MATERIALIZED (SELECT series, least(t - 1, lags) AS o, [1.0, y1] || past[1:lags] || [dy] AS x FROM p, size WHERE t >= 1),
{Q.grams('x', m, 'o')},
common AS (SELECT series, o, a FROM g, size WHERE o = lags),
{Q.swept('common', side, '(SELECT lags + 2 FROM size)')},
aic AS (SELECT series, k - 2 AS k, a[1] AS inv, z.a[len(z.a)] AS ssr, (SELECT c.a[1] FROM common c WHERE c.series = z.series) AS n FROM z WHERE k >= 2),
best AS (SELECT series, arg_min(k, (n * (ln(2 * pi() * ssr / n) + 1) + 2 * (2 + k), k)) AS o FROM aic WHERE n > 2 + k AND ssr > 0 GROUP BY 1),
{Q.added('SELECT series AS s2, o FROM best').replace('cell.o >= k.o', 'cell.o >= k.o AND cell.series = k.s2')},
{Q.swept('whole', side, 'o + 2', 'f')},
r AS (SELECT f.series, f.o AS n_lags, w.a[1] AS n, f.a[{m} + {m}] / sqrt(f.a[len(f.a)] / (w.a[1] - 2 - f.o) * f.a[{m} + 2]) AS tau FROM f JOIN whole w ON f.series = w.series WHERE k = top),
q AS (SELECT *, CASE WHEN tau > {ADF_TAU_MAX} THEN 1.0 WHEN tau < {ADF_TAU_MIN} THEN 0.0 ELSE {Q.normal_cdf(f'(CASE WHEN tau <= {ADF_TAU_STAR} THEN {poly(ADF_SMALL_P)} ELSE {poly(ADF_LARGE_P)} END)')} END AS p FROM r)
SELECT series, round(tau, 6) AS statistic, round(p, 6) AS p_value, n_lags::INT AS n_lags, n::BIGINT AS n_obs, {critical}, p <= 0.05 AS stationary FROM q"""


@query("z4_adf", f"WITH RECURSIVE {FILLED_SQL}, {adf_sql('filled', 'n')}")
def z4(spark, sf):
    return rounded(G.adf(filled(spark, sf), KEYS, "day", "n"))


@query("z4_adf_differenced", f"WITH RECURSIVE {FILLED_SQL}, {RESID_SQL}, steps AS (SELECT series, day, e FROM e WHERE e IS NOT NULL), {adf_sql('steps', 'e')}")
def z4b(spark, sf):
    diffs = S.difference(filled(spark, sf), KEYS, "day", "n", 1).where(F.col("n_diff").isNotNull())
    return rounded(G.adf(diffs, KEYS, "day", "n_diff"))


@query("z5_decompose", f"""WITH {FILLED_SQL}, t AS (SELECT series, day, n, CASE WHEN count(n) OVER w = 7 THEN avg(n) OVER w END AS trend,
 (row_number() OVER (PARTITION BY series ORDER BY day) - 1) % 7 AS phase FROM filled WINDOW w AS (PARTITION BY series ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
p AS (SELECT series, phase, avg(n - trend) AS raw FROM t GROUP BY ALL), s AS (SELECT series, phase, raw - avg(raw) OVER (PARTITION BY series) AS seasonal FROM p)
SELECT series, CAST(day AS VARCHAR) AS day, phase::INT AS phase, n, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(n - trend - seasonal, 6) AS residual FROM t JOIN s USING (series, phase)""")
def z5(spark, sf):
    return day_text(rounded(S.decompose(filled(spark, sf), KEYS, "day", "n", 7)))


SCORES = ["series", "order", "aic", "bic"]


_grids: dict[tuple[str, str], DataFrame] = {}


def grid(spark, sf):
    """The search over all orders, written once per application and read by every query on it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _grids:
        _grids[key] = write_table(SE.sarima_grid(filled(spark, sf), KEYS, "day", "n", 20), "sarima-grid")
    return _grids[key]


@query("z6_sarima_grid")
def z6(spark, sf):
    return rounded(grid(spark, sf).select(*SCORES), 4)


def best(spark, sf):
    return SE.best_order(grid(spark, sf), KEYS)


@query("z7_fit_best")
def z7(spark, sf):
    return day_text(rounded(SE.fit_best(filled(spark, sf), KEYS, "day", "n", best(spark, sf)), 4))




def steps(spark, sf):
    return S.difference(filled(spark, sf), KEYS, "day", "n", 1, "e").where(F.col("e").isNotNull())


@query("z8_residual_report", f"""WITH {FILLED_SQL}, {RESID_SQL} SELECT series, count(e)::BIGINT AS count, round(avg(e), 6) AS mean, round(stddev_samp(e), 6) AS std, min(e) AS min,
round(quantile_cont(e, 0.25), 6) AS q1, round(quantile_cont(e, 0.5), 6) AS median, round(quantile_cont(e, 0.75), 6) AS q3, max(e) AS max FROM e GROUP BY 1""")
def z8(spark, sf):
    return rounded(S.residual_report(steps(spark, sf), KEYS, "e"))


@query("z8_residual_density", f"""WITH {FILLED_SQL}, {RESID_SQL}, st AS (SELECT series, count(e) AS c, min(e) - (max(e) - min(e)) / 2 AS lo, (max(e) - min(e)) * 2 / 24 AS step,
 stddev_samp(e) * pow(count(e), -0.2) AS h FROM e GROUP BY 1), g AS (SELECT *, lo + i * step AS x FROM st, (SELECT unnest(generate_series(0, 24)) AS i))
SELECT series, i::INT AS point, round(x, 5) AS x, round(sum(exp(-pow((x - e) / h, 2) / 2)) / (any_value(c) * any_value(h) * sqrt(2 * pi())), 5) AS density
FROM g JOIN e USING (series) WHERE e IS NOT NULL GROUP BY ALL""")
def z8b(spark, sf):
    return rounded(S.residual_density(steps(spark, sf), KEYS, "e", 25), 5)


def seasonal_forecast(spark, sf):
    out = SE.forecast(filled(spark, sf), KEYS, "day", "n", best(spark, sf), steps=30)
    return day_text(rounded(out, 4), "date")


query("z9_forecast")(seasonal_forecast)


GRANGER_LAGS = 12
GRANGER_SQL = f"""WITH RECURSIVE {VARS_SQL}, {Q.lagged('many', VARS, GRANGER_LAGS, by_column=True)},
y AS MATERIALIZED (SELECT series, x, least(t, {GRANGER_LAGS}) AS o FROM x WHERE t >= 1), {Q.grams('y', str(len(VARS) * (GRANGER_LAGS + 1) + 1), 'o')},
{Q.added(f'SELECT unnest(range(1, {GRANGER_LAGS + 1})) AS o')},
pairs AS (SELECT r.i AS r, c.i AS c FROM range({len(VARS)}) r(i), range({len(VARS)}) c(i) WHERE r.i <> c.i),
cols AS (SELECT series, r, c, o, a, [0] || list_transform(range(0, o), lambda i: 1 + r * {GRANGER_LAGS} + i) || list_transform(range(0, o), lambda i: 1 + c * {GRANGER_LAGS} + i) || [1 + {len(VARS) * GRANGER_LAGS} + r] AS pick FROM whole, pairs),
part AS MATERIALIZED (SELECT series, r, c, o, list_transform(range(0, len(pick) * len(pick)), lambda q: a[pick[q // len(pick) + 1] * {len(VARS) * (GRANGER_LAGS + 1) + 1} + pick[q % len(pick) + 1] + 1]) AS a FROM cols),
{Q.swept('part', '(2 * o + 2)', '2 * o + 1', keys='series, r, c, o')},
ssr AS (SELECT series, r, c, o, max(CASE WHEN k = o + 1 THEN a[len(a)] END) AS own, max(CASE WHEN k = 2 * o + 1 THEN a[len(a)] END) AS joint FROM z GROUP BY ALL),
st AS (SELECT ssr.*, w.a[1] * (own - joint) / joint AS stat FROM ssr JOIN whole w ON w.series = ssr.series AND w.o = ssr.o WHERE w.a[1] > 2 * ssr.o + 1),
names AS (SELECT unnest([{I.sql_list(VARS)}]) AS name, unnest(range({len(VARS)})) AS i)"""


@query("z10_granger_matrix", f"""{GRANGER_SQL} SELECT series, rn.name AS response, cn.name AS cause, min(round({Q.chi2_tail('stat', 'o')}, 4)) AS p_value FROM st JOIN names rn ON rn.i = r JOIN names cn ON cn.i = c GROUP BY ALL
UNION ALL SELECT DISTINCT series, name, name, 1.0::DOUBLE FROM many, names""")
def z10(spark, sf):
    return G.granger_matrix(multivariate(spark, sf), KEYS, "day", VARS, 12)


@query("z11_lag_ols_one", f"""WITH {FILLED_SQL}, l AS (SELECT series, n AS y, lag(n) OVER (PARTITION BY series ORDER BY day) AS x FROM filled)
SELECT series, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2, count(x)::BIGINT AS n FROM l WHERE x IS NOT NULL GROUP BY 1""")
def z11(spark, sf):
    return rounded(G.lag_ols_one(filled(spark, sf), KEYS, "day", "n", "n"))


@query("z11_lag_ols", f"""WITH {FILLED_SQL}, l AS (SELECT series, n AS y, lag(n) OVER (PARTITION BY series ORDER BY day) AS x FROM filled),
f AS (SELECT series, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_syy(y, x) * (1 - regr_r2(y, x)) AS ssr, count(x)::BIGINT AS n FROM l WHERE x IS NOT NULL GROUP BY 1)
SELECT series, 'const' AS term, round(a, 5) AS coefficient, round(ssr, 3) AS ssr, n FROM f UNION ALL SELECT series, 'n_lag1', round(b, 5), round(ssr, 3), n FROM f""")
def z11b(spark, sf):
    out = G.lag_ols(filled(spark, sf), KEYS, "day", "n", ["n"], 1)
    return out.withColumns({"coefficient": F.round("coefficient", 5), "ssr": F.round("ssr", 3)})


@query("z11_lag_ols_many", f"""WITH RECURSIVE {VARS_SQL}, {Q.lagged('many', VARS, 5, by_column=True)}, y AS (SELECT series, x[1:17] AS x, 0 AS o FROM x WHERE t >= 5), {Q.grams('y', '17', 'o')}, {Q.swept('g', '17', '16')},
f AS (SELECT z.series, z.a, g.a[1] AS n FROM z JOIN g USING (series) WHERE k = top), term AS (SELECT unnest(['const', {', '.join(f"'{c}_lag{i}'" for c in VARS for i in range(1, 6))}]) AS term, unnest(range(16)) AS i)
SELECT series, term, round(a[i * 17 + 17], 5) AS coefficient, round(a[17 * 17], 5) AS ssr, n::BIGINT AS n FROM f, term""")
def z11c(spark, sf):
    return rounded(G.lag_ols(multivariate(spark, sf), KEYS, "day", "n", VARS, 5), 5)


TAIL_SQL = f"{FILLED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS r FROM filled)"


@query("z12_tail_split_train", f"WITH {TAIL_SQL} SELECT series, CAST(day AS VARCHAR) AS day, n FROM r WHERE r > 20")
def z12(spark, sf):
    return day_text(S.tail_split(filled(spark, sf), KEYS, "day", 20)[0])


@query("z12_tail_split_test", f"WITH {TAIL_SQL} SELECT series, CAST(day AS VARCHAR) AS day, n FROM r WHERE r <= 20")
def z12b(spark, sf):
    return day_text(S.tail_split(filled(spark, sf), KEYS, "day", 20)[1])


def criteria_sql(order: str, width: int) -> str:
    """Scores of the order from a matrix swept up to it; the last three columns are the responses."""
    at = lambda i, j: f"a[({width} - 3 + {i}) * {width} + {width} - 3 + {j} + 1] / n"
    det = (f"({at(0, 0)}) * (({at(1, 1)}) * ({at(2, 2)}) - ({at(1, 2)}) * ({at(2, 1)})) - ({at(0, 1)}) * (({at(1, 0)}) * ({at(2, 2)}) - ({at(1, 2)}) * ({at(2, 0)}))"
           f" + ({at(0, 2)}) * (({at(1, 0)}) * ({at(2, 1)}) - ({at(1, 1)}) * ({at(2, 0)}))")
    return f"""ld AS (SELECT series, ({order})::INT AS lag_order, n, ({order}) * 9 + 3 AS params, 1 + 3 * ({order}) AS xs, ln({det}) AS ld FROM sw)
SELECT series, lag_order, round(ld + 2 * params / n, 6) AS aic, round(ld + ln(n) * params / n, 6) AS bic, round(pow((n + xs) / (n - xs), 3) * exp(ld), 6) AS fpe,
round(ld + 2 * ln(ln(n)) * params / n, 6) AS hqic, n::BIGINT AS n FROM ld"""


@query("z13_var_select", f"""WITH RECURSIVE {VARS_SQL}, {Q.lagged('many', VARS, 20)}, y AS (SELECT series, x, 0 AS o FROM x WHERE t >= 20), {Q.grams('y', '64', 'o')}, {Q.swept('g', '64', '61')},
sw AS (SELECT z.series, k, z.a, g.a[1] AS n FROM z JOIN g USING (series) WHERE k > 1 AND (k - 1) % 3 = 0), {criteria_sql('(k - 1) // 3', 64)}""")
def z13(spark, sf):
    return rounded(G.var_select(multivariate(spark, sf), KEYS, "day", VARS, 20))


@query("z13_var_select_own_sample", f"""WITH RECURSIVE {VARS_SQL}, {Q.lagged('many', VARS, 9)}, y AS (SELECT series, x, least(t, 9) AS o FROM x WHERE t >= 1), {Q.grams('y', '31', 'o')},
{Q.added('SELECT unnest(range(1, 10)) AS o')}, {Q.swept('whole', '31', '3 * o + 1')},
sw AS (SELECT z.series, z.o, k, z.a, w.a[1] AS n FROM z JOIN whole w ON w.series = z.series AND w.o = z.o WHERE k = top), {criteria_sql('o', 31)}""")
def z13b(spark, sf):
    return rounded(G.var_select(multivariate(spark, sf), KEYS, "day", VARS, 9, common_sample=False))


def var_sql(source: str, cols: list[str], order: int) -> str:
    """`b`: the swept matrix of a vector autoregression, `x` its rows, and `m`, the width."""
    width = len(cols) * (order + 1) + 1
    return f"""{Q.lagged(source, cols, order)}, y AS (SELECT series, x, 0 AS o FROM x WHERE t >= {order}), {Q.grams('y', str(width), 'o')}, {Q.swept('g', str(width), str(width - len(cols)))},
b AS MATERIALIZED (SELECT series, a FROM z WHERE k = top)"""


def fitted_sql(row: str, width: int, cols: int, c: int) -> str:
    """The fit of response c from a list that starts with a row's regressors."""
    return f"list_sum(list_transform(range(0, {width - cols}), lambda i: a[i * {width} + {width - cols} + {c} + 1] * {row}[i + 1]))"


def ahead_sql(source: str, cols: list[str], order: int, steps: int) -> str:
    """`r`: series, step and v, the values ahead, step by step."""
    k, width = len(cols), len(cols) * (order + 1) + 1
    made = ", ".join(fitted_sql("([1.0::DOUBLE] || recent)", width, k, c) for c in range(k))
    values = ", ".join(f"{c}::DOUBLE" for c in cols)
    return f"""{var_sql(source, cols, order)}, e AS (SELECT series, max(day) AS last_day, flatten(list([{values}] ORDER BY day DESC)[1:{order}]) AS recent FROM {source} GROUP BY 1),
r(series, step, recent) AS (SELECT series, 0, recent FROM e UNION ALL SELECT r.series, step + 1, ([{made}] || recent)[1:{order * k}] FROM r JOIN b ON b.series = r.series WHERE step < {steps})"""


TRAIN_SQL = "tail AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS back FROM many), train AS (SELECT series, day, n, amount, closed FROM tail WHERE back > 20)"


@query("z14_var_forecast", f"""WITH RECURSIVE {VARS_SQL}, {TRAIN_SQL}, {ahead_sql('train', VARS, 13, 20)}
SELECT r.series, step, CAST(CAST(last_day + step AS DATE) AS VARCHAR) AS day, round(r.recent[1], 4) AS n, round(r.recent[2], 4) AS amount, round(r.recent[3], 4) AS closed FROM r JOIN e ON e.series = r.series WHERE step > 0""")
def z14(spark, sf):
    train = S.tail_split(multivariate(spark, sf), KEYS, "day", 20)[0]
    return day_text(rounded(G.var_forecast(train, KEYS, "day", VARS, 13, 20), 4))


@query("z15_durbin_watson", f"""WITH {FILLED_SQL}, {RESID_SQL}, s AS (SELECT series, e, e - lag(e) OVER (PARTITION BY series ORDER BY day) AS s FROM e WHERE e IS NOT NULL)
SELECT series, round(sum(s * s) / sum(e * e), 6) AS durbin_watson FROM s GROUP BY 1""")
def z15(spark, sf):
    return rounded(S.durbin_watson(steps(spark, sf), KEYS, "day", "e"))


@query("z15_durbin_watson_var", f"""WITH RECURSIVE {VARS_SQL}, {var_sql('many', VARS, 13)},
resid AS (SELECT series, day, {', '.join(f"x[{41 + c}] - {fitted_sql('x', 43, 3, c)} AS e{c}" for c in range(3))} FROM x JOIN b USING (series) WHERE t >= 13),
s AS (SELECT series, {', '.join(f'e{c}, e{c} - lag(e{c}) OVER o AS d{c}' for c in range(3))} FROM resid WINDOW o AS (PARTITION BY series ORDER BY day))
{' UNION ALL '.join(f"SELECT series, '{v}' AS response, round(sum(d{c} * d{c}) / sum(e{c} * e{c}), 6) AS durbin_watson FROM s GROUP BY 1" for c, v in enumerate(VARS))}""")
def z15b(spark, sf):
    resid = G.var_residuals(multivariate(spark, sf), KEYS, "day", VARS, 13)
    return rounded(S.durbin_watson(resid, [*KEYS, "response"], "day", "residual"))


def levels_ahead(days, cols, order):
    """Second differences of the training part, forecast, and brought back to levels."""
    train, _ = S.tail_split(days, KEYS, "day", 20)
    diffs = train
    for v in cols:
        diffs = S.difference(diffs, KEYS, "day", v, 2, f"{v}_2d")
    diffs = diffs.where(F.col("n_2d").isNotNull())
    ahead = G.var_forecast(diffs, KEYS, "day", [f"{v}_2d" for v in cols], order, 20)
    level = partial(S.undifference, keys=KEYS, day="day", order=2)
    for v in cols:
        ahead = level(ahead, S.last_values(train, KEYS, "day", v), value=f"{v}_2d", out=f"{v}_forecast")
    return day_text(rounded(ahead.select("series", "day", *[f"{v}_forecast" for v in cols]), 4))


@query("z16_var_forecast_levels", f"""WITH RECURSIVE {VARS_SQL}, {TRAIN_SQL}, seconds AS (SELECT series, day, {', '.join(f'{v} - 2 * lag({v}) OVER o + lag({v}, 2) OVER o AS {v}2' for v in VARS)} FROM train WINDOW o AS (PARTITION BY series ORDER BY day)),
diffs AS (SELECT * FROM seconds WHERE n2 IS NOT NULL), {ahead_sql('diffs', [f'{v}2' for v in VARS], 13, 20)},
last AS (SELECT series, {', '.join(f'list({v} ORDER BY day DESC)[1:2] AS {v}' for v in VARS)} FROM train GROUP BY 1),
up AS (SELECT r.series, step, {', '.join(f'sum(r.recent[{c + 1}]) OVER o AS s{c}' for c in range(3))} FROM r WHERE step > 0 WINDOW o AS (PARTITION BY series ORDER BY step))
SELECT up.series, CAST(CAST(last_day + step AS DATE) AS VARCHAR) AS day, {', '.join(f'round(last.{v}[1] + sum(last.{v}[1] - last.{v}[2] + s{c}) OVER q, 4) AS {v}_forecast' for c, v in enumerate(VARS))}
FROM up JOIN e USING (series) JOIN last USING (series) WINDOW q AS (PARTITION BY up.series ORDER BY step)""")
def z16(spark, sf):
    return levels_ahead(multivariate(spark, sf), VARS, 13)


@query("z17_forecast_accuracy", f"""WITH {FILLED_SQL}, p AS (SELECT series, n + 1 AS a, lag(n, 7) OVER (PARTITION BY series ORDER BY day) + 1 AS f FROM filled), q AS (SELECT * FROM p WHERE f IS NOT NULL)
SELECT series, round(avg(abs(f - a) / abs(a)), 6) AS mape, round(avg(f - a), 6) AS me, round(avg(abs(f - a)), 6) AS mae, round(avg((f - a) / a), 6) AS mpe,
round(sqrt(avg((f - a) * (f - a))), 6) AS rmse, round(corr(f, a), 6) AS corr, round(1 - avg(least(f, a) / greatest(f, a)), 6) AS minmax FROM q GROUP BY 1""")
def z17(spark, sf):
    w = S.over_days(KEYS, "day")
    pairs = filled(spark, sf).select("series", (F.col("n") + 1).alias("a"), (F.lag("n", 7).over(w) + 1).alias("f")).where("f IS NOT NULL")
    return rounded(S.forecast_accuracy(pairs, "f", "a", KEYS))


# --- forms with a closed solution, so that SQL can check the same code by value ------


@query("z3_pacf_two_lags", f"""WITH {FILLED_SQL}, c AS (SELECT series, day, n - avg(n) OVER (PARTITION BY series) AS d, count(*) OVER (PARTITION BY series) AS cnt FROM filled),
l AS (SELECT *, lag(d, 1) OVER (PARTITION BY series ORDER BY day) AS d1, lag(d, 2) OVER (PARTITION BY series ORDER BY day) AS d2 FROM c),
r AS (SELECT series, sum(d * d1) / sum(d * d) AS r1, sum(d * d2) / sum(d * d) AS r2, {S.Z95} / sqrt(any_value(cnt)) AS b FROM l GROUP BY 1)
SELECT series, 0 AS lag, 1.0::DOUBLE AS pacf, round(b, 6) AS bound95 FROM r UNION ALL SELECT series, 1, round(r1, 6), round(b, 6) FROM r
UNION ALL SELECT series, 2, round((r2 - r1 * r1) / (1 - r1 * r1), 6), round(b, 6) FROM r""")
def z3b(spark, sf):
    return rounded(G.pacf(filled(spark, sf), KEYS, "day", "n", 2))


@query("z4_adf_no_lags", f"""WITH {FILLED_SQL}, l AS (SELECT series, n - lag(n) OVER (PARTITION BY series ORDER BY day) AS dy, lag(n) OVER (PARTITION BY series ORDER BY day) AS y1 FROM filled),
f AS (SELECT series, regr_slope(dy, y1) AS b, regr_syy(dy, y1) * (1 - regr_r2(dy, y1)) AS ssr, regr_sxx(dy, y1) AS sxx, count(y1) AS n FROM l WHERE y1 IS NOT NULL GROUP BY 1)
SELECT series, round(b / sqrt(ssr / (n - 2) / sxx), 4) AS statistic, 0 AS n_lags, n::BIGINT AS n_obs FROM f""")
def z4c(spark, sf):
    out = G.adf(filled(spark, sf), KEYS, "day", "n", 0)
    return out.select("series", F.round("statistic", 4).alias("statistic"), "n_lags", "n_obs")


# Differencing alone has no coefficient to fit: the score is a sum of squares.
PLAIN = [o for o in SE.ORDERS if o[0] + o[2] + o[3] + o[5] == 0]


def _plain_sql(d, big_d):
    burn = 1 + d + 20 * big_d
    return f"""SELECT series, '(0, {d}, 0, 0, {big_d}, 0, 20)' AS "order", ln(2 * pi() * avg(w * w)) AS lg, count(*) AS k FROM (SELECT series, i, {
        {(0, 0): 'n', (1, 0): 'n - n1', (0, 1): 'n - n20', (1, 1): 'n - n1 - n20 + n21'}[d, big_d]} AS w FROM lagged) WHERE i > {burn} GROUP BY 1"""


@query("z6_sarima_grid_differences", f"""WITH {FILLED_SQL}, lagged AS (SELECT series, n, row_number() OVER w AS i, lag(n, 1) OVER w AS n1, lag(n, 20) OVER w AS n20, lag(n, 21) OVER w AS n21
FROM filled WINDOW w AS (PARTITION BY series ORDER BY day)), u AS ({' UNION ALL '.join(_plain_sql(d, b) for d in (0, 1) for b in (0, 1))})
SELECT series, "order", round(k * (lg + 1) + 2, 4) AS aic, round(k * (lg + 1) + ln(k), 4) AS bic FROM u""")
def z6b(spark, sf):
    return rounded(SE.sarima_grid(filled(spark, sf), KEYS, "day", "n", 20, PLAIN).select(*SCORES), 4)


WALK = [(0, 1, 0, 0, 0, 0)]


def walk(spark, sf):
    days = filled(spark, sf)
    return days, SE.best_order(SE.sarima_grid(days, KEYS, "day", "n", 20, WALK), KEYS)


@query("z7_fit_random_walk", f"""WITH {FILLED_SQL} SELECT series, CAST(day AS VARCHAR) AS day, n AS value, lag(n) OVER w AS fitted, n - lag(n) OVER w AS residual
FROM filled WINDOW w AS (PARTITION BY series ORDER BY day)""")
def z7b(spark, sf):
    days, order = walk(spark, sf)
    return day_text(rounded(SE.fit_best(days, KEYS, "day", "n", order)))


@query("z9_forecast_random_walk", f"""WITH {FILLED_SQL}, r AS (SELECT series, day, n, n - lag(n) OVER w AS e, row_number() OVER w AS i FROM filled WINDOW w AS (PARTITION BY series ORDER BY day)),
f AS (SELECT series, max(day) AS last_day, arg_max(n, day) AS m, sqrt(avg(e * e) FILTER (i > 2)) AS s FROM r GROUP BY 1), h AS (SELECT unnest(generate_series(1, 30)) AS h)
SELECT series, CAST(CAST(last_day + h::INT AS DATE) AS VARCHAR) AS date, round(m, 4) AS predicted_mean, round(m - {S.Z95} * s * sqrt(h), 4) AS lower_bound,
round(m + {S.Z95} * s * sqrt(h), 4) AS upper_bound FROM f, h""")
def z9b(spark, sf):
    days, order = walk(spark, sf)
    return day_text(rounded(SE.forecast(days, KEYS, "day", "n", order, steps=30), 4), "date")


@query("z10_granger_one_lag", f"""WITH w AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS day, count(*)::DOUBLE AS n, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS c FROM orders GROUP BY ALL),
span AS (SELECT series, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM w GROUP BY 1),
f AS (SELECT series, day, coalesce(n, 0) AS n, coalesce(c, 0) AS c FROM span LEFT JOIN w USING (series, day)),
l AS (SELECT series, n, c, lag(n) OVER (PARTITION BY series ORDER BY day) AS n1, lag(c) OVER (PARTITION BY series ORDER BY day) AS c1 FROM f),
k AS (SELECT series, count(*) AS k, corr(n, n1) AS nn, corr(n, c1) AS nc, corr(c, c1) AS cc, corr(c, n1) AS cn, corr(n1, c1) AS x FROM l WHERE n1 IS NOT NULL GROUP BY 1),
s AS (SELECT series, k, 1 - nn * nn AS rn, 1 - (nn * nn + nc * nc - 2 * nn * nc * x) / (1 - x * x) AS jn, 1 - cc * cc AS rc, 1 - (cc * cc + cn * cn - 2 * cc * cn * x) / (1 - x * x) AS jc FROM k)
SELECT series, 'n' AS response, 'closed' AS cause, k * (rn - jn) / jn < 3.841458820694124 AS above FROM s
UNION ALL SELECT series, 'closed', 'n', k * (rc - jc) / jc < 3.841458820694124 FROM s""")
def z10b(spark, sf):
    out = G.granger_matrix(multivariate(spark, sf), KEYS, "day", ["n", "closed"], 1, digits=12)
    return out.where("response <> cause").select("series", "response", "cause", (F.col("p_value") > 0.05).alias("above"))


@query("z13_var_select_one", f"""WITH {FILLED_SQL}, l AS (SELECT series, n AS y, lag(n) OVER (PARTITION BY series ORDER BY day) AS x FROM filled),
f AS (SELECT series, ln(regr_syy(y, x) * (1 - regr_r2(y, x)) / count(x)) AS ld, count(x)::BIGINT AS n FROM l WHERE x IS NOT NULL GROUP BY 1)
SELECT series, 1 AS lag_order, round(ld + 4 / n, 6) AS aic, round(ld + ln(n) * 2 / n, 6) AS bic, round((n + 2) / (n - 2) * exp(ld), 6) AS fpe, round(ld + 4 * ln(ln(n)) / n, 6) AS hqic, n FROM f""")
def z13c(spark, sf):
    return rounded(G.var_select(filled(spark, sf), KEYS, "day", ["n"], 1))


@query("z14_var_forecast_one", f"""WITH RECURSIVE {FILLED_SQL}, l AS (SELECT series, day, n AS y, lag(n) OVER (PARTITION BY series ORDER BY day) AS x FROM filled),
f AS (SELECT series, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, max(day) AS last_day, arg_max(y, day) AS y FROM l WHERE x IS NOT NULL GROUP BY 1),
r(series, step, n) AS (SELECT series, 0, y FROM f UNION ALL SELECT r.series, r.step + 1, f.a + f.b * r.n FROM r JOIN f ON f.series = r.series WHERE r.step < 20)
SELECT r.series, r.step, CAST(CAST(last_day + step AS DATE) AS VARCHAR) AS day, round(r.n, 5) AS n FROM r JOIN f USING (series) WHERE r.step > 0""")
def z14b(spark, sf):
    return day_text(rounded(G.var_forecast(filled(spark, sf), KEYS, "day", ["n"], 1, 20), 5))


# Two columns and one lag: the coefficients and the covariance of the rest from covariances.
PAIR = ["n", "closed"]
PAIR_SQL = """w AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS day, count(*)::DOUBLE AS n, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS closed FROM orders GROUP BY ALL),
span AS (SELECT series, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM w GROUP BY 1),
pair AS (SELECT series, day, coalesce(n, 0) AS n, coalesce(closed, 0) AS closed FROM span LEFT JOIN w USING (series, day)),
l AS (SELECT series, day, n, closed, lag(n) OVER o AS n1, lag(closed) OVER o AS c1 FROM pair WINDOW o AS (PARTITION BY series ORDER BY day)),
v AS (SELECT series, count(*)::BIGINT AS k, avg(n) AS mn, avg(closed) AS mc, avg(n1) AS mn1, avg(c1) AS mc1, var_pop(n1) AS a, var_pop(c1) AS b, covar_pop(n1, c1) AS x,
 covar_pop(n, n1) AS nn, covar_pop(n, c1) AS nc, covar_pop(closed, n1) AS cn, covar_pop(closed, c1) AS cc, var_pop(n) AS vn, var_pop(closed) AS vc, covar_pop(n, closed) AS vx FROM l WHERE n1 IS NOT NULL GROUP BY 1),
g AS (SELECT *, (nn * b - nc * x) / (a * b - x * x) AS n_n, (nc * a - nn * x) / (a * b - x * x) AS n_c, (cn * b - cc * x) / (a * b - x * x) AS c_n, (cc * a - cn * x) / (a * b - x * x) AS c_c FROM v),
fit AS (SELECT *, mn - n_n * mn1 - n_c * mc1 AS n_0, mc - c_n * mn1 - c_c * mc1 AS c_0, vn - n_n * nn - n_c * nc AS s_n, vc - c_n * cn - c_c * cc AS s_c, vx - n_n * cn - n_c * cc AS s_x FROM g)"""


@query("z10_granger_statistics", f"""WITH {PAIR_SQL} SELECT series, 'n' AS response, 'closed' AS cause, 1 AS lag, round(k * (vn - nn * nn / a - s_n) / s_n, 5) AS statistic FROM fit
UNION ALL SELECT series, 'closed', 'n', 1, round(k * (vc - cc * cc / b - s_c) / s_c, 5) FROM fit""")
def z10c(spark, sf):
    return rounded(G.granger_tests(multivariate(spark, sf), KEYS, "day", PAIR, 1).drop("p_value"), 5)


@query("z11_lag_ols_pair", f"""WITH {PAIR_SQL} SELECT series, term, round(c, 5) AS coefficient, round(k * s_n, 3) AS ssr, k AS n
FROM fit, LATERAL (VALUES ('const', n_0), ('n_lag1', n_n), ('closed_lag1', n_c)) AS t(term, c)""")
def z11d(spark, sf):
    out = G.lag_ols(multivariate(spark, sf), KEYS, "day", "n", PAIR, 1)
    return out.withColumns({"coefficient": F.round("coefficient", 5), "ssr": F.round("ssr", 3)})


@query("z13_var_select_pair", f"""WITH {PAIR_SQL}, d AS (SELECT series, k, ln(s_n * s_c - s_x * s_x) AS ld FROM fit)
SELECT series, 1 AS lag_order, round(ld + 12 / k, 6) AS aic, round(ld + ln(k) * 6 / k, 6) AS bic, round(pow((k + 3) / (k - 3), 2) * exp(ld), 6) AS fpe,
round(ld + 12 * ln(ln(k)) / k, 6) AS hqic, k AS n FROM d""")
def z13d(spark, sf):
    return rounded(G.var_select(multivariate(spark, sf), KEYS, "day", PAIR, 1))


@query("z14_var_forecast_pair", f"""WITH RECURSIVE {PAIR_SQL}, e AS (SELECT series, max(day) AS last_day, arg_max(n, day) AS n, arg_max(closed, day) AS c FROM l GROUP BY 1),
r(series, step, n, c) AS (SELECT series, 0, n, c FROM e UNION ALL
 SELECT r.series, r.step + 1, n_0 + n_n * r.n + n_c * r.c, c_0 + c_n * r.n + c_c * r.c FROM r JOIN fit ON fit.series = r.series WHERE r.step < 20)
SELECT r.series, step, CAST(CAST(last_day + step AS DATE) AS VARCHAR) AS day, round(r.n, 5) AS n, round(r.c, 5) AS closed FROM r JOIN e ON e.series = r.series WHERE step > 0""")
def z14c(spark, sf):
    return day_text(rounded(G.var_forecast(multivariate(spark, sf), KEYS, "day", PAIR, 1, 20), 5))


@query("z15_durbin_watson_pair", f"""WITH {PAIR_SQL}, e AS (SELECT l.series, day, l.n - n_0 - n_n * n1 - n_c * c1 AS n, closed - c_0 - c_n * n1 - c_c * c1 AS c FROM l JOIN fit USING (series) WHERE n1 IS NOT NULL),
s AS (SELECT *, n - lag(n) OVER o AS dn, c - lag(c) OVER o AS dc FROM e WINDOW o AS (PARTITION BY series ORDER BY day))
SELECT series, 'n' AS response, round(sum(dn * dn) / sum(n * n), 6) AS durbin_watson FROM s GROUP BY 1 UNION ALL SELECT series, 'closed', round(sum(dc * dc) / sum(c * c), 6) FROM s GROUP BY 1""")
def z15c(spark, sf):
    resid = G.var_residuals(multivariate(spark, sf), KEYS, "day", PAIR, 1)
    return rounded(S.durbin_watson(resid, [*KEYS, "response"], "day", "residual"))


@query("z16_var_forecast_levels_one", f"""WITH RECURSIVE {TAIL_SQL}, tr AS (SELECT series, day, n, n - lag(n) OVER o AS s, n - 2 * lag(n) OVER o + lag(n, 2) OVER o AS y
 FROM (SELECT series, day, n FROM r WHERE r > 20) WINDOW o AS (PARTITION BY series ORDER BY day)),
p AS (SELECT *, lag(y) OVER (PARTITION BY series ORDER BY day) AS x FROM tr),
f AS (SELECT series, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM p WHERE x IS NOT NULL GROUP BY 1),
e AS (SELECT series, max(day) AS last_day, arg_max(y, day) AS y, arg_max(s, day) AS s, arg_max(n, day) AS n FROM tr GROUP BY 1),
q(series, step, y, s, n) AS (SELECT series, 0, y, s, n FROM e UNION ALL
 SELECT q.series, q.step + 1, a + b * q.y, q.s + a + b * q.y, q.n + q.s + a + b * q.y FROM q JOIN f ON f.series = q.series WHERE q.step < 20)
SELECT q.series, CAST(CAST(last_day + step AS DATE) AS VARCHAR) AS day, round(q.n, 4) AS n_forecast FROM q JOIN e ON e.series = q.series WHERE step > 0""")
def z16b(spark, sf):
    return levels_ahead(filled(spark, sf), ["n"], 1)


# At most one lagged difference: the order is chosen on the rows both can use, then refitted on all its own.
@query("z4_adf_one_lag", f"""WITH {FILLED_SQL}, s AS (SELECT series, day, lag(n) OVER o AS y1, n - lag(n) OVER o AS dy FROM filled WINDOW o AS (PARTITION BY series ORDER BY day)),
l AS (SELECT *, lag(dy) OVER (PARTITION BY series ORDER BY day) AS d1 FROM s),
both_fits AS (SELECT series, count(*) AS n, regr_syy(dy, y1) AS syy, regr_sxx(dy, y1) AS s1, corr(dy, y1) AS r1, corr(dy, d1) AS r2, corr(y1, d1) AS x FROM l WHERE d1 IS NOT NULL GROUP BY 1),
one AS (SELECT *, syy * (1 - r1 * r1) AS ssr0, syy * (1 - (r1 * r1 + r2 * r2 - 2 * r1 * r2 * x) / (1 - x * x)) AS ssr1, sqrt(syy / s1) * (r1 - r2 * x) / (1 - x * x) AS b1 FROM both_fits),
none AS (SELECT series, count(*) AS n, regr_slope(dy, y1) AS b, regr_sxx(dy, y1) AS sxx, regr_syy(dy, y1) * (1 - regr_r2(dy, y1)) AS ssr FROM l WHERE y1 IS NOT NULL GROUP BY 1)
SELECT one.series, CASE WHEN one.n * ln(ssr1) + 2 < one.n * ln(ssr0) THEN round(b1 / sqrt(ssr1 / (one.n - 3) / (s1 * (1 - x * x))), 4) ELSE round(b / sqrt(ssr / (none.n - 2) / sxx), 4) END AS statistic,
CASE WHEN one.n * ln(ssr1) + 2 < one.n * ln(ssr0) THEN 1 ELSE 0 END AS n_lags, (CASE WHEN one.n * ln(ssr1) + 2 < one.n * ln(ssr0) THEN one.n ELSE none.n END)::BIGINT AS n_obs
FROM one JOIN none USING (series)""")
def z4d(spark, sf):
    out = G.adf(filled(spark, sf), KEYS, "day", "n", 1)
    return out.select("series", F.round("statistic", 4).alias("statistic"), "n_lags", "n_obs")


# One coefficient: least squares on the lagged difference. A moving average expanded to one lag has the same sum.
ONE = [(p, d, 1 - p, 0, big_d, 0) for p in (0, 1) for d in (0, 1) for big_d in (0, 1)]
DIFFED_SQL = """lagged AS (SELECT series, day, n, row_number() OVER w AS i, lag(n, 1) OVER w AS n1, lag(n, 20) OVER w AS n20, lag(n, 21) OVER w AS n21
FROM filled WINDOW w AS (PARTITION BY series ORDER BY day)), forms AS (SELECT series, day, 0 AS d, 0 AS sd, n AS w FROM lagged UNION ALL SELECT series, day, 1, 0, n - n1 FROM lagged WHERE i > 1
UNION ALL SELECT series, day, 0, 1, n - n20 FROM lagged WHERE i > 20 UNION ALL SELECT series, day, 1, 1, n - n1 - n20 + n21 FROM lagged WHERE i > 21),
steps AS (SELECT *, row_number() OVER o AS t, lag(w) OVER o AS w1 FROM forms WINDOW o AS (PARTITION BY series, d, sd ORDER BY day))"""


@query("z6_sarima_grid_one_coefficient", f"""WITH {FILLED_SQL}, {DIFFED_SQL}, f AS (SELECT series, d, sd, p, count(*) AS k, sum(w * w) - pow(sum(w * w1), 2) / sum(w1 * w1) AS ssr FROM steps, (VALUES (0), (1)) AS o(p) WHERE t > 2 - p GROUP BY ALL),
u AS (SELECT *, k * (ln(2 * pi() * ssr / k) + 1) AS lg FROM f)
SELECT series, '(' || p || ', ' || d || ', ' || (1 - p) || ', 0, ' || sd || ', 0, 20)' AS "order", round(lg + 4, 4) AS aic, round(lg + 2 * ln(k), 4) AS bic FROM u""")
def z6c(spark, sf):
    return rounded(SE.sarima_grid(filled(spark, sf), KEYS, "day", "n", 20, ONE, [0, 1]).select(*SCORES), 4)


AR_SQL = f"""{FILLED_SQL}, {DIFFED_SQL}, ar AS (SELECT series, sum(w * w1) / sum(w1 * w1) AS b, sqrt((sum(w * w) - pow(sum(w * w1), 2) / sum(w1 * w1)) / count(*)) AS s
FROM steps WHERE d = 1 AND sd = 0 AND t > 1 GROUP BY 1)"""


def ar_best(spark, sf):
    days = filled(spark, sf)
    return days, SE.best_order(SE.sarima_grid(days, KEYS, "day", "n", 20, [(1, 1, 0, 0, 0, 0)]), KEYS)


@query("z7_fit_autoregression", f"""WITH {AR_SQL} SELECT series, CAST(day AS VARCHAR) AS day, n AS value, round(n - (w - b * coalesce(w1, 0)), 4) AS fitted, round(w - b * coalesce(w1, 0), 4) AS residual
FROM filled LEFT JOIN (SELECT * FROM steps WHERE d = 1 AND sd = 0) USING (series, day) JOIN ar USING (series)""")
def z7c(spark, sf):
    days, order = ar_best(spark, sf)
    return day_text(rounded(SE.fit_best(days, KEYS, "day", "n", order), 4))


AHEAD_SQL = f"""WITH {AR_SQL}, e AS (SELECT series, max(day) AS last_day, arg_max(n, day) AS n FROM filled GROUP BY 1), x AS (SELECT series, arg_max(w, day) AS w FROM steps WHERE d = 1 AND sd = 0 GROUP BY 1),
h AS (SELECT unnest(generate_series(1, 30)) AS h),
a AS (SELECT series, last_day, h, n + w * b * (1 - pow(b, h)) / (1 - b) AS m, s * sqrt(sum(pow((1 - pow(b, h)) / (1 - b), 2)) OVER (PARTITION BY series ORDER BY h)) AS sd FROM e JOIN x USING (series) JOIN ar USING (series), h)
SELECT series, CAST(CAST(last_day + h::INT AS DATE) AS VARCHAR) AS date, round(m, 4) AS predicted_mean, round(m - {S.Z95} * sd, 4) AS lower_bound, round(m + {S.Z95} * sd, 4) AS upper_bound FROM a"""


@query("z9_forecast_autoregression", AHEAD_SQL)
def ar_forecast(spark, sf):
    days, order = ar_best(spark, sf)
    return day_text(rounded(SE.forecast(days, KEYS, "day", "n", order, steps=30), 4), "date")


query("j13_forecast_autoregression", AHEAD_SQL)(ar_forecast)
