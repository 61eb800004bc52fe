"""Least squares in plain SQL, for the twins of lagged regressions: Gram matrices as lists, solved by sweeps in a recursive query."""

from __future__ import annotations

from collections.abc import Sequence


def lagged(source: str, cols: Sequence[str], lags: int, by_column: bool = False) -> str:
    """`x`: series, day, t (from 0) and x = [1, the lags, the columns]; lag by lag, or column by column; zero before the start."""
    at = [(c, i) for c in cols for i in range(1, lags + 1)] if by_column else [(c, i) for i in range(1, lags + 1) for c in cols]
    past = ", ".join(f"coalesce(lag({c}, {i}) OVER w, 0)::DOUBLE" for c, i in at)
    return f"""x AS MATERIALIZED (SELECT series, day, row_number() OVER w - 1 AS t, [1.0::DOUBLE, {past}, {', '.join(f'{c}::DOUBLE' for c in cols)}] AS x
    FROM {source} WINDOW w AS (PARTITION BY series ORDER BY day))"""


def grams(rows: str, size: str, group: str) -> str:
    """`cell`: the sums of products, and `g`: series, `group`, n and the matrix `a`, row by row."""
    return f"""cell AS MATERIALIZED (SELECT series, {group} AS o, i, j, sum(x[i] * x[j]) AS s FROM {rows}, (SELECT unnest(range(1, {size} + 1)) AS i), (SELECT unnest(range(1, {size} + 1)) AS j) GROUP BY ALL),
g AS MATERIALIZED (SELECT series, o, list(s ORDER BY i, j) AS a FROM cell GROUP BY ALL)"""


def added(orders: str) -> str:
    """`full`: for each order o of `orders`, the matrix of all rows that can serve it."""
    return f"""full_cell AS (SELECT series, k.o, i, j, sum(s) AS s FROM cell, ({orders}) k WHERE cell.o >= k.o GROUP BY ALL),
whole AS MATERIALIZED (SELECT series, o, list(s ORDER BY i, j) AS a FROM full_cell GROUP BY ALL)"""


def swept(source: str, size: str, steps: str, name: str = "z", keys: str = "series, o") -> str:
    """`name`: keys, k and `a` after sweeping the first k columns, for all k up to `steps`.

    A swept matrix holds the coefficients of a column in its rows of swept
    columns, the inverse there, and the sum of squares left over in its own place.
    """
    m, own = f"{size}", f"a[k * {size} + k + 1]"
    return f"""{name}({keys}, k, a, top) AS (SELECT {keys}, 0, a, {steps} FROM {source} UNION ALL
 SELECT {keys}, k + 1, list_transform(range(0, {m} * {m}), lambda q: CASE WHEN q = k * {m} + k THEN 1 / {own} WHEN q // {m} = k THEN a[q + 1] / {own} WHEN q % {m} = k THEN -a[q + 1] / {own}
  ELSE a[q + 1] - a[(q // {m}) * {m} + k + 1] * a[k * {m} + q % {m} + 1] / {own} END), top FROM {name} WHERE k < top)"""


def normal_cdf(x: str) -> str:
    """The normal distribution by its power series."""
    terms = f"list_sum(list_transform(range(0, 400), lambda i: exp((2 * i + 1) * ln(abs({x}) + 1e-300) - lgamma(2 * i + 2) + i * ln(2) + lgamma(i + 1) - {x} * {x} / 2)))"
    return f"(CASE WHEN abs({x}) > 12 THEN CASE WHEN {x} > 0 THEN 1.0 ELSE 0.0 END ELSE 0.5 + sign({x}) * {terms} / sqrt(2 * pi()) END)"


def chi2_tail(x: str, dof: str) -> str:
    """P(X > x) by the power series of the incomplete gamma function."""
    z, a = f"({x} / 2)", f"({dof} / 2.0::DOUBLE)"
    below = f"list_sum(list_transform(range(0, 600), lambda i: exp(({a} + i) * ln({z}) - {z} - lgamma({a} + i + 1))))"
    return f"(CASE WHEN {x} <= 0 THEN 1.0 WHEN {x} > 500 THEN 0.0 ELSE greatest(0.0, 1 - {below}) END)"
