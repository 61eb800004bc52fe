"""Small numeric helpers used on aggregated rows."""

from __future__ import annotations

import math

import numpy as np

# MacKinnon (1994) p-value polynomials and (2010) critical values,
# constant-only regression, one series.
ADF_TAU_MAX, ADF_TAU_MIN, ADF_TAU_STAR = 2.74, -18.83, -1.61
ADF_SMALL_P = (2.1659, 1.4412, 0.038269)
ADF_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_CRITICAL = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def default_adf_lags(n: int) -> int:
    """Usual largest lag order for a series of n values."""
    return min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)


def adf_p_value(tau: float) -> float:
    if tau > ADF_TAU_MAX:
        return 1.0
    if tau < ADF_TAU_MIN:
        return 0.0
    coef = ADF_SMALL_P if tau <= ADF_TAU_STAR else ADF_LARGE_P
    return normal_cdf(sum(c * tau**i for i, c in enumerate(coef)))


def adf_critical(level: str, n: int) -> float:
    return sum(c / n**i for i, c in enumerate(ADF_CRITICAL[level]))


def chi2_tail(x: float, dof: int) -> float:
    """P(X > x): upper incomplete gamma by series below the mean, continued fraction above."""
    if x <= 0:
        return 1.0
    a, z = dof / 2.0, x / 2.0
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h


def solve_gram(gram: np.ndarray, xs: list[int], y: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Least squares from a cross-product matrix: coefficients, SSR, inverse of X'X."""
    xx, xy = gram[np.ix_(xs, xs)], gram[xs, y]
    inv = np.linalg.pinv(xx, hermitian=True)
    scale = np.sqrt(np.diag(xx))
    if np.all(scale > 0):
        # Solving on unit-scaled columns keeps large and small series apart.
        inv = np.linalg.pinv(xx / np.outer(scale, scale), rcond=1e-13, hermitian=True) / np.outer(scale, scale)
    beta = inv @ xy
    return beta, max(float(gram[y, y] - beta @ xy), 0.0), inv


def durbin_levinson(rho: np.ndarray) -> np.ndarray:
    """Partial autocorrelations from autocorrelations (rho[0] = 1)."""
    out = [1.0]
    phi = np.zeros(0)
    for k in range(1, len(rho)):
        tail = rho[1:k][::-1]
        denominator = 1.0 - phi @ rho[1:k] if k > 1 else 1.0
        last = (rho[k] - phi @ tail) / denominator if denominator else float("nan")
        phi = np.append(phi - last * phi[::-1], last)
        out.append(float(last))
    return np.array(out)
