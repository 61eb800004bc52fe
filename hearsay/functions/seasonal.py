"""Seasonal ARIMA on finished cross-products: conditional least squares and the forecast recursion.

(1 - phi B)(1 - Phi B^s) w = (1 + theta B)(1 + Theta B^s) e, with w the
differenced series and each of p, q, P, Q either 0 or 1. Solved for e, the model
is one row of weights on w and its lags, so the squared residuals of any
coefficients are a quadratic form in the Gram of those lags. Over a few lags that
gives starting values (`fit`); `next_trial` moves on from the Gram of the residuals
of the whole recursion and their slopes. Values before the first are taken as
zero. Coefficients stay inside the unit interval.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

EDGE = 0.999


def reach(period: int, near: int = 9, seasons: int = 6) -> list[int]:
    """The lags a moving average is expanded to for starting values: up to `near` days after each of `seasons` seasons."""
    return sorted({i + period * j for i in range(near + 1) for j in range(seasons + 1)})


def burn_in(order: Sequence[int], period: int) -> int:
    """Leading differenced values a state-space fit leaves out of the likelihood."""
    p, _, q, big_p, _, big_q = order
    return max(p + period * big_p, q + period * big_q + 1)


def weights(coef: Sequence[float], lags: Sequence[int], period: int) -> np.ndarray:
    """Weights of w at each of `lags` in e, for the coefficients (phi, theta, Phi, Theta)."""
    top = max(lags) + 1

    def ratio(ar: float, ma: float, step: int) -> np.ndarray:
        inverse = np.zeros(top)
        inverse[::step] = (-ma) ** np.arange(len(inverse[::step]))
        shifted = np.concatenate((np.zeros(step), inverse))[:top]
        return inverse - ar * shifted

    phi, theta, big_phi, big_theta = coef
    return np.convolve(ratio(phi, theta, 1), ratio(big_phi, big_theta, period))[:top][list(lags)]


def fit(gram: np.ndarray, n: int, order: Sequence[int], lags: Sequence[int], period: int, rounds: int = 200) -> dict | None:
    """Levenberg-Marquardt within the bounds on the Gram of w at `lags`, lag 0 first; None without enough days or without a rest."""
    p, _, q, big_p, _, big_q = order
    free = np.array([p, q, big_p, big_q], bool)
    k = int(free.sum())
    if n <= k + 1:
        return None

    coef = np.zeros(4)

    def moved(step: np.ndarray) -> np.ndarray:
        out = coef.copy()
        out[free] = np.clip(coef[free] + step, -EDGE, EDGE)
        return out

    v = weights(coef, lags, period)
    ssr, damping, converged = float(v @ gram @ v), 1e-3, not k
    if not ssr > 1e-12 * gram[0, 0]:
        return None
    for _ in range(rounds if k else 0):
        raised = [coef + 1e-6 * unit for unit in np.eye(4)[free]]
        lowered = [coef - 1e-6 * unit for unit in np.eye(4)[free]]
        slope = np.column_stack([(weights(a, lags, period) - weights(b, lags, period)) / 2e-6 for a, b in zip(raised, lowered)])
        normal, gradient = slope.T @ gram @ slope, slope.T @ (gram @ v)
        # A coefficient at the edge that would leave the interval stays there for this round.
        go = ~((coef[free] >= EDGE) & (gradient < 0) | (coef[free] <= -EDGE) & (gradient > 0))
        step = np.zeros(k)
        for _ in range(12 if go.any() else 0):
            own = normal[np.ix_(go, go)]
            step[go] = np.linalg.solve(own + damping * np.diag(np.diag(own) + 1e-9), -gradient[go])
            trial = moved(step)
            row = weights(trial, lags, period)
            after = float(row @ gram @ row)
            if after < ssr:
                break
            damping *= 10
        else:
            converged = True  # no direction lowers the sum any more
            break
        gain = ssr - after
        coef, v, ssr, damping = trial, row, after, max(damping / 10, 1e-12)
        if gain < 1e-13 * ssr:
            converged = True
            break
    if not ssr > 1e-12 * gram[0, 0]:
        return None
    return scores(ssr, n, order) | {"coef": coef, "weights": v, "converged": converged}


def recursion_grams(x: np.ndarray, coefs: np.ndarray, burn: np.ndarray, period: int) -> np.ndarray:
    """Per row of `coefs`, the summed products of the residual and its slopes by phi, theta, Phi and Theta, by the whole recursion.

    `x` has a row per day: the value and those 1, `period` and `period` + 1 days
    before. A day of NaN has no residual: it counts as zero for later days and
    not in the sums, which start after `burn` days.
    """
    phi, theta, big_phi, big_theta = np.asarray(coefs, float).T
    known = ~np.isnan(x).any(axis=1)
    own = np.zeros((len(x), len(phi), 5))
    day = np.where(known[:, None], x, 0.0)[:, :, None]
    own[:, :, 0] = day[:, 0] - phi * day[:, 1] - big_phi * day[:, 2] + phi * big_phi * day[:, 3]
    own[:, :, 1] = big_phi * day[:, 3] - day[:, 1]
    own[:, :, 3] = phi * day[:, 3] - day[:, 2]
    if known.all():
        past = own
        past[:, :, 0] = _inverted(own[:, :, 0], theta, big_theta, period)
        past[1:, :, 2] -= past[:-1, :, 0]
        past[period:, :, 4] -= past[:-period, :, 0]
        past[period + 1:, :, 2] -= big_theta * past[:-period - 1, :, 0]
        past[period + 1:, :, 4] -= theta * past[:-period - 1, :, 0]
        past[:, :, 1:] = _inverted(own[:, :, 1:], theta[:, None], big_theta[:, None], period)
        return np.stack([past[n:, i].T @ past[n:, i] for i, n in enumerate(burn)])
    past, none = np.zeros_like(own), np.zeros((len(phi), 5))
    back = np.column_stack((theta, big_theta, theta * big_theta))[:, :, None]
    for t in np.flatnonzero(known):
        a, b, c = (past[t - lag] if t >= lag else none for lag in (1, period, period + 1))
        made = own[t] - back[:, 0] * a - back[:, 1] * b - back[:, 2] * c
        made[:, 2] -= a[:, 0] + big_theta * c[:, 0]
        made[:, 4] -= b[:, 0] + theta * c[:, 0]
        past[t] = made
    return np.stack([past[n:, i].T @ past[n:, i] for i, n in enumerate(burn)])


def _inverted(x: np.ndarray, theta: np.ndarray, big_theta: np.ndarray, period: int) -> np.ndarray:
    """The series y with y(t) + theta y(t-1) + Theta y(t-s) + theta Theta y(t-s-1) = x(t): season by season, then by doubling steps."""
    out = np.array(x)
    for t in range(period, len(out), period):
        out[t: t + period] -= big_theta * out[t - period: t - period + len(out[t: t + period])]
    step, power = 1, -theta
    while step < len(out) and np.abs(power).max(initial=0) > 1e-30:
        out[step:] = out[step:] + power * out[:-step]
        step, power = 2 * step, power * power
    return out


def fit_whole(x: np.ndarray, tasks: Sequence[tuple[Sequence[int], Sequence[float]]], period: int, rounds: int = 200) -> list[dict | None]:
    """The fit of each (order, starting coefficients) by the whole recursion over `x`; None without enough days or without a rest."""
    burn = np.array([burn_in(order, period) for order, _ in tasks])
    used = [x[n:][~np.isnan(x[n:]).any(axis=1), 0] for n in burn]
    trials, held = [np.asarray(start, float) for _, start in tasks], [None] * len(tasks)
    go = [i for i, (order, _) in enumerate(tasks) if len(used[i]) > 1 + order[0] + order[2] + order[3] + order[5]]
    for _ in range(rounds):
        if not go:
            break
        for i, seen in zip(go, recursion_grams(x, np.array([trials[i] for i in go]), burn[go], period)):
            held[i] = next_trial(trials[i], seen, tasks[i][0], held[i])
            trials[i] = held[i]["trial"]
        go = [i for i in go if not held[i]["converged"]]
    return [scores(h["gram"][0, 0], len(w), order) | {"coef": h["coef"], "converged": h["converged"]}
            if h and h["gram"][0, 0] > 1e-12 * float(w @ w) else None for h, w, (order, _) in zip(held, used, tasks)]


def next_trial(trial: Sequence[float], seen: np.ndarray, order: Sequence[int], held: dict | None) -> dict:
    """One Levenberg-Marquardt round: take or drop `trial`, whose residuals and slopes have the Gram `seen`, and name the next.

    `held` is the last result, None at first. `converged` means that no step
    promises a gain; then `coef` stays.
    """
    free = np.array([order[0], order[2], order[3], order[5]], bool)
    if held is None or seen[0, 0] < held["gram"][0, 0]:
        held = {"coef": np.array(trial, float), "gram": seen, "damping": max(held["damping"] / 10, 1e-12) if held else 1e-3}
    else:
        held = {"coef": np.array(held["coef"], float), "gram": held["gram"], "damping": held["damping"] * 10}
    ssr, coef = held["gram"][0, 0], held["coef"]
    held |= {"trial": coef, "converged": True}
    if not free.any() or not ssr > 0:
        return held
    normal, gradient = held["gram"][1:, 1:], held["gram"][1:, 0]
    go = free & ~((coef >= EDGE) & (gradient < 0) | (coef <= -EDGE) & (gradient > 0))
    if not go.any():
        return held
    own, step = normal[np.ix_(go, go)], np.zeros(4)
    step[go] = np.linalg.solve(own + held["damping"] * np.diag(np.diag(own) + 1e-9), -gradient[go])
    held["trial"] = np.clip(coef + step, -EDGE, EDGE)
    step = held["trial"] - coef
    promised = -(2 * gradient @ step + step @ normal @ step)
    held["converged"] = bool(promised < 1e-11 * ssr and held["damping"] < 1e3 or held["damping"] > 1e12 or not step.any())
    return held


def scores(ssr: float, n: int, order: Sequence[int]) -> dict:
    """AIC, BIC and variance of a fit to n days."""
    k = 1 + order[0] + order[2] + order[3] + order[5]
    fit_term = n * (math.log(2 * math.pi * ssr / n) + 1)
    return {"aic": fit_term + 2 * k, "bic": fit_term + math.log(n) * k, "sigma2": ssr / n}


def _lag_polynomials(order: Sequence[int], coef: Sequence[float], period: int) -> tuple[np.ndarray, np.ndarray]:
    """Full autoregressive (with differencing) and moving-average polynomials in B."""
    _, d, _, _, big_d, _ = order
    phi, theta, big_phi, big_theta = coef

    def at(lag: int, value: float) -> np.ndarray:
        out = np.zeros(lag + 1)
        out[0], out[lag] = 1.0, value
        return out

    ar = np.convolve(at(1, -phi), at(period, -big_phi))
    for _ in range(d):
        ar = np.convolve(ar, at(1, -1.0))
    for _ in range(big_d):
        ar = np.convolve(ar, at(period, -1.0))
    return ar, np.convolve(at(1, theta), at(period, big_theta))


def forecast(values: Sequence[float], shocks: Sequence[float], order: Sequence[int], coef: Sequence[float], sigma2: float,
             period: int, steps: int, z: float = 1.959963984540054) -> list[tuple[float, float, float]]:
    """Mean, lower and upper bound per step; the variance sums squared psi weights.

    `values` and `shocks` end with the last day and reach back as far as the
    order's lags; earlier ones count as zero.
    """
    ar, ma = _lag_polynomials(order, coef, period)
    values, shocks = list(values), list(shocks)
    psi = np.zeros(steps)
    out = []
    for h in range(steps):
        mean = -sum(a * values[-i] for i, a in enumerate(ar) if i and a and i <= len(values))
        mean += sum(b * shocks[-i] for i, b in enumerate(ma) if i and b and i <= len(shocks))
        values.append(mean)
        shocks.append(0.0)
        psi[h] = (ma[h] if h < len(ma) else 0.0) - sum(ar[i] * psi[h - i] for i in range(1, min(h, len(ar) - 1) + 1))
        half = z * math.sqrt(sigma2 * float(psi[: h + 1] @ psi[: h + 1]))
        out.append((float(mean), float(mean - half), float(mean + half)))
    return out
