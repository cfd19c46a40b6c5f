"""Special functions that neither the engine nor the standard library has, over floats."""

from __future__ import annotations

import math

import numpy as np


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0 or a <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    return 1 - gamma_q(a, x)


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by Lentz's continued fraction where that converges."""
    if x <= 0 or a <= 0:
        return 1.0
    if x < a + 1:
        return 1 - gamma_p(a, x)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    f = 1.0
    for i in range(10_000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + num * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + num / c
        c = c if abs(c) > tiny else tiny
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * (f - 1)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of n trials."""
    if k <= 0:
        return 1.0
    return 0.0 if k > n else beta_i(k, n - k + 1, p)


def t_cdf(t: float, df: float) -> float:
    """Distribution function of Student's t."""
    tail = 0.5 * beta_i(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def chi2_quantile(p: float, df: float) -> float:
    """Quantile of the chi-squared distribution, by bisection."""
    lo, hi = 0.0, df + 10
    while gamma_p(df / 2, hi / 2) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_p(df / 2, mid / 2) < p else (lo, mid)
    return (lo + hi) / 2


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) if 0 <= k <= n else -math.inf


def hypergeometric_tail(k: int, marked: int, drawn: int, total: int) -> float:
    """The smaller one-sided tail of drawing k marked of ``drawn`` from ``total`` with ``marked`` marked, k included."""
    lo, hi = max(0, drawn + marked - total), min(marked, drawn)
    p = lambda i: math.exp(log_choose(marked, i) + log_choose(total - marked, drawn - i) - log_choose(total, drawn))
    return min(1.0, sum(map(p, range(lo, k + 1))), sum(map(p, range(k, hi + 1))))


_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def upper_tails(k, marked, drawn, total) -> np.ndarray:
    """P(X >= k) for arrays of hypergeometric draws; nan for counts that no draw can have.

    Terms are summed from k on outward, upward above the mean and downward below it, until they add nothing, so memory
    does not depend on the numbers. Logarithms of factorials are good to about 1e-16 of their size: with a billion
    items a tail has five digits.
    """
    k, m, d, t = np.broadcast_arrays(*[np.asarray(x, float) for x in (k, marked, drawn, total)])
    out = np.full(k.shape, np.nan)
    low, high = np.maximum(0, d + m - t), np.minimum(m, d)
    fits = (m >= 0) & (d >= 0) & (m <= t) & (d <= t) & (k >= low) & (k <= high)
    k, m, d, t, low, high = (x[fits] for x in (k, m, d, t, low, high))
    up = k * t > m * d
    at = np.where(up, k, k - 1)
    lf = lambda x: _log_gamma(x + 1) if len(x) else x
    inside = (at >= low) & (at <= high)
    x = np.where(inside, at, low)
    logs = lf(m) - lf(x) - lf(m - x) + lf(t - m) - lf(d - x) - lf(t - m - d + x) - (lf(t) - lf(d) - lf(t - d))
    term = np.where(inside, np.exp(logs), 0.0)
    tail = term.copy()
    open_ = np.flatnonzero(term > 0)
    while len(open_):
        x, mm, dd, tt, goes_up = at[open_], m[open_], d[open_], t[open_], up[open_]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(goes_up, (mm - x) * (dd - x) / ((x + 1) * (tt - mm - dd + x + 1)), x * (tt - mm - dd + x) / ((mm - x + 1) * (dd - x + 1)))
        at[open_] += np.where(goes_up, 1, -1)
        term[open_] *= ratio
        tail[open_] += term[open_]
        open_ = open_[term[open_] > 1e-17 * tail[open_]]
    out[fits] = np.clip(np.where(up, tail, 1 - tail), 0.0, 1.0)
    return out


def hypergeometric_tails(k, marked, drawn, total) -> np.ndarray:
    """hypergeometric_tail for arrays: the smaller of both tails, k included; nan for counts that no draw can have."""
    k, m, d, t = np.broadcast_arrays(*[np.asarray(x, float) for x in (k, marked, drawn, total)])
    return np.minimum(upper_tails(k, m, d, t), upper_tails(d - k, t - m, d, t))
