"""Tails and quantiles of the usual distributions, in plain Python, for a handful of aggregated rows."""

from __future__ import annotations

import math
from statistics import NormalDist

_EPS = 1e-15


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < _EPS:
            break
    return front * total


def gamma_sf(x: float, a: float) -> float:
    """The regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * _EPS:
            k += 1
            term *= x / k
            total += term
        return 1.0 - front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    total = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        c = c if abs(c) > 1e-300 else 1e-300
        total *= d * c
        if abs(d * c - 1) < _EPS:
            break
    return front * total


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(x / 2, df / 2)


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else beta_cdf(d2 / (d2 + d1 * x), d2 / 2, d1 / 2)


def f_quantile(p: float, d1: float, d2: float) -> float:
    """x with P(F <= x) = p, by bisection on d1*x / (d1*x + d2)."""
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if beta_cdf(mid, d1 / 2, d2 / 2) < p:
            lo = mid
        else:
            hi = mid
    y = (lo + hi) / 2
    return math.inf if y >= 1 else d2 * y / (d1 * (1 - y))


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def t_sf(t: float, df: float) -> float:
    half = t_two_sided(t, df) / 2
    return half if t >= 0 else 1 - half


def binomial_pmf(k: int, n: int, p: float) -> float:
    if p in (0.0, 1.0):
        return float(k == (n if p else 0))
    return math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))


def binomial_test(k: int, n: int, p: float = 0.5, alternative: str = "two-sided") -> float:
    """Exact p-value; two-sided adds up all outcomes no likelier than the observed one. Tails come from the incomplete beta function."""
    if not 0 <= k <= n or n <= 0:
        raise ValueError("need 0 <= k <= n and n > 0")

    def least(i: int) -> float:
        return 1.0 if i <= 0 else 0.0 if i > n else beta_cdf(p, i, n - i + 1)

    def most(i: int) -> float:
        return 0.0 if i < 0 else 1.0 if i >= n else beta_cdf(1 - p, n - i, i + 1)

    if alternative == "greater":
        return least(k)
    if alternative == "less":
        return most(k)
    edge, mode = binomial_pmf(k, n, p) * (1 + 1e-7), min(n, int((n + 1) * p))
    if k == mode:
        return 1.0
    # outcomes grow likelier up to the mode and less likely after it: the other tail's first outcome is found by halving
    below, lo, hi = (k, mode, n + 1) if k < mode else (k, -1, mode)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rare = binomial_pmf(mid, n, p) <= edge
        if k < mode:
            lo, hi = (lo, mid) if rare else (mid, hi)
        else:
            lo, hi = (mid, hi) if rare else (lo, mid)
    return min(1.0, most(below) + least(hi) if k < mode else least(below) + most(lo))


def _range_cdf(w: float, k: int) -> float:
    """P(range of k standard normals <= w), by Simpson's rule over the least of them."""
    lo, hi, n = -8.0, 8.0, 400
    step = (hi - lo) / n
    total = 0.0
    for i in range(n + 1):
        z = lo + i * step
        inside = normal_sf(z) - normal_sf(z + w)
        y = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) * max(inside, 0.0) ** (k - 1)
        total += y * (1 if i in (0, n) else 4 if i % 2 else 2)
    return min(1.0, k * total * step / 3)


def studentized_range_sf(q: float, k: int, df: float) -> float:
    """P(Q > q) for k groups and df degrees: the range's distribution averaged over the scale's."""
    if q <= 0:
        return 1.0
    if df > 20_000:
        return 1 - _range_cdf(q, k)
    spread = 1 / math.sqrt(2 * df)
    lo, hi, n = max(1e-6, 1 - 8 * spread), 1 + 8 * spread, 80
    step = (hi - lo) / n
    log_c = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2)
    total = 0.0
    for i in range(n + 1):
        s = lo + i * step
        y = math.exp(log_c + (df - 1) * math.log(s) - df * s * s / 2) * _range_cdf(q * s, k)
        total += y * (1 if i in (0, n) else 4 if i % 2 else 2)
    return max(0.0, 1 - total * step / 3)
