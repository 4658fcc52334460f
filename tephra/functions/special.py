"""Special functions that numpy lacks: normal and chi distributions by series, continued fraction and bisection."""

from __future__ import annotations

import math

import numpy as np


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def erf(x: np.ndarray) -> np.ndarray:
    """The error function of an array, to about 1e-15: a series inside |x| < 2.5, a continued fraction outside."""
    x = np.asarray(x, float)
    a = np.minimum(np.abs(x), 30.0)
    low, square = np.minimum(a, 2.5), np.minimum(a, 2.5) ** 2
    term = total = low.copy()
    for n in range(1, 60):
        term = term * square * 2 / (2 * n + 1)
        total = total + term
    series = 2 / math.sqrt(math.pi) * np.exp(-square) * total
    high = np.maximum(a, 2.5)
    fraction = high.copy()
    for n in range(60, 0, -1):
        fraction = high + n / 2 / fraction
    tail = np.exp(-(high**2)) / (fraction * math.sqrt(math.pi))
    return np.sign(x) * np.where(a < 2.5, series, 1 - tail)


def gamma_lower(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def chi_ppf(p: float, k: int = 3) -> float:
    """Quantile of the chi distribution (not squared) with k degrees of freedom."""
    if not 0 <= p <= 1:
        raise ValueError(f"{p} is not a probability")
    if p in (0.0, 1.0):
        return 0.0 if p == 0 else math.inf
    low, high = 0.0, 1.0
    while gamma_lower(k / 2, high * high / 2) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_lower(k / 2, mid * mid / 2) < p else (low, mid)
    return (low + high) / 2
