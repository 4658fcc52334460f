"""Radial functions of distances as column expressions; all stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def agnesi(r: Column, r_in: float, r0: float, r_cut: float, p: int = 2, q: int = 4, a: float = 1.0) -> Column:
    """Distance transform y = 1 / (1 + a s^q / (1 + s^(q-p))), s = (r - r_in) / (r0 - r_in), scaled so that r_in is -1 and r_cut is 1."""
    def y(x: Column) -> Column:
        s = (x - r_in) / (r0 - r_in)
        return F.when(x <= r_in, F.lit(1.0)).otherwise(1 / (1 + a * F.pow(s, q) / (1 + F.pow(s, q - p))))

    y_in, y_cut = y(F.lit(float(r_in))), y(F.lit(float(r_cut)))
    return clip(-1 + 2 * (y(r) - y_in) / (y_cut - y_in), -1, 1)


def cutoff(r: Column, r_cut: float) -> Column:
    """(1 - clip(r / r_cut, 0, 1)^2)^2."""
    return F.pow(1 - F.pow(clip(r / r_cut, 0, 1), 2), 2)


def poly_envelope(x: Column, p: int = 2) -> Column:
    """(1 - x^2)^p inside [-1, 1], else 0."""
    return F.when(F.abs(x) <= 1, F.pow(1 - x * x, p)).otherwise(F.lit(0.0))


def inverse_envelope(r: Column, r_cut: float, r0: float, p: int = 2) -> Column:
    """(r / r0)^-p with value and slope taken off at the cutoff; 0 beyond."""
    s, c = r / r0, r_cut / r0
    return F.when(r < r_cut, F.pow(s, -p) - c**-p + p * c ** (-p - 1) * (s - c)).otherwise(F.lit(0.0))


def recurrence(y: Column, a: Sequence[float], b: Sequence[float], c: Sequence[float]) -> Column:
    """Array of P0 = a0, P1 = a1 y + b1, Pk = (ak y + bk) P(k-1) + ck P(k-2)."""
    out = [F.lit(float(a[0]))]
    for k in range(1, len(a)):
        step = (a[k] * y + b[k]) * (out[-1] if k > 1 else F.lit(1.0))
        out.append(step + c[k] * out[-2] if k > 1 else step)
    return F.array(*out)


def chebyshev(x: Column, n: int) -> list[Column]:
    """T0 .. T(n-1)."""
    out = [F.lit(1.0), x]
    while len(out) < n:
        out.append(2 * x * out[-1] - out[-2])
    return out[:n]


def radial_basis(r: Column, r_cut: float, n: int) -> Column:
    """Chebyshev polynomials of 1 - 2 r / r_cut times the cutoff."""
    return F.array(*[t * cutoff(r, r_cut) for t in chebyshev(1 - 2 * r / r_cut, n)])


def spline(x: Column, coefficients: Sequence[float], x0: float, h: float) -> Column:
    """Uniform cubic B-spline: place k = (x - x0) / h + 1, index clipped inside, four weights."""
    n = len(coefficients) - 2
    table = F.array(*[F.lit(float(v)) for v in coefficients])
    k = (x - x0) / h + 1
    ix = F.least(F.greatest(F.floor(k), F.lit(1)), F.lit(n - 1)).cast("int")
    t = k - ix
    weights = (F.pow(1 - t, 3) / 6, (3 * F.pow(t, 3) - 6 * t * t + 4) / 6, (-3 * F.pow(t, 3) + 3 * t * t + 3 * t + 1) / 6, F.pow(t, 3) / 6)
    out = F.lit(0.0)
    for j, w in enumerate(weights):
        out = out + w * F.element_at(table, ix + j)  # element_at counts from 1: ix - 1 + j from 0
    return out


def spline_coefficients(values: Sequence[float], h: float, left: float = 0.0, right: float = 0.0) -> list[float]:
    """Coefficients of the interpolating cubic B-spline with given second derivatives at the ends."""
    import numpy as np

    n = len(values)
    a, b = np.zeros((n + 2, n + 2)), np.zeros(n + 2)
    for i, v in enumerate(values):
        a[i + 1, i : i + 3], b[i + 1] = (1 / 6, 4 / 6, 1 / 6), v
    a[0, :3], b[0] = (1, -2, 1), left * h * h
    a[-1, -3:], b[-1] = (1, -2, 1), right * h * h
    return np.linalg.solve(a, b).tolist()


#: Fixed values of the universal screening function: weights and exponents.
SCREEN = ((0.18175, 3.19980), (0.50986, 0.94229), (0.28022, 0.40290), (0.02817, 0.20162))
COULOMB = 14.399645478425668  # eV Angstrom


def screened_pair(r: Column, zi: Column, zj: Column) -> Column:
    """Screened nuclear repulsion: K zi zj / r phi(r / a), a = 0.46850 / (zi^0.23 + zj^0.23)."""
    x = r * (F.pow(zi, 0.23) + F.pow(zj, 0.23)) / 0.46850
    phi = F.lit(0.0)
    for weight, rate in SCREEN:
        phi = phi + weight * F.exp(-rate * x)
    return COULOMB * zi * zj / r * phi


def smooth_step(r: Column, r_in: float, width: float) -> Column:
    """1 up to r_in - width, 0 from r_in on, a quintic between."""
    x = clip((r_in - r) / width, 0, 1)
    return F.pow(x, 3) * (10 - 15 * x + 6 * x * x)


def embedding(x: Column, m: float) -> Column:
    """sign(x) |x|^m."""
    return F.signum(x) * F.pow(F.abs(x), m)


def signed_root(u: Column, power: float) -> Column:
    """A warp that keeps signs: sign(u) |u|^(1 / power)."""
    return F.signum(u) * F.pow(F.abs(u), 1 / power)


def pair_id(zi: Column, zj: Column) -> Column:
    """An id of an unordered pair of small non-negative integers."""
    low, high = F.least(zi, zj), F.greatest(zi, zj)
    return (high * (high + 1) / 2 + low).cast("long")
