"""Solid harmonics as polynomials of columns, and coupling coefficients of real harmonics."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def solid_harmonics(x: Column, y: Column, z: Column, l_max: int) -> list[Column]:
    """r^l Y_lm in the order l*l + l + m, without the Condon-Shortley phase: polynomials, exact at the origin too."""
    r2 = x * x + y * y + z * z
    cos, sin = [F.lit(1.0)], [F.lit(0.0)]
    for _ in range(l_max):
        cos, sin = [*cos, x * cos[-1] - y * sin[-1]], [*sin, x * sin[-1] + y * cos[-1]]
    out: list[Column] = [F.lit(0.0)] * (l_max + 1) ** 2
    for m in range(l_max + 1):
        column = {m - 1: F.lit(0.0), m: F.lit(float(math.prod(range(1, 2 * m, 2))))}
        for deg in range(m + 1, l_max + 1):
            column[deg] = ((2 * deg - 1) * z * column[deg - 1] - (deg + m - 1) * r2 * column[deg - 2]) / (deg - m)
        for deg in range(m, l_max + 1):
            norm = math.sqrt((2 * deg + 1) / (4 * math.pi) * math.factorial(deg - m) / math.factorial(deg + m) * (2 if m else 1))
            out[deg * deg + deg + m] = norm * column[deg] * cos[m]
            if m:
                out[deg * deg + deg - m] = norm * column[deg] * sin[m]
    return out


def coupling(j1: int, m1: int, j2: int, m2: int, j: int) -> float:
    """<j1 m1 j2 m2 | j m1 + m2> by sums of products of binomials."""
    c = lambda n, k: math.comb(n, k) if 0 <= k <= n else 0
    if not abs(j1 - j2) <= j <= j1 + j2 or abs(m1 + m2) > j:
        return 0.0
    rest = j1 + j2 - j
    total = sum((-1) ** k * c(rest, k) * c(2 * j1 - rest, j1 - m1 - k) * c(2 * j2 - rest, j2 + m2 - k) for k in range(rest + 1))
    weight = c(2 * j1, rest) * c(2 * j2, rest) / (c(j1 + j2 + j + 1, rest) * c(2 * j1, j1 - m1) * c(2 * j2, j2 - m2) * c(2 * j, j - m1 - m2))
    return math.sqrt(weight) * total


def real_basis(deg: int) -> np.ndarray:
    """The unitary matrix that turns complex harmonics (with the Condon-Shortley phase) into the real ones used here."""
    out = np.zeros((2 * deg + 1, 2 * deg + 1), complex)
    for m in range(-deg, deg + 1):
        sign = (-1.0) ** m
        if m == 0:
            out[deg, deg] = 1
        elif m > 0:
            out[deg + m, [deg + m, deg - m]] = np.array([sign, 1.0]) / math.sqrt(2)
        else:
            out[deg + m, [deg - m, deg + m]] = np.array([sign, -1.0]) / (1j * math.sqrt(2))
    return out


@cache
def real_coupling(l1: int, l2: int, deg: int) -> np.ndarray:
    """T[m1, m2, M]: sum T f_m1 g_m2 turns as Y_deg when f and g turn as Y_l1 and Y_l2; sums of T T over (m1, m2) are the identity."""
    if not abs(l1 - l2) <= deg <= l1 + l2:
        raise ValueError(f"{deg} is not in {abs(l1 - l2)}..{l1 + l2}")
    plain = np.zeros((2 * l1 + 1, 2 * l2 + 1, 2 * deg + 1))
    for a in range(-l1, l1 + 1):
        for b in range(-l2, l2 + 1):
            if abs(a + b) <= deg:
                plain[a + l1, b + l2, a + b + deg] = coupling(l1, a, l2, b, deg)
    turned = np.einsum("abc,ia,jb,kc->ijk", plain, real_basis(l1).conj(), real_basis(l2).conj(), real_basis(deg))
    real = np.abs(turned.real).max() > np.abs(turned.imag).max()
    out = np.ascontiguousarray(turned.real if real else turned.imag)
    out.setflags(write=False)
    return out


def block_parts(block: np.ndarray, l1: int, l2: int) -> dict[int, np.ndarray]:
    """A block between shells l1 and l2 as its parts of each total degree."""
    return {deg: np.tensordot(block, real_coupling(l1, l2, deg), axes=([-2, -1], [0, 1])) for deg in range(abs(l1 - l2), l1 + l2 + 1)}


def block_of(parts: dict[int, np.ndarray], l1: int, l2: int) -> np.ndarray:
    """The block of such parts; missing ones are 0."""
    return sum(np.tensordot(p, real_coupling(l1, l2, deg), axes=([-1], [2])) for deg, p in parts.items())
