"""Basis functions of neighbourhoods: enumeration, spherical harmonics, pooling over neighbours, products, a linear readout."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tephra.functions.radial import radial_basis


def harmonics(xyz: np.ndarray, l_max: int) -> np.ndarray:
    """Real spherical harmonics of directions, order l*l + l + m, without the Condon-Shortley phase; the zero vector counts as the pole."""
    r = np.linalg.norm(xyz, axis=1)
    unit = np.where(r[:, None] > 0, xyz / np.maximum(r, 1e-300)[:, None], [0.0, 0.0, 1.0])
    x, y, z = unit.T
    out = np.zeros((len(xyz), (l_max + 1) ** 2))
    cos, sin = [np.ones_like(x)], [np.zeros_like(x)]  # r sin(theta) powers times cos and sin of m phi
    for _ in range(l_max):
        cos, sin = [*cos, x * cos[-1] - y * sin[-1]], [*sin, x * sin[-1] + y * cos[-1]]
    for m in range(l_max + 1):
        legendre = [np.full_like(x, float(math.prod(range(1, 2 * m, 2))))]  # without the power of sin(theta), which cos and sin hold
        for deg in range(m + 1, l_max + 1):
            before = (deg + m - 1) * legendre[-2] if deg > m + 1 else 0.0
            legendre.append(((2 * deg - 1) * z * legendre[-1] - before) / (deg - m))
        for deg, p in enumerate(legendre, m):
            norm = math.sqrt((2 * deg + 1) / (4 * math.pi) * math.factorial(deg - m) / math.factorial(deg + m)) * (math.sqrt(2) if m else 1)
            at = deg * deg + deg
            out[:, at + m] = norm * p * cos[m]
            if m:
                out[:, at - m] = norm * p * sin[m]
    return out


def one_particle(n_max: int, l_max: int) -> list[tuple[int, int, int]]:
    """(n, l, m) in order."""
    return [(n, deg, m) for n in range(1, n_max + 1) for deg in range(l_max + 1) for m in range(-deg, deg + 1)]


def admissible(body: Sequence[tuple[int, int]]) -> bool:
    """Whether shells (n, l) couple to an invariant: even parity, and no l above the sum of the others."""
    ls = [b[1] for b in body]
    return sum(ls) % 2 == 0 and (not ls or 2 * max(ls) <= sum(ls))


def enumerate_bodies(order: int, degree: float, n_max: int, l_max: int, weight_l: float = 1.5) -> list[tuple[tuple[int, int], ...]]:
    """Non-decreasing tuples of shells up to an order whose levels n + weight_l l sum to at most a degree, and that are admissible."""
    shells = [(n, deg) for n in range(1, n_max + 1) for deg in range(l_max + 1)]
    level = {s: s[0] + weight_l * s[1] for s in shells}
    return [b for k in range(1, order + 1) for b in combinations_with_replacement(shells, k) if sum(level[s] for s in b) <= degree and admissible(b)]


def smoothness(body: Sequence[tuple[int, int]], p: float = 4.0, wl: float = 1.0, wn: float = 1.0) -> float:
    """sum((l / wl)^p + (n / wn)^p)."""
    return sum((deg / wl) ** p + (n / wn) ** p for n, deg in body)


def pooled(edges: DataFrame, centre: str, cutoff: float, n_max: int, l_max: int) -> DataFrame:
    """(centre, a): sums over neighbours of R_n(r) Y_lm, from edges (centre, dx, dy, dz). Products are made row by row, sums where rows lie first."""
    radial_part = radial_basis(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2), cutoff, n_max)

    @F.pandas_udf("array<double>")
    def angular(dx: pd.Series, dy: pd.Series, dz: pd.Series) -> pd.Series:
        return pd.Series(list(harmonics(np.column_stack([dx, dy, dz]), l_max)))

    rows = edges.select(centre, radial_part.alias("_r"), angular("dx", "dy", "dz").alias("_y"))
    spec = one_particle(n_max, l_max)
    sums = [F.sum(F.col("_r")[n - 1] * F.col("_y")[deg * deg + deg + m]).alias(f"a{i}") for i, (n, deg, m) in enumerate(spec)]
    return rows.groupBy(centre).agg(*sums).select(centre, F.array(*[f"a{i}" for i in range(len(spec))]).alias("a"))


def power_spectrum(a: Column, n_max: int, l_max: int) -> Column:
    """Invariants sum over m of A(n l m) A(n' l m), n <= n', as an array."""
    at = {s: i for i, s in enumerate(one_particle(n_max, l_max))}
    out = []
    for n in range(1, n_max + 1):
        for n2 in range(n, n_max + 1):
            for deg in range(l_max + 1):
                total = F.lit(0.0)
                for m in range(-deg, deg + 1):
                    total = total + a[at[n, deg, m]] * a[at[n2, deg, m]]
                out.append(total / math.sqrt(2 * deg + 1))
    return F.array(*out)


def products(a: Column, specs: Sequence[Sequence[int]]) -> Column:
    """The product basis: for each tuple of places the product of those entries."""
    out = []
    for spec in specs:
        p = F.lit(1.0)
        for i in spec:
            p = p * a[i]
        out.append(p)
    return F.array(*out)


def readout(values: Column, coefficients: Sequence[float]) -> Column:
    """A linear model's value of an array."""
    return F.aggregate(F.zip_with(values, F.array(*[F.lit(float(c)) for c in coefficients]), lambda v, c: v * c), F.lit(0.0), lambda s, v: s + v)


def pair_energy_forces(edges: DataFrame, atoms: DataFrame, energy: Column, slope: Column) -> DataFrame:
    """(cfg, atom, e, fx, fy, fz) of a pair model: half of each directed edge's energy at its centre, and the analytic force from the slope dE/dr."""
    pull = slope / F.col("dist")
    sums = edges.groupBy("cfg", F.col("i").alias("atom")).agg(F.sum(energy / 2).alias("e"), *[F.sum(pull * F.col(f"d{c}")).alias(f"f{c}") for c in "xyz"])
    return atoms.select("cfg", "atom").join(sums, ["cfg", "atom"], "left").na.fill(0.0, ["e", "fx", "fy", "fz"])
