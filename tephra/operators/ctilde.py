"""Energies and forces of tabulated cluster potentials in YAML: radial families, complex harmonics, products with coefficients, embeddings, cores.

A potential is a model, small and read once on the driver; structures are groups whose atoms and edges meet in one task.
Slopes of radial functions are complex steps, exact to rounding.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tephra.functions.families import COULOMB, SCREEN_LENGTH, bessel_matrix, screened_derivatives
from tephra.functions.radial import SCREEN
from tephra.operators.sites import solid
from tephra.sources.extxyz import SYMBOLS
from tephra.sources.files import potential_header, read_potential

FAMILIES = ("ChebExpCos", "ChebPow", "ChebLinear", "SBessel")
DEFAULTS = {"rcut_in": 0.0, "dcut_in": 0.0, "dcut": 0.01, "inner_cutoff_type": "density", "prehc": 0.0, "lambdahc": 0.0}


def step_down(r: np.ndarray, end: float, width: float) -> np.ndarray:
    """1 up to end - width, 0 from end on, a quintic between; a step for width 0. Takes complex arguments."""
    if width == 0:
        return np.where(r.real <= end, 1.0, 0.0) + 0 * r
    u = (end - r) / width
    middle = u**3 * (10 - 15 * u + 6 * u * u)
    return np.where(u.real >= 1, 1.0, np.where(u.real <= 0, 0.0, middle))


def chebyshev(x: np.ndarray, n: int) -> np.ndarray:
    """T0 .. Tn on a new last axis."""
    out = [np.ones_like(x), x]
    while len(out) <= n:
        out.append(2 * x * out[-1] - out[-2])
    return np.stack(out[: n + 1], -1)


def radial_family(name: str, r: np.ndarray, rate: float, rc: float, taper: float, n: int) -> np.ndarray:
    """(..., n) values of a family at (complex) distances inside the cutoff."""
    half = lambda u: (1 + np.cos(math.pi * u)) / 2
    if name == "ChebPow":
        return (1 - chebyshev(1 - 2 * (1 - r / rc) ** rate, n)[..., 1:]) / 2
    if name == "ChebLinear":
        return (1 - chebyshev(1 - r / rc, n)[..., 1:]) / 2
    if name == "SBessel":
        s = np.arange(1, n + 2) * (r * (math.pi / rc))[..., None]
        return np.sin(s) / s @ (bessel_matrix(n) / rc**1.5)
    if name == "ChebExpCos":
        t = chebyshev(1 - 2 * (np.exp(rate * (1 - r / rc)) - 1) / math.expm1(rate), max(n - 1, 1))[..., :n]
        envelope = half(r / rc) * (np.where(r.real > rc - taper, half((r - rc + taper) / taper), 1.0) if taper else 1.0)
        return np.concatenate([t[..., :1], (1 - t[..., 1:]) / 2], -1) * envelope[..., None]
    raise NotImplementedError(f"radial family {name!r}")


@dataclass(frozen=True)
class Bond:
    """One ordered pair of species."""

    family: str
    n: int
    rate: float
    rc: float
    taper: float
    r_in: float
    width_in: float
    inner: str
    strength: float
    decay: float
    coefficients: np.ndarray  # (nradmax, lmax + 1, n)

    def basis(self, r: np.ndarray) -> np.ndarray:
        at = (1.0 if self.width_in == 0 else 0.0) if self.inner == "zbl" else self.r_in
        live = (r.real > at - self.width_in) & (r.real < self.rc)
        safe = np.where(live, r, self.rc / 2)
        g = radial_family(self.family, safe, self.rate, self.rc, self.taper, self.n)
        if self.inner in ("distance", "zbl"):
            g = g * (1 - step_down(safe, at, self.width_in))[..., None]
        return np.where(live[..., None], g, 0.0)

    def core(self, r: np.ndarray, zi: float, zj: float) -> np.ndarray:
        live = (r.real > 0) & (r.real < self.rc)
        safe = np.where(live, r, self.rc / 2)
        if self.inner == "zbl":
            a = SCREEN_LENGTH / (zi**0.23 + zj**0.23)
            e, d1, d2 = screened_derivatives(self.rc, a)
            w = self.taper
            cubic, quartic = (w * d2 - 3 * d1) / w**2, (2 * d1 - w * d2) / w**3
            over = np.where(safe.real > self.rc - w, safe - (self.rc - w), 0.0)
            phi = sum(c * np.exp(-d * safe / a) for c, d in SCREEN) / safe
            shift = w * d1 / 2 - e - w**2 * d2 / 12
            value = self.strength * COULOMB / 2 * zi * zj * (phi + over**3 * (cubic / 3 + quartic / 4 * over) + shift) * step_down(safe, self.rc, w)
        else:
            value = abs(self.strength) * np.exp(-abs(self.decay) * safe * safe) / safe * (1 + np.cos(math.pi * safe / self.rc)) / 2
            if self.inner == "distance":
                value = value * step_down(safe, self.r_in, self.width_in)
        return np.where(live, value, 0.0)


def power_embedding(x: np.ndarray, m: float) -> tuple[np.ndarray, np.ndarray]:
    """(value, slope) of sgn(x) ((1 - g) |x|^m + w^(1-m) g |x|) with g = e^-(w |x|)^3, w = 10^6: a power that is linear near 0."""
    w = 1e6
    a = np.abs(x)
    safe = np.where(a > 0, a, 1.0)
    g, linear = np.exp(-np.minimum((w * safe) ** 3, 700.0)), w ** (1 - m)
    one = -np.expm1(-np.minimum((w * safe) ** 3, 700.0))
    value = one * safe**m + linear * g * safe
    dg = -3 * w**3 * safe**2 * g
    slope = one * m * safe ** (m - 1) - dg * safe**m + linear * (g + dg * safe)
    return np.where(a > 0, np.sign(x) * value, 0.0), np.where(a > 0, slope, linear)


def shifted_embedding(x: np.ndarray, m: float) -> tuple[np.ndarray, np.ndarray]:
    """(value, slope) of sgn(x) ((|x| + c e^-|x|)^m - c^m e^-|x|), c = (1 / m)^(1 / (m - 1)); x for m = 1."""
    if abs(m - 1) < 1e-10:
        return x, np.ones_like(x)
    c = (1 / m) ** (1 / (m - 1))
    a = np.abs(x)
    e = np.exp(-a)
    sign = np.where(x < 0, -1.0, 1.0)
    return sign * ((a + c * e) ** m - c**m * e), m * (a + c * e) ** (m - 1) * (1 - c * e) + c**m * e


EMBEDDINGS = {"FinnisSinclair": power_embedding, "FinnisSinclairShiftedScaled": shifted_embedding}


def complex_harmonics(d: np.ndarray, l_max: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, gradients) of sqrt(4 pi) Y_lm with the Condon-Shortley phase, order l*l + l + m."""
    r = np.linalg.norm(d, axis=1)
    y, dy = solid(d, l_max)
    degree = np.concatenate([np.full(2 * deg + 1, deg) for deg in range(l_max + 1)])
    scale = r[:, None] ** -degree.astype(float)
    dy = dy * scale[:, :, None] - (y * scale * degree / r[:, None] ** 2)[:, :, None] * d[:, None, :]
    y = y * scale
    turn = np.zeros(((l_max + 1) ** 2,) * 2, complex)
    for deg in range(l_max + 1):
        at = deg * deg + deg
        turn[at, at] = 1
        for m in range(1, deg + 1):
            turn[at + m, [at + m, at - m]] = (-1) ** m * np.array([1, 1j]) / math.sqrt(2)
            turn[at - m, [at + m, at - m]] = np.array([1, -1j]) / math.sqrt(2)
    turn *= math.sqrt(4 * math.pi)
    return y @ turn.T, np.einsum("ab,ebk->eak", turn, dy)


@dataclass(frozen=True)
class Potential:
    elements: tuple[str, ...]
    e0: np.ndarray
    bonds: dict[tuple[int, int], Bond]
    embeddings: tuple[tuple[str, tuple[float, ...], float, float], ...]  # (kind, parameters, core cutoff, its width)
    functions: dict[int, list[tuple]]  # species -> (mus, columns, places by combination (combinations, rank), coefficients (combinations, densities))
    l_max: int
    n_base: int

    @property
    def cutoff(self) -> float:
        return max(b.rc for b in self.bonds.values())

    def site_energies(self, z: np.ndarray, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(energies of sites, their derivatives with each edge's vector): z species, i centre, j neighbour."""
        n, many = len(z), (self.l_max + 1) ** 2
        n_rad = max(b.coefficients.shape[0] for b in self.bonds.values())
        r = np.linalg.norm(d, axis=1)
        rows = np.zeros((len(d), self.n_base + n_rad * (self.l_max + 1)))  # g_k, then R_nl
        slopes, core, d_core = np.zeros_like(rows), np.zeros(len(d)), np.zeros(len(d))
        near, inner_width = np.full(len(d), np.inf), np.zeros(len(d))
        h = 1e-30
        for (a, b), bond in self.bonds.items():
            at = np.flatnonzero((z[i] == a) & (z[j] == b) & (r < bond.rc))
            if not len(at):
                continue
            g = bond.basis(r[at] + 1j * h)
            full = np.einsum("nlk,ek->enl", bond.coefficients, g)
            full = np.pad(full, ((0, 0), (0, n_rad - full.shape[1]), (0, self.l_max + 1 - full.shape[2]))).reshape(len(at), -1)
            both = np.concatenate([np.pad(g, ((0, 0), (0, self.n_base - g.shape[1]))), full], 1)
            rows[at], slopes[at] = both.real, both.imag / h
            c = bond.core(r[at] + 1j * h, SYMBOLS.index(self.elements[a]), SYMBOLS.index(self.elements[b]))
            core[at], d_core[at] = c.real, c.imag / h
            near[at], inner_width[at] = r[at] - (bond.r_in - bond.width_in), bond.width_in
        y, dy = complex_harmonics(d, self.l_max) if len(d) else (np.zeros((0, many), complex), np.zeros((0, many, 3), complex))
        a = np.zeros((n, len(self.elements), rows.shape[1], many), complex)
        np.add.at(a, (i, z[j]), rows[:, :, None] * y[:, None, :])
        energy, pull = np.zeros(n), np.zeros_like(a)
        core_sum = np.bincount(i, core, n)
        d_energy_core = np.zeros(n)
        fade = {}
        for s in range(len(self.elements)):
            mine = np.flatnonzero(z == s)
            if not len(mine):
                continue
            kind, parameters, cut, width = self.embeddings[s]
            rho = np.zeros((len(mine), max(len(parameters) // 2, 1)))
            for mus, columns, places, coefficients in self.functions.get(s, []):
                factors = np.stack([a[mine][:, mu, c][:, p] for mu, c, p in zip(mus, columns, places.T, strict=True)], -1)
                rho[:, : coefficients.shape[1]] += factors.prod(-1).real @ coefficients
            value, slope = np.zeros(len(mine)), np.zeros_like(rho)
            for p in range(len(parameters) // 2):
                f, df = EMBEDDINGS[kind](rho[:, p], parameters[2 * p + 1])
                value, slope[:, p] = value + parameters[2 * p] * f, parameters[2 * p] * df
            if self.inner == "zbl":
                off, width_at, closest = self._nearest(mine, i, near, inner_width)
                f = np.where(np.isfinite(off), np.array([step_down(np.array([w - o + 1j * h]), w, w)[0] if np.isfinite(o) else 1.0 for o, w in zip(off, width_at, strict=True)]), 1.0)
                energy[mine] = value * f.real + core_sum[mine] * (1 - f.real)
                d_energy_core[mine] = 1 - f.real
                fade.update({int(e): float((v - c) * -fi.imag / h) for e, v, c, fi in zip(closest, value, core_sum[mine], f, strict=True) if e >= 0})
            else:
                f = step_down(core_sum[mine] + 1j * h, cut, width)
                energy[mine] = value * f.real + core_sum[mine]
                d_energy_core[mine] = 1 + value * f.imag / h
            slope = slope * f.real[:, None]
            energy[mine] += self.e0[s]
            for mus, columns, places, coefficients in self.functions.get(s, []):
                parts = [a[mine][:, mu, c][:, p] for mu, c, p in zip(mus, columns, places.T, strict=True)]
                weight = slope[:, : coefficients.shape[1]] @ coefficients.T
                for t, (mu, c, p) in enumerate(zip(mus, columns, places.T, strict=True)):
                    rest = weight.astype(complex)
                    for u, part in enumerate(parts):
                        if u != t:
                            rest = rest * part
                    np.add.at(pull, (mine[:, None], mu, c, p[None, :]), rest)
        w = pull[i, z[j]]
        along = np.einsum("ecm,ec,em->e", w, slopes, y).real + d_energy_core[i] * d_core
        for e, v in fade.items():
            along[e] += v
        jac = (along / np.where(r > 0, r, 1.0))[:, None] * d + np.einsum("ecm,ec,emk->ek", w, rows, dy).real
        return energy, jac

    @property
    def inner(self) -> str:
        return next(iter(self.bonds.values())).inner

    @staticmethod
    def _nearest(mine: np.ndarray, i: np.ndarray, near: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each site the least switch coordinate, its bond's width and its edge (-1 without one)."""
        order = np.lexsort((np.arange(len(i)), near, i))
        first = order[np.unique(i[order], return_index=True)[1]] if len(order) else order
        edge = np.full(int(max(mine.max(initial=-1), i.max(initial=-1))) + 1, -1)
        edge[i[first]] = first
        found = edge[mine]
        live = (found >= 0) & np.isfinite(near[found] if len(near) else np.zeros(len(found)))
        found = np.where(live, found, -1)
        return np.where(live, near[found] if len(near) else np.inf, np.inf), np.where(live, width[found] if len(width) else 1.0, 1.0), found


def load_potential(spark: SparkSession, path: str) -> Potential:
    """A YAML potential that can be evaluated; a missing bond, unlike families or an unknown kind is an error."""
    head = potential_header(path)
    elements = tuple(head["elements"])
    listed = {tuple(int(x) for x in k): DEFAULTS | dict(v) for k, v in head["bonds"].items()}
    for a in range(len(elements)):
        for b in range(len(elements)):
            if (a, b) not in listed:
                raise ValueError(f"{path}: bond {[a, b]} is missing")
    if len({v["radbasename"] for v in listed.values()}) > 1 or len({v["inner_cutoff_type"] for v in listed.values()}) > 1:
        raise ValueError(f"{path}: bonds differ in family or inner cutoff")
    if (family := next(iter(listed.values()))["radbasename"]) not in FAMILIES:
        raise NotImplementedError(f"{path}: radial family {family!r}")
    l_max, n_base = max(int(v["lmax"]) for v in listed.values()), max(int(v["nradbasemax"]) for v in listed.values())
    bonds = {k: Bond(v["radbasename"], int(v["nradbasemax"]), float(v["radparameters"][0]), float(v["rcut"]), float(v["dcut"]), float(v.get("rcut_in", 0)), float(v.get("dcut_in", 0)), v["inner_cutoff_type"], float(v["prehc"]), float(v["lambdahc"]), np.array(v["radcoefficients"], float)) for k, v in listed.items()}
    embeddings = []
    for s in range(len(elements)):
        e = head["embeddings"][s]
        if e["npoti"] not in EMBEDDINGS:
            raise NotImplementedError(f"{path}: embedding {e['npoti']!r}")
        embeddings.append((e["npoti"], tuple(map(float, e["FS_parameters"])), float(e["rho_core_cutoff"]), float(e["drho_core_cutoff"])))
    functions: dict[int, list[tuple]] = {}
    for f in read_potential(spark, path).orderBy("species", "index").collect():
        many = len(f["ms"]) // f["rank"]
        ms, ls = np.array(f["ms"]).reshape(many, f["rank"]), np.array(f["ls"])
        columns = [n - 1 if f["rank"] == 1 else n_base + (n - 1) * (l_max + 1) + deg for n, deg in zip(f["ns"], ls, strict=True)]
        functions.setdefault(elements.index(f["species"]), []).append((list(f["mus"]), columns, ls * ls + ls + ms, np.array(f["coefficients"]).reshape(many, f["ndensity"])))
    return Potential(elements, np.array(head.get("E0", [0.0] * len(elements)), float), bonds, tuple(embeddings), functions, l_max, n_base)


def evaluate(atoms: DataFrame, edges: DataFrame, potential: Potential) -> DataFrame:
    """(cfg, atom, e, fx, fy, fz, v): site energies, forces and each site's share of the virial (nine numbers).

    ``atoms`` (cfg, atom, species: places in ``potential.elements``), ``edges`` as ``neighbours.periodic_edges`` makes them
    within ``potential.cutoff``. The sum of v over a structure is its virial.
    """

    def run(key: tuple, a: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values("atom")
        number = a["atom"].to_numpy()
        i, j = (np.searchsorted(number, e[c].to_numpy()) for c in ("i", "j"))
        d = e[["dx", "dy", "dz"]].to_numpy(float).reshape(-1, 3)
        energy, jac = potential.site_energies(a["species"].to_numpy(int), i, j, d)
        force, virial = np.zeros((len(number), 3)), np.zeros((len(number), 9))
        np.add.at(force, i, jac)
        np.subtract.at(force, j, jac)
        np.add.at(virial, i, -(jac[:, :, None] * d[:, None, :] + d[:, :, None] * jac[:, None, :]).reshape(-1, 9) / 2)
        return pd.DataFrame({"cfg": key[0], "atom": number, "e": energy, "fx": force[:, 0], "fy": force[:, 1], "fz": force[:, 2], "v": virial.tolist()})

    kind = dict(atoms.dtypes)["cfg"]
    return atoms.select("cfg", "atom", "species").groupBy("cfg").cogroup(edges.select("cfg", "i", "j", "dx", "dy", "dz").groupBy("cfg")).applyInPandas(run, f"cfg {kind}, atom int, e double, fx double, fy double, fz double, v array<double>")
