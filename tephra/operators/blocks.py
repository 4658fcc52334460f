"""Blocks of operators between orbital shells: regression on equivariant features, prediction, and projection onto valence shells.

A block between shells of degree l1 and l2 splits into parts of degree L = |l1 - l2| .. l1 + l2. A part is a sum of
coefficients times features that turn as Y_L, so its 2 L + 1 components share their coefficients.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tephra.functions.angular import block_of, block_parts, real_coupling
from tephra.operators.sites import SiteBasis, solid


def equivariant_features(basis: SiteBasis, centre: np.ndarray, neighbour: np.ndarray, d: np.ndarray, n: int, deg: int) -> np.ndarray:
    """(sites, features, 2 deg + 1): sums over neighbours of g_n Y_deg by species, and products of two such sums coupled to the degree, of even parity with it."""
    k, a = basis.species * basis.n_max, pooled_sites(basis, centre, neighbour, d, n)
    part = lambda q: a[:, :, q * q : (q + 1) ** 2]
    out = [part(deg)] if deg <= basis.l_max else []
    for l1 in range(basis.l_max + 1):
        for l2 in range(l1, basis.l_max + 1):
            if abs(l1 - l2) <= deg <= l1 + l2 and (l1 + l2 + deg) % 2 == 0:
                pairs = np.einsum("npi,nqj,ijM->npqM", part(l1), part(l2), real_coupling(l1, l2, deg))
                at = np.triu_indices(k) if l1 == l2 else tuple(x.ravel() for x in np.indices((k, k)))
                out.append(pairs[:, at[0], at[1]])
    found = np.concatenate(out, 1) if out else np.zeros((n, 0, 2 * deg + 1))
    return np.concatenate([found, np.ones((n, 1, 1))], 1) if deg == 0 else found


@dataclass(frozen=True)
class BlockModel:
    """Coefficients by (species, first shell, second shell, degree)."""

    basis: SiteBasis
    shells: Mapping[int, tuple[int, ...]]
    coefficients: dict[tuple[int, int, int, int], np.ndarray]

    def blocks(self, species: int, features: Mapping[int, np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
        """(sites, 2 l1 + 1, 2 l2 + 1) of each pair of shells, from the features of sites of one species."""
        out = {}
        for s1, s2, l1, l2 in shell_pairs(self.shells[species]):
            parts = {deg: np.einsum("k,nkM->nM", self.coefficients[species, s1, s2, deg], features[deg]) for deg in degrees(l1, l2, s1 == s2) if len(self.coefficients[species, s1, s2, deg])}
            n = len(next(iter(features.values())))
            out[s1, s2] = block_of(parts, l1, l2) if parts else np.zeros((n, 2 * l1 + 1, 2 * l2 + 1))
        return out


def shell_pairs(shells: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """(first shell, second, their degrees), first not after second."""
    return [(a, b, shells[a], shells[b]) for a in range(len(shells)) for b in range(a, len(shells))]


def degrees(l1: int, l2: int, same: bool) -> list[int]:
    """Degrees of a block's parts whose parity is that of the shells; those of a symmetric block are even."""
    return [deg for deg in range(abs(l1 - l2), l1 + l2 + 1) if (l1 + l2 + deg) % 2 == 0 and not (same and deg % 2)]


def fit_onsite(atoms: DataFrame, edges: DataFrame, blocks: DataFrame, basis: SiteBasis, shells: Mapping[int, Sequence[int]], ridge: float = 1e-10) -> tuple[BlockModel, dict[tuple[int, int, int, int], tuple[int, int, float]]]:
    """(model, report): least squares of on-site blocks; report: rows, columns and residual of every part.

    ``atoms`` (cfg, atom, species), ``edges`` within the basis' cutoff, ``blocks`` (cfg, atom, s1, s2, v: a block row by
    row, first shell not after second). Normal equations are summed in tasks, one structure at a time; only matrices of
    the number of features squared reach the driver.
    """
    shells = {int(z): tuple(int(x) for x in s) for z, s in shells.items()}
    keys = [(z, s1, s2, deg) for z, s in shells.items() for s1, s2, l1, l2 in shell_pairs(s) for deg in degrees(l1, l2, s1 == s2)]

    def sums(key: tuple, a: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        a = a.drop_duplicates(["atom", "s1", "s2"])
        sites = a.drop_duplicates("atom").sort_values("atom")
        number = sites["atom"].to_numpy()
        species_of = sites["species"].to_numpy(int)
        i, j = (np.searchsorted(number, e[c].to_numpy()) for c in ("i", "j"))
        d = e[["dx", "dy", "dz"]].to_numpy(float).reshape(-1, 3)
        cache: dict[int, np.ndarray] = {}
        out = []
        for z, s1, s2, deg in keys:
            mine = a[(a["species"] == z) & (a["s1"] == s1) & (a["s2"] == s2) & a["v"].notna()]
            if not len(mine):
                continue
            if deg not in cache:
                cache[deg] = equivariant_features(basis, i, species_of[j] if len(j) else j, d, len(number), deg)
            l1, l2 = shells[z][s1], shells[z][s2]
            block = np.stack(mine["v"].to_numpy()).astype(float).reshape(-1, 2 * l1 + 1, 2 * l2 + 1)
            if s1 == s2:
                block = (block + block.transpose(0, 2, 1)) / 2
            target = block_parts(block, l1, l2)[deg].ravel()
            x = cache[deg][np.searchsorted(number, mine["atom"].to_numpy())].transpose(0, 2, 1).reshape(len(target), -1)
            gram = np.column_stack([x, target])
            out.append((z, s1, s2, deg, len(target), (gram.T @ gram).ravel().tolist()))
        return pd.DataFrame(out, columns=["z", "s1", "s2", "deg", "n", "g"])

    joined = atoms.select("cfg", "atom", "species").join(blocks.select("cfg", "atom", "s1", "s2", "v"), ["cfg", "atom"], "left")
    found = joined.groupBy("cfg").cogroup(edges.select("cfg", "i", "j", "dx", "dy", "dz").groupBy("cfg")).applyInPandas(sums, "z int, s1 int, s2 int, deg int, n long, g array<double>")
    coefficients, report = _solved(found, ["z", "s1", "s2", "deg"], keys, ridge)
    return BlockModel(basis, shells, coefficients), report


def _solved(found: DataFrame, by: Sequence[str], keys: Sequence[tuple], ridge: float) -> tuple[dict, dict]:
    """(coefficients, (rows, columns, residual)) by key, from bordered Gram matrices g with their rows n."""
    from pyspark.sql import functions as F

    places = found.select(*by, "n", F.posexplode("g").alias("k", "v"))
    summed = places.groupBy(*by, "k").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    rows = summed.groupBy(*by).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("k", "v"))).alias("g")).collect()
    coefficients, report = {k: np.zeros(0) for k in keys}, {k: (0, 0, 0.0) for k in keys}
    for r in rows:
        g = np.array([x["v"] for x in r["g"]])
        size = int(round(len(g) ** 0.5))
        g = g.reshape(size, size)
        c = np.linalg.solve(g[:-1, :-1] + ridge * np.eye(size - 1), g[:-1, -1]) if size > 1 else np.zeros(0)
        rest = max(float(g[-1, -1] - 2 * c @ g[:-1, -1] + c @ g[:-1, :-1] @ c), 0.0)
        key = tuple(r[b] for b in by)
        coefficients[key], report[key] = c, (r["n"], size - 1, (rest / max(r["n"], 1)) ** 0.5)
    return coefficients, report


def predict_onsite(atoms: DataFrame, edges: DataFrame, model: BlockModel) -> DataFrame:
    """(cfg, atom, s1, s2, v): predicted blocks, first shell not after second; the others are their transposes."""
    top = max((l1 + l2 for s in model.shells.values() for _, _, l1, l2 in shell_pairs(s)), default=0)

    def run(key: tuple, a: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values("atom")
        number, species_of = a["atom"].to_numpy(), a["species"].to_numpy(int)
        i, j = (np.searchsorted(number, e[c].to_numpy()) for c in ("i", "j"))
        d = e[["dx", "dy", "dz"]].to_numpy(float).reshape(-1, 3)
        features = {deg: equivariant_features(model.basis, i, species_of[j] if len(j) else j, d, len(number), deg) for deg in range(top + 1)}
        out = []
        for z in sorted(set(species_of.tolist())):
            mine = np.flatnonzero(species_of == z)
            for (s1, s2), block in model.blocks(z, {deg: f[mine] for deg, f in features.items()}).items():
                out += [(key[0], int(number[k]), s1, s2, b.ravel().tolist()) for k, b in zip(mine, block, strict=True)]
        return pd.DataFrame(out, columns=["cfg", "atom", "s1", "s2", "v"])

    kind = dict(atoms.dtypes)["cfg"]
    return atoms.select("cfg", "atom", "species").groupBy("cfg").cogroup(edges.select("cfg", "i", "j", "dx", "dy", "dz").groupBy("cfg")).applyInPandas(run, f"cfg {kind}, atom int, s1 int, s2 int, v array<double>")


def pooled_sites(basis: SiteBasis, centre: np.ndarray, neighbour: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """(sites, channels, harmonics): sums over neighbours of g_n Y_lm by species."""
    a = np.zeros((n, basis.species * basis.n_max, (basis.l_max + 1) ** 2))
    if len(d):
        r = np.linalg.norm(d, axis=1)
        g, _ = basis.radial(r)
        y, _ = solid(d / r[:, None], basis.l_max)
        np.add.at(a, (centre[:, None], (neighbour * basis.n_max)[:, None] + np.arange(basis.n_max)), g[:, :, None] * y[:, None, :])
    return a


def bond_features(basis: SiteBasis, d: np.ndarray, first: np.ndarray, second: np.ndarray, deg: int) -> np.ndarray:
    """(bonds, features, 2 deg + 1): radial functions times harmonics of the bond, and these coupled with the pooled sites at its ends."""
    r = np.linalg.norm(d, axis=1)
    g, _ = basis.radial(r)
    y, _ = solid(d / r[:, None], basis.l_max)
    ends = np.concatenate([first, second], 1)
    part = lambda q: slice(q * q, (q + 1) ** 2)
    out = [g[:, :, None] * y[:, None, part(deg)]] if deg <= basis.l_max else []
    for l1 in range(basis.l_max + 1):
        for l2 in range(basis.l_max + 1):
            if abs(l1 - l2) <= deg <= l1 + l2 and (l1 + l2 + deg) % 2 == 0:
                pairs = np.einsum("bp,bi,bqj,ijM->bpqM", g, y[:, part(l1)], ends[:, :, part(l2)], real_coupling(l1, l2, deg))
                out.append(pairs.reshape(len(d), -1, 2 * deg + 1))
    return np.concatenate(out, 1) if out else np.zeros((len(d), 0, 2 * deg + 1))


@dataclass(frozen=True)
class BondModel:
    """Coefficients by (first species, second species, first shell, second shell, degree)."""

    basis: SiteBasis
    shells: Mapping[int, tuple[int, ...]]
    coefficients: dict[tuple[int, int, int, int, int], np.ndarray]


def _bond_keys(shells: Mapping[int, tuple[int, ...]]) -> list[tuple[int, int, int, int, int]]:
    return [(za, zb, s1, s2, deg) for za, sa in shells.items() for zb, sb in shells.items() for s1, l1 in enumerate(sa) for s2, l2 in enumerate(sb) for deg in degrees(l1, l2, False)]


def _structure(a: pd.DataFrame, e: pd.DataFrame, basis: SiteBasis) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(atom numbers, species, i, j, vectors, pooled sites) of one structure."""
    a = a.drop_duplicates("atom").sort_values("atom")
    number, species = a["atom"].to_numpy(), a["species"].to_numpy(int)
    i, j = (np.searchsorted(number, e[c].to_numpy()) for c in ("i", "j"))
    d = e[["dx", "dy", "dz"]].to_numpy(float).reshape(-1, 3)
    return number, species, i, j, d, pooled_sites(basis, i, species[j] if len(j) else j, d, len(number))


def fit_offsite(atoms: DataFrame, bonds: DataFrame, basis: SiteBasis, shells: Mapping[int, Sequence[int]], ridge: float = 1e-10) -> tuple[BondModel, dict]:
    """(model, report): least squares of the blocks of bonds.

    ``atoms`` (cfg, atom, species), ``bonds`` (cfg, i, j, dx, dy, dz, blocks array<struct<s1, s2, v>>): edges within the
    basis' cutoff; those of null blocks only take part as neighbours. Sums are made one structure at a time.
    """
    shells = {int(z): tuple(int(x) for x in s) for z, s in shells.items()}
    keys = _bond_keys(shells)

    def sums(key: tuple, a: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        _, species, i, j, d, pooled = _structure(a, e, basis)
        targets: dict[tuple[int, int, int, int], list[tuple[int, np.ndarray]]] = {}
        for k, listed in enumerate(e["blocks"] if len(e) else []):
            for block in [] if listed is None else listed:
                targets.setdefault((int(species[i[k]]), int(species[j[k]]), block["s1"], block["s2"]), []).append((k, np.array(block["v"], float)))
        out, cache = [], {}
        for za, zb, s1, s2, deg in keys:
            mine = targets.get((za, zb, s1, s2), [])
            if not mine:
                continue
            at = np.array([k for k, _ in mine])
            if (za, zb, s1, s2, deg) not in cache:
                cache[za, zb, s1, s2, deg] = bond_features(basis, d[at], pooled[i[at]], pooled[j[at]], deg)
            l1, l2 = shells[za][s1], shells[zb][s2]
            target = block_parts(np.stack([v for _, v in mine]).reshape(-1, 2 * l1 + 1, 2 * l2 + 1), l1, l2)[deg].ravel()
            x = np.column_stack([cache[za, zb, s1, s2, deg].transpose(0, 2, 1).reshape(len(target), -1), target])
            out.append((za, zb, s1, s2, deg, len(target), (x.T @ x).ravel().tolist()))
        return pd.DataFrame(out, columns=["za", "zb", "s1", "s2", "deg", "n", "g"])

    grouped = atoms.select("cfg", "atom", "species").groupBy("cfg").cogroup(bonds.select("cfg", "i", "j", "dx", "dy", "dz", "blocks").groupBy("cfg"))
    found = grouped.applyInPandas(sums, "za int, zb int, s1 int, s2 int, deg int, n long, g array<double>")
    coefficients, report = _solved(found, ["za", "zb", "s1", "s2", "deg"], keys, ridge)
    return BondModel(basis, shells, coefficients), report


def predict_offsite(atoms: DataFrame, bonds: DataFrame, model: BondModel) -> DataFrame:
    """(cfg, i, j, dx, dy, dz, s1, s2, v): predicted blocks of every bond."""

    def run(key: tuple, a: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        number, species, i, j, d, pooled = _structure(a, e, model.basis)
        out = []
        for za in sorted(set(species[i].tolist()) if len(i) else ()):
            for zb in sorted(set(species[j].tolist())):
                at = np.flatnonzero((species[i] == za) & (species[j] == zb))
                features: dict[int, np.ndarray] = {}
                for s1, l1 in enumerate(model.shells[za] if len(at) else ()):
                    for s2, l2 in enumerate(model.shells[zb]):
                        parts = {}
                        for deg in degrees(l1, l2, False):
                            c = model.coefficients[za, zb, s1, s2, deg]
                            if len(c):
                                features.setdefault(deg, bond_features(model.basis, d[at], pooled[i[at]], pooled[j[at]], deg))
                                parts[deg] = np.einsum("k,bkM->bM", c, features[deg])
                        block = block_of(parts, l1, l2) if parts else np.zeros((len(at), 2 * l1 + 1, 2 * l2 + 1))
                        out += [(key[0], int(number[i[k]]), int(number[j[k]]), *map(float, d[k]), s1, s2, b.ravel().tolist()) for k, b in zip(at, block, strict=True)]
        return pd.DataFrame(out, columns=["cfg", "i", "j", "dx", "dy", "dz", "s1", "s2", "v"])

    kind = dict(atoms.dtypes)["cfg"]
    grouped = atoms.select("cfg", "atom", "species").groupBy("cfg").cogroup(bonds.select("cfg", "i", "j", "dx", "dy", "dz").groupBy("cfg"))
    return grouped.applyInPandas(run, f"cfg {kind}, i int, j int, dx double, dy double, dz double, s1 int, s2 int, v array<double>")


def project_core(h: np.ndarray, s: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(H, S, coupling): matrices of the orbitals off the core, made orthogonal to the core's; coupling: the largest core-valence element that is dropped."""
    core = np.asarray(core, int)
    if not len(core):
        raise ValueError("no core orbital is given")
    rest = np.setdiff1d(np.arange(len(h)), core)
    take = lambda m, a, b: m[np.ix_(a, b)]
    x = np.linalg.solve(take(s, core, core), take(s, core, rest))
    hcv = take(h, core, rest)
    cross = x.conj().T @ hcv
    valence = take(h, rest, rest) - cross - cross.conj().T + x.conj().T @ take(h, core, core) @ x
    return valence, take(s, rest, rest) - take(s, core, rest).conj().T @ x, float(np.abs(hcv - take(h, core, core) @ x).max(initial=0.0))
