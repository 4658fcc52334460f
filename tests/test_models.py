"""Radial families, harmonics, sites, potentials, evidence, structures and the fit driver against numpy, finite differences and rotations."""

import itertools
import math
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tephra.functions import angular, families
from tephra.operators import ctilde, neighbours, results, sites, structures
from tephra.plans import evidence, fit, models
from tephra.session import written
from tephra.sources import extxyz, files


def rotation(seed):
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(3, 3)))
    q = q * np.sign(np.diag(r))
    return q * np.sign(np.linalg.det(q))


# functions


@pytest.mark.parametrize(("name", "rate"), [("ChebExpCos", 5.25), ("ChebPow", 2.0), ("ChebLinear", 1.0), ("SBessel", 1.0)])
@pytest.mark.parametrize(("inner", "r_in", "width"), [("density", 0.0, 0.0), ("distance", 1.2, 0.4), ("zbl", 1.0, 0.0), ("zbl", 1.5, 0.5)])
def test_families_as_columns_and_arrays(spark, name, rate, inner, r_in, width):
    r = np.linspace(0.3, 5.4, 40)
    column = F.col("r")
    values = {"ChebExpCos": families.chebyshev_exp_cos(column, rate, 5.0, 0.6, 4), "ChebPow": families.chebyshev_power(column, rate, 5.0, 4), "ChebLinear": families.chebyshev_linear(column, 5.0, 4), "SBessel": families.bessel(column, 5.0, 4)}[name]
    got = spark.createDataFrame([(float(x),) for x in r], "r double").select("r", families.inside(column, values, r_in, width, 5.0, inner).alias("g")).orderBy("r").toPandas()
    bond = ctilde.Bond(name, 4, rate, 5.0, 0.6, r_in, width, inner, 1.0, 1.0, np.zeros((1, 1, 4)))
    assert np.allclose(np.stack(got["g"]), bond.basis(r + 0j).real, atol=1e-12)


@pytest.mark.parametrize(("inner", "r_in", "width"), [("density", 0.0, 0.0), ("distance", 2.0, 0.7), ("zbl", 1.0, 0.5)])
def test_cores_as_columns_and_arrays(spark, inner, r_in, width):
    r = np.linspace(0.2, 4.5, 30)
    bond = ctilde.Bond("ChebPow", 2, 2.0, 4.0, 1.5, r_in, width, inner, 2.5, 0.4, np.zeros((1, 1, 2)))
    column = families.nuclear_core(F.col("r"), 14.0, 32.0, 4.0, 1.5, 2.5) if inner == "zbl" else families.core_repulsion(F.col("r"), 2.5, 0.4, 4.0, r_in, width, inner)
    got = spark.createDataFrame([(float(x),) for x in r], "r double").select("r", column.alias("g")).orderBy("r").toPandas()["g"]
    assert np.allclose(got, bond.core(r + 0j, 14.0, 32.0).real, rtol=1e-10, atol=1e-12)


def test_error_function():
    from tephra.functions.special import erf

    x = np.concatenate([np.linspace(-7, 7, 2001), [-40.0, 40.0, 1e-300]])
    assert np.allclose(erf(x), [math.erf(v) for v in x], rtol=0, atol=3e-15)


def test_bessel_functions_are_orthonormal():
    r = np.linspace(1e-9, 5.0, 200_001)
    g = ctilde.radial_family("SBessel", r, 1.0, 5.0, 0.0, 5)
    gram = np.trapezoid(g[:, :, None] * g[:, None, :] * r[:, None, None] ** 2, r, axis=0)
    assert np.allclose(gram, np.diag(np.diag(gram)), atol=1e-6) and np.allclose(np.diag(gram), gram[0, 0], rtol=1e-6)


def test_solid_harmonics_agree_and_turn(spark):
    d = np.random.default_rng(0).normal(size=(9, 3))
    d[0] = 0
    frame = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(d)], "i int, x double, y double, z double")
    got = frame.select("i", F.array(*angular.solid_harmonics(F.col("x"), F.col("y"), F.col("z"), 4)).alias("s")).orderBy("i").toPandas()
    values, slopes = sites.solid(d, 4)
    assert np.allclose(np.stack(got["s"]), values, atol=1e-12)
    for k in range(3):
        e = np.eye(3)[k] * 1e-6
        assert np.allclose(slopes[:, :, k], (sites.solid(d + e, 4)[0] - sites.solid(d - e, 4)[0]) / 2e-6, atol=1e-7)


def turning(deg, q):
    """The matrix that turns harmonics of a degree with a rotation."""
    d = np.random.default_rng(5).normal(size=(40, 3))
    at = slice(deg * deg, (deg + 1) ** 2)
    a, b = sites.solid(d, deg)[0][:, at], sites.solid(d @ q.T, deg)[0][:, at]
    return np.linalg.lstsq(a, b, rcond=None)[0].T


@pytest.mark.parametrize(("l1", "l2"), [(0, 0), (1, 0), (1, 1), (2, 1), (2, 2), (3, 2)])
def test_coupling_turns_with_the_harmonics(l1, l2):
    q = rotation(1)
    a, b = turning(l1, q), turning(l2, q)
    stack = []
    for deg in range(abs(l1 - l2), l1 + l2 + 1):
        t = angular.real_coupling(l1, l2, deg)
        assert np.allclose(np.einsum("abM,ai,bj->ijM", t, a, b), np.einsum("ijN,MN->ijM", t, turning(deg, q)), atol=1e-9)
        stack.append(t.reshape(-1, 2 * deg + 1))
    whole = np.hstack(stack)
    assert np.allclose(whole.T @ whole, np.eye(whole.shape[1]), atol=1e-12)
    block = np.random.default_rng(2).normal(size=(3, 2 * l1 + 1, 2 * l2 + 1))
    assert np.allclose(angular.block_of(angular.block_parts(block, l1, l2), l1, l2), block)
    with pytest.raises(ValueError, match="is not in"):
        angular.real_coupling(l1, l2, l1 + l2 + 1)


# sites and potentials


def neighbourhood(pos, z, cutoff):
    pairs = [(i, j) for i, j in itertools.permutations(range(len(pos)), 2) if np.linalg.norm(pos[j] - pos[i]) < cutoff]
    i, j = (np.array(x, int) for x in zip(*pairs, strict=True))
    return np.asarray(z), i, j, pos[j] - pos[i]


POSITIONS = np.random.default_rng(3).random((6, 3)) * 3.2
SPECIES = [0, 1, 1, 0, 1, 0]


def test_design_rows_are_derivatives():
    basis = sites.SiteBasis(3.0, 3, 2, 2)
    coef = np.random.default_rng(4).normal(size=basis.columns)
    energy = lambda p: basis.design(*neighbourhood(p, SPECIES, 3.0))[0] @ coef
    e, f, v = basis.design(*neighbourhood(POSITIONS, SPECIES, 3.0))
    assert len(basis.smoothness()) == basis.columns and e[-2:].tolist() == [3, 3]
    for k, c in itertools.product(range(6), range(3)):
        step = np.zeros_like(POSITIONS)
        step[k, c] = 1e-5
        assert f[k, c] @ coef == pytest.approx(-(energy(POSITIONS + step) - energy(POSITIONS - step)) / 2e-5, abs=1e-6)
    for n, (a, b) in enumerate(sites.VOIGT):
        strain = np.zeros((3, 3))
        strain[a, b] += 5e-6
        strain[b, a] += 5e-6
        change = (energy(POSITIONS @ (np.eye(3) + strain)) - energy(POSITIONS @ (np.eye(3) - strain))) / 2e-5
        assert v[n] @ coef == pytest.approx(-change * (1 if a == b else 1), abs=1e-5)
    turned = basis.design(*neighbourhood(POSITIONS @ rotation(7).T, SPECIES, 3.0))[0]
    assert np.allclose(turned, e, atol=1e-9)
    lone = basis.design(np.array([1]), np.zeros(0, int), np.zeros(0, int), np.zeros((0, 3)))
    assert lone[0][-1] == 1 and not lone[0][:-2].any() and not lone[1].any()
    with pytest.raises(ValueError, match="needs functions"):
        sites.SiteBasis(3.0, 0, 1, 1)


def potential_head(family, inner, kind, densities):
    rng = np.random.default_rng(8)
    bond = {"nradmax": 2, "lmax": 2, "nradbasemax": 3, "radbasename": family, "radparameters": [2.0], "radcoefficients": rng.normal(size=(2, 3, 3)).tolist(), "prehc": 0.7, "lambdahc": 0.3, "rcut": 3.0, "dcut": 0.4, "rcut_in": 1.2, "dcut_in": 0.5, "inner_cutoff_type": inner}
    head = {"elements": ["Si", "Ge"], "E0": [-1.5, -2.0], "deltaSplineBins": 0.001, "embeddings": {s: {"ndensity": densities, "FS_parameters": [1.0, 1.0, 0.7, 0.5][: 2 * densities], "npoti": kind, "rho_core_cutoff": 3.0, "drho_core_cutoff": 2.5} for s in (0, 1)}, "bonds": {(a, b): bond for a in (0, 1) for b in (0, 1)}}
    return head, rng


def write_example(spark, path, family, inner, kind, densities):
    head, rng = potential_head(family, inner, kind, densities)
    rows = []
    for s in ("Si", "Ge"):
        for k in range(3):
            rows.append((s, 1, densities, k, [k + 1], [0], [k % 2], [0], rng.normal(size=densities).tolist()))
        for k, deg in enumerate((0, 1, 2), 3):  # sums of (-1)^m A_lm A_l-m are invariant
            ms = [m for m in range(-deg, deg + 1)]
            c = rng.normal(size=densities)
            rows.append((s, 2, densities, k, [1, 2], [deg, deg], [0, 1], [x for m in ms for x in (m, -m)], [float((-1) ** m * v) for m in ms for v in c]))
        c = rng.normal(size=densities)
        rows.append((s, 3, densities, 6, [1, 1, 2], [0, 1, 1], [1, 0, 1], [x for m in (-1, 0, 1) for x in (0, m, -m)], [float((-1) ** m * v) for m in (-1, 0, 1) for v in c]))
    table = spark.createDataFrame(rows, "species string, rank int, ndensity int, index int, ns array<int>, ls array<int>, mus array<int>, ms array<int>, coefficients array<double>")
    files.write_potential(table, str(path), head)
    return head, table


@pytest.mark.parametrize(("family", "inner", "kind", "densities"), [("ChebExpCos", "density", "FinnisSinclairShiftedScaled", 2), ("ChebPow", "distance", "FinnisSinclair", 1), ("SBessel", "zbl", "FinnisSinclairShiftedScaled", 2), ("ChebLinear", "density", "FinnisSinclair", 2)])
def test_potentials_come_back_and_have_right_forces(spark, tmp_path, family, inner, kind, densities):
    head, table = write_example(spark, tmp_path / "p.yaml", family, inner, kind, densities)
    assert files.potential_header(str(tmp_path / "p.yaml")) == head
    assert sorted(map(str, files.read_potential(spark, str(tmp_path / "p.yaml")).collect())) == sorted(map(str, table.collect()))
    files.write_potential(files.read_potential(spark, str(tmp_path / "p.yaml")), str(tmp_path / "q.yaml"), files.potential_header(str(tmp_path / "p.yaml")))
    assert (tmp_path / "q.yaml").read_text() == (tmp_path / "p.yaml").read_text()
    assert files.radial_table(spark, str(tmp_path / "p.yaml")).count() == 4
    model = ctilde.load_potential(spark, str(tmp_path / "p.yaml"))
    energy = lambda p: model.site_energies(*neighbourhood(p, SPECIES, 3.0))[0].sum()
    z, i, j, d = neighbourhood(POSITIONS, SPECIES, 3.0)
    sites_e, jac = model.site_energies(z, i, j, d)
    force = np.zeros((6, 3))
    np.add.at(force, i, jac)
    np.subtract.at(force, j, jac)
    for k, c in itertools.product(range(6), range(3)):
        step = np.zeros_like(POSITIONS)
        step[k, c] = 1e-6
        assert force[k, c] == pytest.approx(-(energy(POSITIONS + step) - energy(POSITIONS - step)) / 2e-6, rel=1e-4, abs=1e-5)
    assert energy(POSITIONS @ rotation(9).T) == pytest.approx(energy(POSITIONS), rel=1e-9)
    atoms = spark.createDataFrame([(1, k, SPECIES[k], *map(float, POSITIONS[k])) for k in range(6)] + [(2, 0, 1, 0.0, 0.0, 0.0)], "cfg int, atom int, species int, x double, y double, z double")
    edges = spark.createDataFrame([(1, int(a), int(b), *map(float, v)) for a, b, v in zip(i, j, d, strict=True)], "cfg int, i int, j int, dx double, dy double, dz double")
    got = ctilde.evaluate(atoms, edges, model).orderBy("cfg", "atom").toPandas()
    assert np.allclose(got["e"][:6], sites_e) and np.allclose(got[["fx", "fy", "fz"]][:6], force) and got["e"][6] == -2.0


def test_embeddings_slopes():
    x = np.array([-2.0, -0.3, -1e-7, 0.0, 2e-6, 0.4, 3.0])
    for f, m in itertools.product((ctilde.power_embedding, ctilde.shifted_embedding), (0.5, 1.0, 2.0)):
        h = 1e-9
        numeric = (f(x + h, m)[0] - f(x - h, m)[0]) / (2 * h)
        assert np.allclose(f(x, m)[1][[0, 1, 5, 6]], numeric[[0, 1, 5, 6]], rtol=1e-5), (f, m)
        assert np.allclose(f(-x, m)[0], -f(x, m)[0])


def test_potential_faults(spark, tmp_path):
    head, table = write_example(spark, tmp_path / "p.yaml", "ChebPow", "density", "FinnisSinclair", 1)
    for change in ({"bonds": {(0, 0): head["bonds"][0, 0]}}, {"bonds": head["bonds"] | {(0, 1): head["bonds"][0, 1] | {"radbasename": "SBessel"}}}):
        files.write_potential(table, str(tmp_path / "bad.yaml"), head | change)
        with pytest.raises(ValueError, match="missing|differ"):
            ctilde.load_potential(spark, str(tmp_path / "bad.yaml"))


# evidence


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(60, 4))
    x[:, 3] = 1
    y = x @ [1.0, -2.0, 0.5, 3.0] + 0.1 * rng.normal(size=60)
    w = rng.random(60) + 0.5
    frame = spark.createDataFrame([(i // 4, list(map(float, a)), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, w, strict=True))], "cfg int, phi array<double>, y double, w double").repartition(5).cache()
    return frame, x, y, w


def test_solves_agree(linear):
    frame, x, y, w = linear
    root = np.diag([0.3, 0.2, 0.5, 0.1])
    want = np.linalg.solve((x * w[:, None]).T @ (x * w[:, None]) + root.T @ root, (x * w[:, None]).T @ (y * w))
    assert np.allclose(evidence.solve_qr(frame, "phi", "y", "w", root), want)
    mean, low = evidence.posterior_qr(frame, "phi", "y", "w", root)
    assert np.allclose(mean, want) and np.allclose(low @ low.T, (x * w[:, None]).T @ (x * w[:, None]) + root.T @ root) and (np.diag(low) > 0).all()
    assert np.allclose(evidence.lsqr(evidence.Operators(frame, "phi", "y", "w", root)), want, atol=1e-8)
    empty = evidence.Operators(frame.limit(0), "phi", "y", "w", root)
    assert np.allclose(evidence.lsqr(empty), 0)


def test_evidence_by_singular_values(linear):
    from tephra.operators.stats import log_evidence_qr, qr_factors

    frame, _, _, w = linear
    r, c, rest = qr_factors(frame, "phi", "y", "w", 4)
    gamma, logw = np.array([1.0, 2.0, 1.5]), 2 * np.log(w).sum()
    sv = evidence.svd_statistics(r, c, rest, 60, logw, gamma, np.array([1e-3]))
    for ls, lc in ((-1.0, 0.3), (0.2, -0.5)):
        prior = evidence.prior_precision(gamma, lc, np.array([1e-3]))
        s = math.exp(ls)
        assert evidence.log_evidence_svd(ls, lc, sv) == pytest.approx(log_evidence_qr(r / s, c / s, rest / s**2, 60, prior, logw - 2 * 60 * ls), rel=1e-9)


def test_prior_root_algebra():
    root = evidence.PriorRoot(np.array([0.5, 2.0]), np.array([[1.0, 0.3], [0.0, 0.8]]))
    r0, x = root.matrix(), np.random.default_rng(0).normal(size=(3, 4))
    assert np.allclose(root.rows(x), x @ np.linalg.inv(r0)) and np.allclose(root.dual(x.T), np.linalg.inv(r0).T @ x.T)
    assert np.allclose(root.primal(x[0]), np.linalg.inv(r0) @ x[0]) and np.allclose(root.lift(x[0]), r0.T @ x[0])
    assert np.allclose(root.gram(x.T @ x), np.linalg.inv(r0).T @ x.T @ x @ np.linalg.inv(r0))


def test_leaving_configurations_out(linear):
    frame, x, y, w = linear
    prior = np.full(4, 0.2)
    a, t = x * w[:, None], y * w
    s = a.T @ a + np.diag(prior)
    got = evidence.loo_objective(frame, "cfg", "phi", "y", "w", np.linalg.solve(s, a.T @ t), s, 0.7, 60)
    want = 0.5 * 0.7 - 0.5 * 60 * math.log(2 * math.pi)
    for k in range(15):
        out = np.arange(60) // 4 == k
        m = np.linalg.solve(a[~out].T @ a[~out] + np.diag(prior), a[~out].T @ t[~out])
        cov = np.eye(4) + a[out] @ np.linalg.inv(a[~out].T @ a[~out] + np.diag(prior)) @ a[out].T
        r = t[out] - a[out] @ m
        want += -0.5 * r @ np.linalg.solve(cov, r) - 0.5 * np.linalg.slogdet(cov)[1]
    assert got == pytest.approx(want, rel=1e-9)


def test_grouped_evidence(linear):
    from tephra.operators.stats import Gram
    from tephra.plans.optimise import gradient

    frame, x, y, w = linear
    a, t = x * w[:, None], y * w
    ev = evidence.GroupedEvidence([Gram(a.T @ a, a.T @ t, float(t @ t), 60, 0.0)], np.array([1.0, 1.0, 2.0, 1e-2]), np.array([0, 0, 1, -1]))
    h = np.array([-1.0, 0.3, -0.4])
    value, g = ev.value_and_gradient(h)
    assert np.allclose(g, gradient(lambda z: ev.value_and_gradient(z)[0], h), rtol=1e-5)
    cov = np.eye(60) * math.exp(2 * h[0]) + a @ np.diag(1 / (np.exp([0.3, 0.3, -0.4, 0.0]) * ev.gamma**2)) @ a.T
    assert value == pytest.approx(-0.5 * t @ np.linalg.solve(cov, t) - 0.5 * np.linalg.slogdet(cov)[1] - 30 * math.log(2 * math.pi), rel=1e-8)
    best = ev.fit(h)
    assert best.converged and best.value >= value and np.abs(ev.value_and_gradient(best.x)[1]).max() < 1e-3
    post = ev.posterior(best.x, kappa=2.0)
    served = evidence.grouped_predictions(frame, "phi", post).toPandas()
    phi = np.stack(served["phi"])
    assert np.allclose(served["mu"], phi @ post.mean) and np.allclose(served["std"], 2 * np.sqrt(np.einsum("ni,ij,nj->n", phi, post.covariance(), phi)))
    factor = post.shape_factor(np.random.default_rng(1).normal(size=(4, 3)))
    shaped = evidence.grouped_predictions(frame, "phi", post, factor).toPandas()
    assert np.allclose(shaped["std"], 2 * np.linalg.norm((np.stack(shaped["phi"]) * post.dinv) @ factor, axis=1))
    assert post.shape_factor(np.ones((4, 1))).shape == (4, 1) and not post.shape_factor(np.ones((4, 3)), 0.9).any()
    assert evidence.committee(np.ones((7, 2)), np.arange(7.0), 2, 2, 1)[0].shape == (2, 2, 2)


def test_judge_and_ridge_choice():
    low, high = np.full(2, -5.0), np.full(2, 5.0)
    h = -np.eye(2)
    assert evidence.judge(0.0, np.array([1e-3, 0.0]), h, np.zeros(2), low, high)["converged"]
    assert not evidence.judge(0.0, np.array([1.0, 0.0]), h, np.zeros(2), low, high)["converged"]
    assert evidence.judge(0.0, np.array([1.0, 0.0]), h, np.array([5.0, 0.0]), low, high)["converged"]
    assert not evidence.judge(math.nan, np.zeros(2), None, np.zeros(2), low, high)["converged"]
    assert evidence.select_ridge({1e-3: 2.0, 1e-2: 1.0, 1e-1: math.nan}) == 1e-2 and evidence.select_ridge({1.0: math.nan}) == 1.0
    with pytest.raises(FloatingPointError):
        evidence.select_ridge({1.0: math.inf})


def test_corrections(spark):
    rng = np.random.default_rng(12)
    deltas = rng.normal(size=(300, 3)) * [3.0, 1.0, 0.0]
    frame = spark.createDataFrame([(list(map(float, d)),) for d in deltas], "delta array<double>").repartition(4)
    moment, mean, n = evidence.correction_moments(frame, "delta", 3)
    assert n == 300 and np.allclose(moment, deltas.T @ deltas / 300) and np.allclose(mean, deltas.mean(0))
    eig, axes = np.linalg.eigh(deltas.T @ deltas / 300)
    axes = axes[:, eig > 1e-8 * eig.max()]
    for percent in (0.0, 5.0):
        low, high = np.percentile(deltas @ axes, percent, axis=0), np.percentile(deltas @ axes, 100 - percent, axis=0)
        mid = (low + high) / 2
        assert np.allclose(evidence.box_posterior(frame, "delta", 3, percent), axes @ (np.diag((high - low) ** 2 / 12) + np.outer(mid, mid)) @ axes.T)
    phi = spark.createDataFrame([([1.0, 2.0, 3.0],), ([0.5, -1.0, 0.0],)], "phi array<double>")
    got = evidence.envelope(phi, "phi", deltas).toPandas()
    shift = np.stack(got["phi"]) @ deltas.T
    assert np.allclose(got["low"], shift.min(1)) and np.allclose(got["high"], shift.max(1))
    var = phi.select(evidence.moment_variance(F.col("phi"), moment, mean).alias("v")).toPandas()["v"]
    assert np.allclose(var, shift.var(1))
    assert evidence.explained_variance(moment, axes[:, -1:]) == pytest.approx(eig.max() / eig.sum())
    rows = spark.createDataFrame([([[1.0, 0.0], [0.0, 2.0], [1.0, 1.0]],)], "rows array<array<double>>")
    r = np.array([[1.0, 0.5], [0.2, 2.0]])
    u = np.array([[1.0, 0.0], [0.0, 2.0], [1.0, 1.0]]) * [0.5, 2.0] @ r
    assert np.allclose(evidence.atom_shapes(rows, "rows", r, np.array([0.5, 2.0])).first()["shape"], u @ u.T)


def test_kernels(spark):
    rng = np.random.default_rng(13)
    site = rng.normal(size=(12, 3)), rng.random(12) * 2, rng.integers(0, 2, 12)
    theta = {"log_ell": -0.2, "log_A": 0.1, "log_alpha": 0.3, "log_r0": 0.0, "log_eps": -1.0, "log_rho": 0.5}
    for kind in ("cosine", "matern32"):
        k = evidence.inducing_gram(theta, kind, site, np.eye(2), bump=True)
        assert np.allclose(k, k.T) and np.linalg.eigvalsh(k).min() > 0 and k[0, np.flatnonzero(site[2] != site[2][0])].max() == 0
    u = site[1][0] - 1.0
    height = math.exp(0.1 - math.exp(0.3) * u) / (1 + math.exp(-(math.exp(0.3) + math.exp(-1.0)) * u))
    assert evidence.kernel(theta, "cosine", site, site, np.eye(2))[0, 0] == pytest.approx(height**2)
    d = math.sqrt(3) * np.sqrt(((site[0][0] - site[0][1]) ** 2).mean()) / math.exp(-0.2)
    assert evidence.matern32_kernel(site[0], site[0], math.exp(-0.2))[0, 1] == pytest.approx((1 + d) * math.exp(-d))
    frame = spark.createDataFrame([(i, list(map(float, x)), float(s), int(z)) for i, (x, s, z) in enumerate(zip(*site, strict=True))] + [(99, [0.0, 0.0, 0.0], 1.0, 0)], "i int, x array<double>, s double, z int")
    got = evidence.kernel_rows(frame.where("i < 99"), "x", "s", "z", theta, "cosine", site, np.eye(2)).orderBy("i").toPandas()
    assert np.allclose(np.stack(got["k"]), evidence.kernel(theta, "cosine", site, site, np.eye(2)))
    picked = evidence.select_inducing(frame, "i", "z", "x", 3, [1.0, 2.0, 1.0]).collect()
    assert {r.z for r in picked} == {0, 1} and max(sum(r.z == z for r in picked) for z in (0, 1)) == 3 and 99 not in {r.i for r in picked}
    moment = evidence.radial_second_moment(frame, ["z"], [F.col("x")[0], F.col("s")], {(1,): np.ones((2, 2))})
    x = np.array([[a[0], s] for a, s, z in zip(*site, strict=True) if z == 1] + [[1, 1]] * 2)
    assert np.allclose(moment[1,], x.T @ x / len(x))
    assert evidence.roughness(np.ones((2, 3)), np.eye(3), np.array([1.0, 2.0])) == 9.0


# structures


def test_cells_and_stale_labels(spark):
    assert np.allclose(structures.completed(np.diag([2.0, 3.0, 4.0]), np.array([True] * 3)), np.diag([2.0, 3.0, 4.0]))
    slab = structures.completed(np.array([[2.0, 0, 0], [1.0, 3.0, 0], [0, 0, 0]]), np.array([True, True, False]))
    assert np.allclose(np.abs(slab[2]), [0, 0, 1]) and np.allclose(slab[:2, 2], 0)
    assert np.allclose(np.abs(np.linalg.det(structures.completed(np.zeros((3, 3)), np.array([False] * 3)))), 1)
    with pytest.raises(ValueError, match="degenerate"):
        structures.completed(np.array([[1.0, 0, 0], [2.0, 0, 0], [0, 0, 0]]), np.array([True, True, False]))
    box = [[4.0, 0.0, 0.0], [1.0, 5.0, 0.0], [0.0, 0.0, 6.0]]
    cells = spark.createDataFrame([(c, box, [True, True, False]) for c in range(6)], "cfg int, a array<array<double>>, pbc array<boolean>")
    assert structures.complete_cells(cells).count() == 6
    before = spark.createDataFrame([(c, k, 14, float(k), 1.0, 1.0) for c in range(6) for k in range(2)], "cfg int, atom int, z int, px double, py double, pz double")
    moves = {0: (14, 0, 0, 0), 1: (14, 5.0, 5.0, 0.0), 2: (14, 0.0, 0.0, 6.0), 3: (32, 0, 0, 0), 4: (14, 1e-3, 0, 0)}
    rows = [(c, k, moves[c][0], float(k) + moves[c][1], 1.0 + moves[c][2], 1.0 + moves[c][3]) for c in moves for k in range(2)] + [(5, 0, 14, 0.0, 1.0, 1.0)]
    after = spark.createDataFrame(rows, "cfg int, atom int, z int, px double, py double, pz double")
    got = {r.cfg: r.stale for r in structures.stale(before, after, cells, cells).collect()}
    assert got == {0: False, 1: False, 2: True, 3: True, 4: True, 5: True}
    other = cells.withColumn("pbc", F.array(F.lit(True), F.lit(True), F.lit(True)))
    assert {r.stale for r in structures.stale(before, before, cells, other).collect()} == {True}


def test_skin_lists(spark):
    rng = np.random.default_rng(14)
    pos = rng.random((8, 3)) * 4
    moved = pos + rng.normal(size=(8, 3)) * 0.02
    table = lambda p, names: spark.createDataFrame([(1, k, 14, *map(float, v)) for k, v in enumerate(p)], f"cfg int, atom int, z0 int, {names}")
    cells = spark.createDataFrame([(1, [[4.0, 0.0, 0.0], [0.0, 4.5, 0.0], [0.0, 0.0, 5.0]], [True, True, True])], "cfg int, a array<array<double>>, pbc array<boolean>")
    listed = structures.skin_list(table(pos, "x double, y double, z double").drop("z0"), cells, 2.0, 0.5)
    old, new = (table(p, "px double, py double, pz double").withColumnRenamed("z0", "z") for p in (pos, moved))
    assert structures.skin_valid(old, new, 0.5).first().valid and not structures.skin_valid(old, new, 0.01).first().valid
    assert not structures.skin_valid(old, new.where("atom > 0"), 0.5).first().valid
    got = structures.skin_step(listed, old, new, 2.0)
    want = neighbours.periodic_edges(table(moved, "x double, y double, z double").drop("z0"), cells, 2.0)
    key = lambda f: sorted((r.i, r.j, r.sx, r.sy, r.sz, round(r.dist, 9)) for r in f.collect())
    assert key(got) == key(want)
    bonded = structures.bonds(want).toPandas().set_index("bond")
    assert (bonded.loc[bonded["reverse"], "i"].to_numpy() == bonded["j"].to_numpy()).all() and (bonded.loc[bonded["reverse"], "sx"].to_numpy() == -bonded["sx"].to_numpy()).all()
    dense = structures.dense_list(want, ["j", "dist", *structures.SHIFT], ["j", *structures.SHIFT])
    assert structures.sparse_list(dense).count() == want.count()
    lone = spark.createDataFrame([(7, 0), (8, 0), (8, 1)], "cfg int, atom int")
    assert [r.cfg for r in structures.isolated(lone, want).collect()] == [7]


def test_pooling_forms_agree(spark):
    rng = np.random.default_rng(15)
    rows = [(int(i), int(z), int(c), list(map(float, b)), list(map(float, y))) for i, z, c, b, y in zip(rng.integers(0, 4, 30), [0] * 30, rng.integers(0, 2, 30), rng.normal(size=(30, 3)), rng.normal(size=(30, 4)), strict=True)]
    frame = spark.createDataFrame(rows, "i int, z int, c int, b array<double>, y array<double>").withColumn("z", F.col("i") % 2)
    w, pairs = rng.normal(size=(2, 2, 2, 3)), [(0, 0), (1, 0), (1, 3)]
    flat = [F.element_at(F.array(*[F.element_at(F.array(*[sum((F.lit(float(w[z, c, r, k])) * F.col("b")[k] for k in range(3)), F.lit(0.0)) for c in range(2)]), F.col("c") + 1) for z in range(2)]), F.col("z") + 1) for r in range(2)]
    edge = frame.withColumn("r", F.array(*flat)).withColumn("rows", structures.edge_products(F.col("r"), F.col("y"), pairs))
    a = structures.pool(edge, ["i"], "rows", "c", 3, 2).orderBy("i").toPandas()
    b = structures.pool_then_map(frame, ["i"], "z", "b", "y", "c", w, pairs).orderBy("i").toPandas()
    assert np.allclose(np.stack(a["a"]), np.stack(b["a"]))


def test_keys_tables_and_numbers(spark, tmp_path):
    assert structures.spec_key(1, a=[1, 2], b={"x": 1}) == structures.spec_key(1, b={"x": 1}, a=[1, 2]) != structures.spec_key(2, a=[1, 2], b={"x": 1})
    made = []
    table = lambda: made.append(1) or spark.range(3)
    assert structures.cached_table(spark, str(tmp_path), "k", table).count() == structures.cached_table(spark, str(tmp_path), "k", table).count() == 3 and len(made) == 1
    nested = {"pca": {14: {"mu": 1, "W": 2}}, 14: {"g": [1]}}
    assert structures.nested_names(structures.flat_names(nested)) == nested
    rows = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (1.5,)], "x double")
    back = [r.y for r in rows.select(structures.restored_number(structures.strict_number(F.col("x"))).alias("y")).collect()]
    assert back[0] == math.inf and back[1] == -math.inf and math.isnan(back[2]) and back[3] == 1.5
    assert math.isnan(rows.select(structures.restored_number(F.lit(None).cast("string")).alias("y")).first().y)
    assert structures.embedding_widths(3, 3) == [3, 6, 10] and structures.embedding_widths(3, 3, 5) == [3, 5, 5]
    assert structures.shell_offsets({14: [0, 1, 2]}) == {14: [0, 1, 4, 9]}
    assert spark.range(1).select(structures.one_hot(F.lit(1), 3).alias("h")).first().h == [0.0, 1.0, 0.0]
    sums = spark.createDataFrame([(1, v) for v in (1e16, 1.0, -1e16, 1e-3)] + [(2, 0.1)] * 10, "k int, v double").repartition(3)
    assert {r.k: r.total for r in structures.exact_sum(sums, ["k"], "v").collect()} == {1: 1.001, 2: 1.0}
    index = structures.species_table([spark.createDataFrame([(32,), (14,)], "z int")])
    with pytest.raises(Exception, match="no such element"):
        structures.species_index(spark.createDataFrame([(8,)], "z int"), index).collect()
    a = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in ((2, 0, 0), (1, 3, 0), (0, 0, 9))])
    assert spark.range(1).select(structures.surface_energy(F.lit(-4.0), F.lit(2), F.lit(-7.0), F.lit(4), a).alias("g")).first().g == pytest.approx(1 / 12)
    found = spark.createDataFrame([(0, [1, 2, 3], 2), (-1, [0, 0, 0], 0)], "index int, x array<int>, n int")
    assert structures.unpadded(found, "x", "n", "index").first().x == [1, 2]
    blocks = spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0), (1, 1, 4.0)], "r int, c int, v double")
    assert {(r.row, r.col): r.v for r in structures.scatter(blocks, [], F.col("r"), F.col("c"), F.col("v") * 2).collect()} == {(0, 1): 10.0, (1, 1): 8.0}


def test_fingerprints_and_shells(spark):
    pos = np.array([[0.0, 0, 0], [1.5, 0, 0], [0, 2.0, 0]])
    make = lambda c, order: [(c, k, "Si" if o < 2 else "Ge", *map(float, pos[o])) for k, o in enumerate(order)]
    atoms = spark.createDataFrame(make(1, [0, 1, 2]) + make(2, [2, 0, 1]), "cfg int, atom int, symbol string, x double, y double, z double")
    cells = spark.createDataFrame([(c, np.diag([9.0, 9.0, 9.0]).tolist(), [True] * 3) for c in (1, 2)], "cfg int, a array<array<double>>, pbc array<boolean>")
    pairs = results.closest_pairs(neighbours.periodic_edges(atoms, cells, 4.0), "i", "j", "dist", ["cfg"])
    a, b = (tuple(r)[1:] for r in structures.fingerprint(atoms, cells, "symbol", pairs).collect())
    assert a == b and a[0] == "GeSi2" and a[1] == 729.0 and a[2] == [1.5, 2.0, 2.5]
    rng = np.random.default_rng(16)
    d = np.concatenate([rng.normal(2.4, 0.05, 4000), rng.normal(3.9, 0.08, 12000)])
    frame = spark.createDataFrame([(float(x),) for x in d], "d double")
    h, e = np.histogram(d, bins=400, range=(0, d.max()))
    got = structures.shell_reference(frame, "d")
    assert 2.5 < got < 3.7 and (np.abs((e[1:] + e[:-1]) / 2 - got) < 1e-9).any()


def test_model_files_and_fit(spark, tmp_path, folder):
    data = models.labelled_structures(spark, "/root/testdata/sf0.01")
    basis = sites.SiteBasis(4.0, 4, 1, 2)
    told = []
    model, table = fit.run(data.where("cfg % 5 <> 0"), data.where("cfg % 5 = 0"), basis, str(tmp_path / "run"), on_stage=lambda name, _: told.append(name), draws=3)
    assert told == ["map", "metrics"] and model.draws.shape == (3, 4) and {p.name for p in (tmp_path / "run").iterdir()} >= {"model.json", "theta_map.json", "metrics.csv"}
    again = fit.load(spark, str(tmp_path / "run"))
    assert np.allclose(again.mean, model.mean) and again.theta == model.theta and again.basis == basis
    energies, forces = fit.evaluate(data, again)
    e, f = energies.toPandas(), forces.join(data.forces, ["cfg", "atom"]).toPandas()
    assert np.corrcoef(e["energy"], e["energy_mean"])[0, 1] > 0.99 and len(e) == data.configs.count()
    assert np.abs(f["fx"] - f["fx_mean"]).mean() < 0.5 * np.abs(f["fx"]).mean()
    rows = fit.errors_by_type(fit.predict(fit.observations(data, basis), model)).collect()
    text = fit.format_errors(rows, "train")
    assert {r["type"] for r in rows} == {"all", "t0", "t1", "t2"} and len({len(x) for x in text.split("\n")[1:]}) == 1


# results and strict files


def test_results_are_read_with_repeats(spark, tmp_path):
    (tmp_path / "repeats").mkdir()
    (tmp_path / "a.jsonl").write_text('{"model": "x/bulk/small", "v": 1}\n\n{"model": "y", "v": 2, "system": "slab"}\n')
    (tmp_path / "repeats" / "a.jsonl").write_text('{"model": "x/bulk/small", "v": 3}\n')
    rows = results.with_parts(results.read_results(spark, str(tmp_path)), "model", ["", "system", "size"])
    assert sorted((r.v, r.system, r["size"], r["_file"]) for r in rows.collect()) == [(1, "bulk", "small", "a"), (2, "slab", None, "a"), (3, "bulk", "small", "a")]
    part = lambda f: [(f, F.concat_ws("|", "model", F.col("v").cast("string")))]
    assert results.split_hash(part(rows)) == results.split_hash(part(rows.repartition(7))) != results.split_hash(part(rows.limit(2)))


def test_damaged_structures_are_errors(spark, tmp_path):
    frame = 'x\n'.replace("x", '2\nProperties=species:S:1:pos:R:3 tag="_JSON {\\"a\\": [1, 2]}" note="a \\"b\\""') + "Si 0 0 0\nSi 1 1 1\n"
    good = tmp_path / "good.xyz"
    good.write_text(frame * 5 + "\n")
    for split in (64 << 20, 50):
        got = extxyz.read_extxyz(spark, [str(good)], split=split).collect()
        assert len(got) == 5 and got[0]["info"] == {"tag": '{"a":[1,2]}', "note": 'a "b"'}
    for name, text in (("lost", frame + "Si 0 0 0\n" + frame), ("begin", "junk\n" + frame), ("species", frame.replace("Si 1", "Qq 1")), ("pos", frame.replace(":pos:R:3", ":xyz:R:3")), ("json", frame.replace("[1, 2]", "[1, "))):
        (tmp_path / f"{name}.xyz").write_text(text)
        with pytest.raises(Exception, match="not a number of atoms|unknown species|lack species|columns|Expecting"):
            extxyz.read_extxyz(spark, [str(tmp_path / f"{name}.xyz")]).collect()


# structures of any size


def crowd(n, edges, seed=11):
    """A structure of n atoms with so many edges each way of centres in order; neighbours repeat, as images do."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2, n), np.sort(rng.integers(0, n, edges)), rng.integers(0, n, edges), rng.normal(size=(edges, 3))


def test_design_holds_few_derivatives():
    basis = sites.SiteBasis(4.0, 3, 1, 2)
    z, i, j, d = crowd(300, 80_000)
    tracemalloc.start()
    e, f, v = basis.design(z, i, j, d)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(d) * basis.width * 3 * 8  # less than the derivatives of all edges at once
    parts = sites.Sums(basis, z)
    for low in range(0, 300, 7):
        mine = (i >= low) & (i < low + 7)
        if mine.any():
            parts.add(i[mine], j[mine], d[mine])
    assert np.allclose(parts.e, e) and np.allclose(parts.f, f) and np.allclose(parts.v, v)
    assert np.allclose(f.sum(0)[:, : -basis.species], 0, atol=1e-8 * np.abs(f).max())


def test_design_rows_of_structures_that_arrive_in_pieces(spark):
    basis = sites.SiteBasis(4.0, 2, 1, 2)
    made = {"a": crowd(9, 200, 1), "b": crowd(4, 50, 2), "lone": crowd(1, 0, 3)}
    atoms = pd.DataFrame([(c, 100 - k, int(s)) for c, x in made.items() for k, s in enumerate(x[0])], columns=["cfg", "atom", "species"])
    edges = pd.DataFrame([(c, 100 - int(i), 100 - int(j), *map(float, v)) for c, x in made.items() for i, j, v in zip(*x[1:], strict=True)], columns=["cfg", "i", "j", "dx", "dy", "dz"])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
        rows = sites.design_rows(spark.createDataFrame(atoms), spark.createDataFrame(edges), basis).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(rows) == sum(3 * len(x[0]) + 7 for x in made.values())
    for c, x in made.items():
        want = dict(zip("EFV", basis.design(*x), strict=True))
        for r in rows[rows["cfg"] == c].itertuples():
            line = {"E": lambda: want["E"], "F": lambda: want["F"][100 - r.atom, r.comp], "V": lambda: want["V"][r.comp]}[r.quantity]()
            assert np.allclose(r.phi, line, atol=1e-9)


def test_labels_write_a_row_an_atom(spark, monkeypatch):
    sizes = []

    def counted(frame, name):
        out = written(frame, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(models, "written", counted)
    d = "/root/testdata/sf0.1"
    data = models.labelled_structures(spark, d)
    assert sum(sizes) <= models.atoms(spark, d).count()  # edges are many more
    law = structures.pair_tables(models.radial_law(spark).withColumn("v", F.col("v") * F.pow(1 - F.pow(F.col("r") / 4.0, 2), 2)))
    total, forces = structures.baseline(models.edges(spark, d, 4.0), models.atoms(spark, d).select("cfg", "atom", F.col("species").alias("z")), law)
    e = data.configs.join(total, "cfg").toPandas()
    assert len(e) == 25 and np.allclose(e["energy"], e["e"]) and all(np.allclose(a, b) for a, b in zip(e["virial"], e["v"], strict=True) if a is not None)
    f = data.forces.join(forces.withColumnsRenamed({c: f"want_{c}" for c in ("fx", "fy", "fz")}), ["cfg", "atom"]).toPandas()
    assert len(f) > 900 and all(np.allclose(f[c], f[f"want_{c}"]) for c in ("fx", "fy", "fz"))


def test_energy_rows_need_no_derivatives(spark, monkeypatch):
    basis = sites.SiteBasis(4.0, 3, 1, 2)
    z, i, j, d = crowd(300, 30_000)
    monkeypatch.setattr(sites.SiteBasis, "edge_slopes", lambda *_: pytest.fail("derivatives were made"))
    sums = sites.Sums(basis, z, False)
    sums.add(i, j, d)
    assert sums.f.size == 0
    monkeypatch.undo()
    assert np.allclose(sums.e, basis.design(z, i, j, d)[0])
    atoms, edges = models.atoms(spark, "/root/testdata/sf0.01"), models.edges(spark, "/root/testdata/sf0.01", 3.0)
    some = sites.design_rows(atoms, edges, models.BASIS, ("E",)).toPandas().sort_values("cfg")
    whole = sites.design_rows(atoms, edges, models.BASIS).where("quantity = 'E'").toPandas().sort_values("cfg")
    assert some["quantity"].eq("E").all() and some["cfg"].tolist() == whole["cfg"].tolist() and np.allclose(np.stack(some["phi"]), np.stack(whole["phi"]))
