"""Parameter blocks, product plans, operator blocks and the SQL front end against numpy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tephra.functions import angular
from tephra.operators import blocks, monomials, sites
from tephra.operators.stats import Gram
from tephra.plans import parameters
from tephra.plans import sql as front


def test_blocks_of_parameters():
    prior = (np.zeros(3), np.full(3, 2.0))
    p = parameters.fit_parameters(np.array([1.0, 2.0, 3.0]), prior, embed=np.eye(2), n_types=3, sigma_type=True)
    assert p.vector().tolist() == [1, 2, 3, *[0] * 6] and p["embed"].route == "fixed"
    q = p.with_vector(np.arange(9.0))
    assert q["hypers"].value.tolist() == [0, 1, 2] and parameters.type_ratios(q, 3).tolist() == [[0, 0, 0], [3, 4, 5], [6, 7, 8]]
    want = -0.5 * (0 + 1 + 4) / 4 - 3 * math.log(2) - 0.5 * sum(v * v for v in range(3, 9)) / 2.25 - 6 * math.log(1.5) - 4.5 * math.log(2 * math.pi)
    assert q.log_prior() == pytest.approx(want)
    assert parameters.fit_parameters(np.zeros(1), prior, embed=np.ones(2), route='{"embed": "lml", "none": "fixed"}').vector().tolist() == [0, 1, 1]
    for bad in ('{"embed": "vopt"}', "[1]"):
        with pytest.raises(ValueError, match="route"):
            parameters.parse_route(bad)
    with pytest.raises(ValueError, match="cannot be optimised"):
        parameters.fit_parameters(np.zeros(1), prior, embed=np.ones(2), n_types=2, sigma_type=True, route={"embed": "lml"})
    f = parameters.tied(lambda x: (float(x @ [1, 2, 3]), np.array([1.0, 2.0, 3.0])), 0, [2])
    assert f(np.array([1.0, 1.0, 9.0]))[0] == 6.0 and f(np.zeros(3))[1].tolist() == [4.0, 2.0, 0.0]


def test_profiled_fits():
    rng = np.random.default_rng(0)
    x = rng.random(200) * 3
    y = 2 * np.exp(-1.3 * x) + 0.5 + 1e-3 * rng.normal(size=200)

    def statistics(eta):
        phi = np.column_stack([np.exp(-eta[0] * x), np.ones_like(x)])
        return Gram(phi.T @ phi, phi.T @ y, float(y @ y), 200, 0.0)

    eta, residual = parameters.learn(np.array([0.7]), statistics, np.full(2, 1e-9))
    assert eta[0] == pytest.approx(1.3, abs=0.01) and residual < 200 * 2e-6
    phi = np.column_stack([np.exp(-1.3 * x), np.ones_like(x)])
    root = np.diag([0.1, 0.2])
    assert np.allclose(parameters.inner_solve(phi, y, root), np.linalg.solve(phi.T @ phi + root.T @ root, phi.T @ y))
    g = statistics(np.array([1.3]))
    c = np.linalg.solve(g.g + np.eye(2), g.b)
    score = parameters.holdout_score(g, {"E": g, "F": Gram(np.zeros((2, 2)), np.zeros(2), 0.0, 0, 0.0)}, np.ones(2), {"E": 0.5, "F": 0.0})
    assert score == pytest.approx(((phi @ c - y) ** 2).sum() * math.exp(-1.0))
    assert parameters.rounding_check(np.triu(rng.normal(size=(4, 4))) + 4 * np.eye(4), rng.normal(size=4), np.ones(4))["verdict"] == "stable"
    loose = np.triu(rng.normal(size=(4, 4))) + 4 * np.eye(4)
    assert parameters.rounding_check(loose, rng.normal(size=4), np.full(4, 1e-3), eps=1.0)["verdict"] == "unstable"


def test_ascents_and_draws():
    cov = np.array([[1.0, 0.6], [0.6, 2.0]])
    precision = np.linalg.inv(cov)
    f = lambda z: (-0.5 * float((z - 1) @ precision @ (z - 1)), -precision @ (z - 1))
    x, value = parameters.block_ascent(f, np.zeros(2), [[0], [1]], np.full(2, -9.0), np.full(2, 9.0), rounds=40, tol=1e-12)
    assert np.allclose(x, 1, atol=1e-3) and value == pytest.approx(0, abs=1e-5)
    draws = parameters.ladder(lambda z: f(z)[0], np.ones(2), ["map", "laplace", "walk", "vi"], 3000)
    assert draws["map"].tolist() == [[1, 1]]
    assert np.allclose(np.cov(draws["laplace"].T), cov, atol=0.2) and np.allclose(draws["walk"].mean(0), 1, atol=0.25) and np.allclose(np.cov(draws["walk"].T), cov, atol=0.7)
    assert np.allclose(draws["vi"].mean(0), 1, atol=0.3) and np.allclose(draws["vi"].std(0) ** 2, 1 / np.diag(precision), atol=0.5)
    with pytest.raises(ValueError, match="unknown"):
        parameters.ladder(lambda z: 0.0, np.ones(2), ["other"], 1)


def test_product_plans_share_and_derive():
    rng = np.random.default_rng(1)
    wanted = [tuple(rng.integers(0, 6, rng.integers(1, 5))) for _ in range(60)]
    plan = monomials.build_plan(wanted, 6)
    a, c = rng.normal(size=(5, 6)), rng.normal(size=60)
    direct = lambda a: sum(w * np.prod(a[:, list(m)], 1) for w, m in zip(c, wanted, strict=True))
    value, slope = monomials.contract(plan, a, c)
    assert np.allclose(value, direct(a)) and monomials.flops(plan) > 0
    for i in range(6):
        e = np.eye(6)[i] * 1e-6
        assert np.allclose(slope[:, i], (direct(a + e) - direct(a - e)) / 2e-6, atol=1e-5)
    kept, k, used = monomials.prune([(0, 3), (5,), (1, 1)], np.array([1.0, 0.0, 2.0]), 6)
    assert kept == [(0, 2), (1, 1)] and used.tolist() == [0, 1, 3] and k.tolist() == [1, 2]
    assert np.allclose(monomials.fold([1.0, 2.0], [[1.0, 0.0, 3.0], [0.0, 1.0, 1.0]]), [1, 2, 5])
    assert monomials.build_plan([], 3).products == 0
    with pytest.raises(ValueError, match="factor"):
        monomials.build_plan([()], 3)
    spec = monomials.embedding_spec([((1, 0),), ((1, 1), (2, 1))], [2, 1])
    assert spec == [((1, 0),), ((2, 0),), ((1, 1), (3, 1))] and monomials.channel_count(3, 2) == 6


def test_tables_are_as_close_as_asked(spark):
    from tephra.functions.radial import spline

    f = lambda r: np.exp(-r) * np.cos(2 * r)
    c, h, n = monomials.tabulated(f, 0.5, 4.5, 1e-7)
    x = np.linspace(0.5, 4.499, 300)
    got = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", spline(F.col("x"), c.tolist(), 0.5, h).alias("s")).orderBy("x").toPandas()["s"]
    assert np.abs(got - f(x)).max() < 2e-7 and n < 4096
    with pytest.raises(ValueError, match="no table"):
        monomials.tabulated(lambda r: np.sqrt(np.abs(r - 1.234)), 0.5, 4.5, 1e-12, 64)


def rotation(seed):
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(3, 3)))
    q = q * np.sign(np.diag(r))
    return q * np.sign(np.linalg.det(q))


def turning(deg, q):
    d = np.random.default_rng(5).normal(size=(40, 3))
    at = slice(deg * deg, (deg + 1) ** 2)
    return np.linalg.lstsq(sites.solid(d, deg)[0][:, at], sites.solid(d @ q.T, deg)[0][:, at], rcond=None)[0].T


def test_features_turn():
    basis, q = sites.SiteBasis(3.0, 2, 2, 2), rotation(3)
    rng = np.random.default_rng(2)
    i, z, d = rng.integers(0, 3, 12), rng.integers(0, 2, 12), rng.normal(size=(12, 3))
    for deg in range(4):
        a, b = (blocks.equivariant_features(basis, i, z, v, 3, deg) for v in (d, d @ q.T))
        assert a.shape[1] and np.allclose(np.einsum("MN,nkN->nkM", turning(deg, q), a), b, atol=1e-9)


def test_blocks_are_learned_and_turn(spark):
    basis, shells = sites.SiteBasis(3.0, 2, 1, 2), {0: (0, 1), 1: (1,)}
    rng = np.random.default_rng(4)
    keys = [(z, s1, s2, deg) for z, s in shells.items() for s1, s2, l1, l2 in blocks.shell_pairs(s) for deg in blocks.degrees(l1, l2, s1 == s2)]
    width = {deg: blocks.equivariant_features(basis, np.zeros(0, int), np.zeros(0, int), np.zeros((0, 3)), 1, deg).shape[1] for deg in range(3)}
    truth = blocks.BlockModel(basis, shells, {k: rng.normal(size=width[k[3]]) for k in keys})
    atoms, edges, rows = [], [], []
    for cfg in range(60):
        pos, z = rng.random((5, 3)) * 3, rng.integers(0, 2, 5)
        pairs = np.array([(a, b) for a, b in itertools.permutations(range(5), 2) if np.linalg.norm(pos[b] - pos[a]) < 3.0])
        d = pos[pairs[:, 1]] - pos[pairs[:, 0]]
        atoms += [(cfg, k, int(z[k])) for k in range(5)]
        edges += [(cfg, int(a), int(b), *map(float, v)) for (a, b), v in zip(pairs, d, strict=True)]
        features = {deg: blocks.equivariant_features(basis, pairs[:, 0], z[pairs[:, 1]], d, 5, deg) for deg in range(3)}
        for kind in (0, 1):
            mine = np.flatnonzero(z == kind)
            for (s1, s2), block in truth.blocks(kind, {k: f[mine] for k, f in features.items()}).items() if len(mine) else ():
                rows += [(cfg, int(k), s1, s2, b.ravel().tolist()) for k, b in zip(mine, block, strict=True)]
    at = spark.createDataFrame(atoms, "cfg int, atom int, species int")
    ed = spark.createDataFrame(edges, "cfg int, i int, j int, dx double, dy double, dz double")
    bl = spark.createDataFrame(rows, "cfg int, atom int, s1 int, s2 int, v array<double>")
    model, report = blocks.fit_onsite(at, ed, bl, basis, shells)
    assert all(report[k][2] < 1e-3 and report[k][0] > 0 for k in keys)
    got = blocks.predict_onsite(at, ed, model).join(bl.withColumnRenamed("v", "w"), ["cfg", "atom", "s1", "s2"]).toPandas()
    assert len(got) == len(rows) and max(np.abs(np.array(a) - np.array(b)).max() for a, b in zip(got["v"], got["w"], strict=True)) < 1e-2
    empty, none = blocks.fit_onsite(at, ed, bl.limit(0), basis, shells)
    assert all(n == (0, 0, 0.0) for n in none.values()) and not np.array(blocks.predict_onsite(at, ed, empty).first()["v"]).any()
    assert np.allclose(angular.block_of(angular.block_parts(np.eye(3), 1, 1), 1, 1), np.eye(3))


def test_bond_blocks_are_learned(spark):
    basis, shells = sites.SiteBasis(3.0, 2, 1, 1), {0: (0, 1)}
    rng = np.random.default_rng(9)
    made, atoms, rows = [], [], []
    for cfg in range(25):
        pos = rng.random((4, 3)) * 2.6
        pairs = np.array([(a, b) for a, b in itertools.permutations(range(4), 2) if np.linalg.norm(pos[b] - pos[a]) < 3.0])
        made.append((pairs, pos[pairs[:, 1]] - pos[pairs[:, 0]]))
        atoms += [(cfg, k, 0) for k in range(4)]
    keys = [(s1, s2, deg) for s1, l1 in enumerate((0, 1)) for s2, l2 in enumerate((0, 1)) for deg in blocks.degrees(l1, l2, False)]
    coefficient = {}
    for cfg, (pairs, d) in enumerate(made):
        pooled = blocks.pooled_sites(basis, pairs[:, 0], np.zeros(len(pairs), int), d, 4)
        parts: dict = {}
        for s1, s2, deg in keys:
            f = blocks.bond_features(basis, d, pooled[pairs[:, 0]], pooled[pairs[:, 1]], deg)
            c = coefficient.setdefault((s1, s2, deg), rng.normal(size=f.shape[1]))
            parts.setdefault((s1, s2), {})[deg] = np.einsum("k,bkM->bM", c, f)
        whole = {k: angular.block_of(v, k[0], k[1]) for k, v in parts.items()}
        rows += [(cfg, int(a), int(b), *map(float, v), [(s1, s2, whole[s1, s2][n].ravel().tolist()) for s1, s2 in whole]) for n, ((a, b), v) in enumerate(zip(pairs, d, strict=True))]
    at = spark.createDataFrame(atoms, "cfg int, atom int, species int")
    bonds = spark.createDataFrame(rows, "cfg int, i int, j int, dx double, dy double, dz double, blocks array<struct<s1:int,s2:int,v:array<double>>>")
    model, report = blocks.fit_offsite(at, bonds, basis, shells)
    assert all(r[2] < 1e-3 and r[0] for r in report.values())
    got = blocks.predict_offsite(at, bonds, model).toPandas()
    want = {(r[0], r[1], r[2], s1, s2): v for r in rows for s1, s2, v in r[6]}
    assert len(got) == len(want) and max(np.abs(np.array(r.v) - want[r.cfg, r.i, r.j, r.s1, r.s2]).max() for r in got.itertuples()) < 1e-2
    q = rotation(4)
    pairs, d = made[0]
    for deg in range(3):
        pooled = [blocks.pooled_sites(basis, pairs[:, 0], np.zeros(len(pairs), int), v, 4) for v in (d, d @ q.T)]
        a, b = (blocks.bond_features(basis, v, p[pairs[:, 0]], p[pairs[:, 1]], deg) for v, p in zip((d, d @ q.T), pooled, strict=True))
        assert np.allclose(np.einsum("MN,nkN->nkM", turning(deg, q), a), b, atol=1e-9)


def test_core_projection_keeps_valence_energies():
    rng = np.random.default_rng(6)
    s = np.eye(5) + 0.1 * np.ones((5, 5))
    low = np.linalg.cholesky(s)
    u = np.linalg.qr(rng.normal(size=(5, 5)))[0]
    h = low @ u @ np.diag([-50.0, -40.0, -1.0, 0.5, 2.0]) @ u.T @ low.T
    vectors = np.linalg.solve(low.T, u)
    basis = np.column_stack([vectors[:, :2], np.eye(5)[:, 2:]])  # core states as orbitals
    hv, sv, leak = blocks.project_core(basis.T @ h @ basis, basis.T @ s @ basis, np.array([0, 1]))
    values = np.linalg.eigvals(np.linalg.solve(sv, hv)).real
    assert np.allclose(np.sort(values), [-1.0, 0.5, 2.0]) and leak < 50
    with pytest.raises(ValueError, match="core"):
        blocks.project_core(h, s, np.zeros(0))


def test_sql_takes_values(spark, folder):
    assert front.sql(spark, folder, "select count(*) n from orders where o_orderpriority = :p", p="5-LOW' or '1'='1").first().n == 0
    assert front.sql(spark, folder, "select count(*) n from region").first().n == 5


def test_campaigns_learn_and_keep_held_out_rows_out(spark):
    from tephra.operators.ordered import top_k
    from tephra.plans import campaign

    rows = spark.createDataFrame([(k, float(k % 17), None) for k in range(60)], "k int, x double, y double")
    truth = lambda f: f.withColumn("y", 3 * F.col("x"))
    held = rows.where("k >= 50")
    out = campaign.run_campaign(
        truth(rows.where("k < 3")), key="k", pool=lambda m, n: rows, pick=lambda p, t, m, n: top_k(p, "x", "k", n), label=truth,
        fit=lambda t: t.agg(F.avg("x")).first()[0], error=lambda m: abs(m - 8.0), held_out=held, rounds=3, per_round=5,
    )
    assert [r.labelled for r in out[1]] == [0, 5, 10, 15] and all(r.picked is None or r.picked.where("k >= 50 or k < 3").isEmpty() for r in out[1])
    assert len({r.k for x in out[1][1:] for r in x.picked.collect()}) == 15
    with pytest.raises(ValueError, match="pick"):
        campaign.run_campaign(truth(rows.where("k < 3")), key="k", pool=lambda m, n: rows, pick=lambda p, t, m, n: p, label=truth, fit=lambda t: 0, error=lambda m: 0.0, held_out=held, rounds=1, per_round=5)
    devs = spark.createDataFrame([(1, 0.5), (1, 2.0), (2, float("nan")), (2, 0.1)], "s int, d double")
    assert {r.s: r.most for r in campaign.largest_deviation(devs, "s", "d").collect()} == {1: 2.0, 2: 0.1}
