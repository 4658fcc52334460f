"""Sources, streams, solvers, bands and basis functions against direct computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tephra.functions.special import chi_ppf, gamma_lower, normal_cdf
from tephra.operators import bands, basis, stats
from tephra.plans import optimise
from tephra.sources import extxyz, files
from tephra.streaming import windows

XYZ = """2
Lattice="4 0 0 0 4 0 0 0 4" Properties=species:S:1:pos:R:3:dft_force:R:3 Energy=-1.5 config_type=bulk stress="1 2 3 0 0 0" note="a b"
Si 0 0 0 0.1 0 0
Si 1 1 1 -0.1 0 0
1
Properties=species:S:1:pos:R:3 energy=-3
H 0 0 0
"""


def test_extxyz_scan_in_ranges(spark, tmp_path):
    path = tmp_path / "a.xyz"
    path.write_text(XYZ * 30)
    for split in (64 << 20, 100):
        got = extxyz.read_extxyz(spark, [str(path)], split=split)
        assert got.count() == 60 and got.agg(F.sum("n")).first()[0] == 90
    typed = extxyz.configs(got, forces="DFT_force", stress="stress").orderBy("offset").limit(2).collect()
    assert typed[0].energy == -1.5 and typed[0].virial[:1] == [-64.0] and typed[0].pbc == [True] * 3 and typed[0].forces[0] == [0.1, 0, 0]
    assert typed[1].virial is None and typed[1].forces is None and typed[1].pbc == [False] * 3 and typed[1].config_type is None
    assert extxyz.atoms(got).count() == 90
    extxyz.write_extxyz(got.limit(4), str(tmp_path / "out"))
    again = extxyz.read_extxyz(spark, [str(p) for p in (tmp_path / "out").glob("part-*")])
    assert again.count() == 4
    with pytest.raises(ValueError, match="columns of Properties"):
        extxyz.frame(["1", "Properties=species:S:1:pos:R:3", "H 0 0"], "here")


def test_files(spark, tmp_path):
    run = tmp_path / "run.yaml"
    run.write_text("train_path: a.xyz\nsteps: 3\n")
    read = files.read_run(str(run))
    assert read == {"train_path": str(tmp_path / "a.xyz"), "steps": 3}
    assert files.resolved({"steps": 1, "train_path": "", "seed": 0}, read, {"seed": 4})["seed"] == 4
    with pytest.raises(KeyError):
        files.resolved({"steps": 1}, read, {})
    files.save_arrays(spark, {"a": np.arange(6).reshape(2, 3), "b": np.float64(2)}, str(tmp_path / "m"))
    files.patch_arrays(spark, str(tmp_path / "m"), str(tmp_path / "n"), {"b": np.array([5.0])})
    got = files.load_arrays(spark, str(tmp_path / "n"), ("a",))
    assert got["a"].tolist() == [[0, 1, 2], [3, 4, 5]] and got["b"].tolist() == [5.0]
    row = ("Si", 1, 1, 0, [1], [0], [0], [0], [0.25])
    table = spark.createDataFrame([row], "species string, rank int, ndensity int, index int, ns array<int>, ls array<int>, mus array<int>, ms array<int>, coefficients array<double>")
    files.write_potential(table, str(tmp_path / "p.yaml"))
    assert tuple(files.read_potential(spark, str(tmp_path / "p.yaml")).first()) == row
    emit = files.event_sink(str(tmp_path / "log.jsonl"))
    emit("step", loss=float("nan"), n=1)
    assert spark.read.json(str(tmp_path / "log.jsonl")).first().loss == "nan"


def test_streams_equal_batches(spark, folder, tmp_path):
    source = f"{folder}/events.parquet"
    batch = spark.read.parquet(source)
    for i in range(3):
        batch.where(f"event_id % 3 = {i}").write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = windows.tumbling(stream, "ts", "1 hour", "3650 days", ["event_type"], n=F.count("*"), v=F.sum("value"))
    q = out.writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.window.start, r.event_type): (r.n, round(r.v, 6)) for r in spark.table("tumbled").collect()}
    want = batch.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v")).collect()
    assert got == {(r.window.start, r.event_type): (r.n, round(r.v, 6)) for r in want}
    features = [F.lit(1.0), F.col("value")]
    windows.growing_gram(stream, features, F.col("value"), F.lit(1.0), str(tmp_path / "gram"), str(tmp_path / "c1")).awaitTermination()
    total, whole = windows.total_gram(spark, str(tmp_path / "gram")).first(), stats.gram_entries(batch, features, F.col("value"), F.lit(1.0)).first()
    assert total.n == whole.n and total.g_1_1 == pytest.approx(whole.g_1_1)
    windows.merge_into(stream.select("user_id", "ts", "value"), str(tmp_path / "t"), ["user_id"], F.struct("ts", "value"), str(tmp_path / "c2")).awaitTermination()
    last = sorted((tmp_path / "t").glob("v*"))[-1]
    newest = {r.user_id: r.ts for r in spark.read.parquet(str(last)).collect()}
    assert newest == {r.user_id: r.t for r in batch.groupBy("user_id").agg(F.max("ts").alias("t")).collect()}


def test_special_functions():
    assert normal_cdf(1.959963984540054) == pytest.approx(0.975)
    assert chi_ppf(0.9, 1) == pytest.approx(1.6448536269514722) and chi_ppf(0.9, 2) == pytest.approx(math.sqrt(-2 * math.log(0.1)))
    assert gamma_lower(1.5, chi_ppf(0.9) ** 2 / 2) == pytest.approx(0.9) and chi_ppf(1.0) == math.inf


def test_optimisers():
    target, scale = np.array([1.0, -2.0, 3.0]), np.array([1.0, 10.0, 0.1])

    def f(x):
        return -(scale * (x - target) ** 2).sum() - 0.1 * (x[0] * x[1]) ** 2, -2 * scale * (x - target) - 0.2 * x[0] * x[1] * np.array([x[1], x[0], 0])

    low, high = np.full(3, -5.0), np.array([5.0, 5.0, 2.0])
    got = optimise.multistart(f, optimise.starts(np.zeros(3), np.ones(3), low, high, 3), low, high)
    assert got.converged and got.x[2] == 2.0
    assert np.allclose(optimise.polish(lambda x: f(x)[0], got.x, low, high), got.x, atol=1e-5)
    draws = optimise.laplace(lambda x: -0.5 * (x**2).sum() * 4, np.zeros(2), 4000)
    assert np.allclose(draws.std(0), 0.5, atol=0.03)
    assert optimise.gate([3, 1, 2, 1], lambda x: x) == 1 and optimise.jackknife_shape(np.ones((4, 2))).tolist() == [[0], [0]]


def test_bands_and_occupations(spark):
    rng = np.random.default_rng(0)
    h0, h1 = rng.normal(size=(2, 2)), rng.normal(size=(2, 2)) * 0.1
    h0 = h0 + h0.T
    rows = [(1, rx, 0, 0, i, j, float(m[i, j])) for rx, m in ((0, h0), (1, h1), (-1, h1.T)) for i in range(2) for j in range(2)]
    cols = "struct_id long, rx int, ry int, rz int, row int, col int, v double"
    s = spark.createDataFrame([(1, 0, 0, 0, i, i, 1.0) for i in range(2)], cols)
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.25, 0.0, 0.0)], "k int, kx double, ky double, kz double")
    got = bands.bands(bands.bloch_sum(spark.createDataFrame(rows, cols), points), bands.bloch_sum(s, points)).toPandas()
    for k, kx in ((0, 0.0), (1, 0.25)):
        m = h0 + h1 * np.exp(2j * np.pi * kx) + h1.T * np.exp(-2j * np.pi * kx)
        assert np.allclose(np.sort(got[got["k"] == k]["energy"]), np.linalg.eigvalsh(m))
    for kind in ("fermi-dirac", "gaussian"):
        e = rng.normal(size=20)
        mu, occ = bands.occupations(e, np.ones(20), 14.0, 0.05, kind)
        assert occ.sum() == pytest.approx(14.0)
    a = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 1.0)], "struct_id long, energy double, weight double")
    b = spark.createDataFrame([(1, 0.5, 1.0), (1, 1.0, 1.0)], "struct_id long, energy double, weight double")
    assert bands.spectrum_distance(a, b).first().distance == pytest.approx(0.25)


def test_harmonics_and_invariants(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5, 3))
    y = basis.harmonics(x, 3)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert np.allclose(y[:, 2], math.sqrt(3 / (4 * math.pi)) * u[:, 2]) and np.allclose(y[:, 3], math.sqrt(3 / (4 * math.pi)) * u[:, 0])
    for deg in range(4):  # the addition theorem
        assert np.allclose((y[:, deg * deg : (deg + 1) ** 2] ** 2).sum(1), (2 * deg + 1) / (4 * math.pi))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    values = []
    for points in (x, x @ q):
        edges = spark.createDataFrame([(0, *map(float, p)) for p in points], "c int, dx double, dy double, dz double")
        a = basis.pooled(edges, "c", 6.0, 2, 2)
        values.append(np.array(a.select(basis.power_spectrum(F.col("a"), 2, 2).alias("p")).first().p))
    assert np.allclose(*values)
    assert basis.admissible(((1, 1), (1, 1))) and not basis.admissible(((1, 1),)) and len(basis.enumerate_bodies(2, 4, 2, 1)) > 3


def test_forces_are_the_slope(spark):
    def energy(pos):
        d = np.linalg.norm(pos[:, None] - pos[None], axis=2)
        return sum(math.exp(-d[i, j]) for i in range(3) for j in range(i))

    pos = np.random.default_rng(2).normal(size=(3, 3))
    rows = [(1, i, j, *map(float, pos[j] - pos[i]), float(np.linalg.norm(pos[j] - pos[i]))) for i in range(3) for j in range(3) if i != j]
    edges = spark.createDataFrame(rows, "cfg int, i int, j int, dx double, dy double, dz double, dist double")
    atoms = spark.createDataFrame([(1, i) for i in range(4)], "cfg int, atom int")
    got = basis.pair_energy_forces(edges, atoms, F.exp(-F.col("dist")), -F.exp(-F.col("dist"))).orderBy("atom").toPandas()
    assert got["e"].sum() == pytest.approx(energy(pos)) and got["fx"][3] == 0
    for i in range(3):
        step = np.zeros((3, 3))
        step[i, 0] = 1e-5
        assert got["fx"][i] == pytest.approx(-(energy(pos + step) - energy(pos - step)) / 2e-5, abs=1e-6)


def test_support_scores(spark):
    from tephra.operators import support

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3)) @ np.diag([3.0, 1.0, 0.2])
    frame = spark.createDataFrame([(i % 30, i, *map(float, r), float(abs(r[0]))) for i, r in enumerate(x)], "g long, i long, a double, b double, c double, s double")
    names = ["a", "b", "c"]
    mean, cov, n = support.moments(frame, names)
    assert n == 300 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))
    t2, q = support.subspace_distances(frame, names, 2)
    got = frame.select("i", t2.alias("t2"), q.alias("q"), support.leverage(frame, names).alias("h")).orderBy("i").toPandas()
    w, v = np.linalg.eigh(np.cov(x.T, bias=True))
    z = (x - x.mean(0)) @ v[:, ::-1]
    assert np.allclose(got["t2"], (z[:, :2] ** 2 / w[::-1][:2]).sum(1)) and np.allclose(got["q"], z[:, 2] ** 2)
    assert got["h"].sum() == pytest.approx(3, abs=1e-4)
    near = {r.key: r.q for r in support.neighbour_quantile(frame.repartition(3), frame.where("i < 5"), names, "s", "i", 20, 0.1).collect()}
    for i in range(5):
        k = np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[:20]
        assert near[i] == pytest.approx(np.sort(np.abs(x[k, 0]))[18])
    shift = frame.withColumn("a", F.col("a") + 2.0)
    beta = support.density_ratio(frame, shift, ["a", "b"], "g", grid=(1e-4, 1.0), folds=2)
    assert beta[1] > 0 and abs(beta[2]) < abs(beta[1])
    assert support.nn_ratio(np.arange(5.0)[:, None], np.array([[10.0]])) == pytest.approx(6.0) and support.nn_ratio(np.ones((3, 1)), np.ones((1, 1))) == 1.0
    q, n_eff = support.shifted_quantile(np.array([3.0, 1.0, 2.0]), np.ones(3), np.array([0.0, 1.0, 100.0]), 0.1)
    assert q.tolist() == [3.0, math.inf, math.inf] and n_eff == pytest.approx(3)
    value, low, high = support.bootstrap(frame, "g", {"e": F.sum("s"), "n": F.count("*")}, lambda e, n: e / n if n else 0.0)
    assert low < value < high and value == pytest.approx(np.abs(x[:, 0]).mean())
    to, centres = support.merge_small({0: 10, 1: 1, 2: 9}, np.array([[0.0], [1.0], [9.0]]), 3)
    assert to == {0: 0, 1: 0, 2: 2} and centres[0, 0] == pytest.approx(1 / 11)
    assert len(support.elbow(frame, ["a"], [1, 2, 4])) >= 1


def test_reference_energies_and_clusters(spark):
    from tephra.operators import support

    rows = [(1, 0, 1, -2.0), (0, 1, 1, None), (2, 1, 3, -7.0), (1, 3, 4, -11.0)]
    got = support.reference_energies(spark.createDataFrame(rows, "h int, o int, n int, e double"), ["h", "o"], "e", "n")
    assert got == pytest.approx({"h": -2.0, "o": -3.0})
    rng = np.random.default_rng(4)
    phi, y = rng.normal(size=(12, 2)), rng.normal(size=12)
    cov = np.linalg.inv(phi.T @ phi + np.eye(2))
    res = y - phi @ cov @ phi.T @ y
    frame = spark.createDataFrame([(i // 3, list(map(float, p)), float(r)) for i, (p, r) in enumerate(zip(phi, res, strict=True))], "k int, phi array<double>, r double")
    for row in support.cluster_scores(frame, "phi", "r", "k", cov).collect():
        out = np.arange(12) // 3 == row.cluster
        m = np.linalg.solve(phi[~out].T @ phi[~out] + np.eye(2), phi[~out].T @ y[~out])
        assert row.press == pytest.approx(((y[out] - phi[out] @ m) ** 2).sum())
    e = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double")
    v = np.array([[2.0, 0.3, 0.1], [0.3, 1.0, 0.2], [0.1, 0.2, 3.0]])
    got = e.select(support.mahalanobis(e, ["x", "y", "z"], [[F.lit(float(a)) for a in r] for r in v]).alias("m")).first().m
    w = v + 1e-3 * np.trace(v) / 3 * np.eye(3)
    assert got == pytest.approx(math.sqrt(np.array([1, 2, 3]) @ np.linalg.solve(w, [1, 2, 3])))
