"""Every query against its SQL on the smallest tables, and the solvers against numpy."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tephra.functions import radial
from tephra.operators import conformal, curation, metrics, neighbours, ordered, reports, stats
from tephra.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        if isinstance(x, (float, np.floating)):
            return float(x)
        return int(x) if isinstance(x, (int, np.integer, np.bool_)) else str(x)

    found = [tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)]
    return sorted(found, key=lambda r: [(x is None, isinstance(x, str), x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, con, name):
    got = QUERIES[name](spark, folder).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = con.execute(ORACLES[name]).df()
    a, b = rows_of(got), rows_of(want)
    assert sorted(got.columns) == sorted(want.columns) and len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or (isinstance(u, float) and u == pytest.approx(v, rel=1e-6, abs=1e-6)), (x, y)


@pytest.fixture(scope="module")
def line(spark, folder):
    return spark.read.parquet(f"{folder}/lineitem.parquet")


def phi():
    return [F.lit(1.0), F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")]


def test_gram_qr_and_evidence_agree(line):
    y, w = F.col("l_extendedprice") / 1000, 1.0 / F.col("l_linenumber")
    gram = stats.gram_of(stats.gram_entries(line, phi(), y, w).first(), 4)
    frame = line.select(F.array(*[p.cast("double") for p in phi()]).alias("phi"), y.alias("y"), w.alias("w"))
    r, c, rest = stats.qr_factors(frame.repartition(40), "phi", "y", "w", 4)
    assert np.allclose(r.T @ r, gram.g) and np.allclose(r.T @ c, gram.b) and np.isclose(c @ c + rest, gram.yy)
    prior = np.full(4, 0.1)
    total, logtau = stats.combine([gram], [0.3])
    a = stats.log_evidence(total, prior, logtau)
    s = math.exp(0.3)
    assert a == pytest.approx(stats.log_evidence_qr(r / s, c / s, rest / s**2, gram.n, prior, logtau), rel=1e-9)


def test_press_is_leaving_one_out(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 2))
    target = x @ [1.0, -2.0] + rng.normal(size=12)
    frame = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, target, strict=True)], "a double, b double, y double")
    prior = np.array([0.1, 0.1])
    gram = stats.gram_of(stats.gram_entries(frame, [F.col("a"), F.col("b")], F.col("y"), F.lit(1.0)).first(), 2)
    mean, cov = stats.posterior(gram, prior)
    got = stats.leave_one_out(frame, [F.col("a"), F.col("b")], F.col("y"), mean, cov).toPandas()
    for i in range(12):
        keep = np.arange(12) != i
        m = np.linalg.solve(x[keep].T @ x[keep] + np.diag(prior), x[keep].T @ target[keep])
        row = got[np.isclose(got["y"], target[i])].iloc[0]
        assert row["press"] == pytest.approx(target[i] - x[i] @ m, rel=1e-6)


def test_periodic_edges_match_brute_force(spark):
    rng = np.random.default_rng(3)
    cell = np.array([[4.0, 0, 0], [1.0, 3.5, 0], [0.5, 0.2, 5.0]])
    pos = rng.random((6, 3)) @ cell
    atoms = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(pos)], "cfg int, atom int, x double, y double, z double")
    for pbc in ([True, True, True], [True, False, True], [False, False, False]):
        cells = spark.createDataFrame([(1, cell.tolist(), pbc)], "cfg int, a array<array<double>>, pbc array<boolean>")
        got = {(r.i, r.j, r.sx, r.sy, r.sz) for r in neighbours.periodic_edges(atoms, cells, 3.0).collect()}
        reach = [range(-3, 4) if p else (0,) for p in pbc]
        want = {(i, j, a, b, c) for i in range(6) for j in range(6) for a in reach[0] for b in reach[1] for c in reach[2] if (i != j or a or b or c) and np.linalg.norm(pos[j] + np.array([a, b, c]) @ cell - pos[i]) < 3.0}
        assert got == want


def test_farthest_points_match_a_loop(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 3))
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k int, v array<double>")
    got = [r.k for r in curation.farthest_points(frame, "k", "v", 6).orderBy("pick").collect()]
    want, d = [0], ((x - x[0]) ** 2).sum(1)
    while len(want) < 6:
        want.append(int(d.argmax()))
        d = np.minimum(d, ((x - x[want[-1]]) ** 2).sum(1))
    assert got == want
    same = spark.createDataFrame([(i, [1.0]) for i in range(4)], "k int, v array<double>")
    assert curation.farthest_points(same, "k", "v", 3).count() == 1


def test_spline_interpolates(spark):
    values = [math.sin(i / 3) for i in range(10)]
    c = radial.spline_coefficients(values, 0.5)
    got = spark.range(10).select(radial.spline(F.col("id") * 0.5, c, 0.0, 0.5).alias("s")).toPandas()["s"]
    assert np.allclose(got, values)


def test_crps_of_a_perfect_mean(spark):
    got = spark.range(1).select(metrics.crps(F.lit(0.0), F.lit(0.0), F.lit(2.0)).alias("c")).first().c
    assert got == pytest.approx(2 * (2 / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi)))


def test_empty_tables(spark, line):
    none = line.limit(0)
    assert metrics.spearman(none, "l_tax", "l_quantity").first().rho is None
    assert reports.recall_top(none, "l_tax", "l_quantity", 0.9, 0.9).first().recall is None
    assert ordered.pareto_front(none, "l_tax", "l_quantity").count() == 0
    assert conformal.weighted_quantile(none.withColumn("w", F.lit(1.0)), "l_tax", "w", "l_orderkey", 0.1, ["l_returnflag"]).count() == 0


def test_quantile_of_small_groups_is_infinite(spark):
    frame = spark.createDataFrame([(1, i, float(i), 1.0) for i in range(5)], "g int, cfg int, s double, w double")
    assert conformal.weighted_quantile(frame, "s", "w", "cfg", 0.1, ["g"]).first().q == math.inf
    assert conformal.effective_n_min(5, 0.1) == 9 and conformal.transfer_exponent(1, 1, 1, 1) == 0.5


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=200)
    y = (rng.random(200) < 1 / (1 + np.exp(-(0.5 + 2 * x)))).astype(int)
    frame = spark.createDataFrame([(float(a), int(b), 1.0) for a, b in zip(x, y, strict=True)], "x double, y int, w double")
    b = stats.logistic(frame, ["x"], "y", "w")
    p = 1 / (1 + np.exp(-(b[0] + b[1] * x)))
    assert np.allclose([(y - p).sum() - 1e-8 * b[0], ((y - p) * x).sum() - 1e-2 * b[1]], 0, atol=1e-6)


def test_lookup_and_cheapest_take_every_row(spark, folder):
    keys = {r.k for r in QUERIES["label_cache_lookup"](spark, folder).collect()}
    assert keys == {r.c_custkey for r in spark.read.parquet(f"{folder}/customer.parquet").collect()}
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").toPandas()
    rows = rows[(rows["l_discount"] <= 0.03) & (rows["l_tax"] <= 0.05)].assign(family=rows["l_suppkey"] % 5, p=rows["l_orderkey"] * 10 + rows["l_linenumber"])
    want = rows.sort_values(["l_extendedprice", "p"]).groupby("family")["p"].first().to_dict()
    assert {r.family: r.best for r in QUERIES["min_by_with_reason"](spark, folder).collect()} == want


def test_nearest_may_be_another_query(spark, tmp_path):
    rows = [(0, [0.0, 0.0], 1), (100, [0.0, 1.0], 1), (200, [9.0, 9.0], 2), (300, [9.0, 9.0], 2), (1, [0.0, 5.0], 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.d2 for r in QUERIES["nn_distance"](spark, str(tmp_path)).collect()}
    assert got == {0: 1.0, 100: 1.0, 200: 0.0, 300: 0.0}
    assert {r.label: r.novelty for r in QUERIES["score_novelty"](spark, str(tmp_path)).collect()} == {1: 1.0, 2: 0.0}


def test_lookup_keeps_repeated_rows_and_takes_the_nearest(spark):
    cache = spark.createDataFrame([(1, 7, 0.0, 10), (2, 7, 1.5, 20), (3, 7, 3.0, 30), (3, 8, 3.0, 31), (None, None, 1.0, 40)], "k int, b int, v double, label int")
    wanted = spark.createDataFrame([(1, 9, 5.0), (9, 7, 0.75), (9, 7, 0.75), (8, 7, 2.6), (7, 7, 9.0), (None, None, 1.1), (3, 0, 0.0)], "k int, b int, v double")
    got = sorted(tuple(-1 if x is None else x for x in r) for r in curation.lookup(wanted, cache, "k", "b", "v", "label", 1.0).collect())
    assert got == sorted([(1, 9, 5.0, 10), (9, 7, 0.75, 10), (9, 7, 0.75, 10), (8, 7, 2.6, 30), (7, 7, 9.0, -1), (-1, -1, 1.1, -1), (3, 0, 0.0, 30)])


def test_repeated_incoming_keys(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(2, "b", 1), (2, "c", 0), (2, "c", 0), (1, "d", 5)], "k int, v string, at int")
    assert sorted(map(tuple, curation.insert_if_absent(old, new, ["k"], ["at"]).collect())) == [(1, "a"), (2, "c")]
    assert sorted(map(tuple, curation.upsert(old, new, ["k"], ["at"]).collect())) == [(1, "d"), (2, "b")]


def test_content_key_rounds_and_has_no_negative_zero(spark):
    rows = spark.createDataFrame([("a", 1.00000001, -0.0), ("a", 1.0, 0.0), ("a", 1.00001, 0.0), ("a", None, 0.0)], "s string, x double, y double")
    keys = [r.k for r in rows.select(curation.content_key(F.col("s"), numbers=[F.col("x"), F.col("y")]).alias("k")).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3


def test_small_strata_join_the_next_lower(spark):
    frame = spark.createDataFrame([(i, s) for i, s in enumerate([0] * 10 + [2] + [3] * 5 + [6] + [7])], "k int, s int")
    merged = {r.s: r.merged for r in ordered.merge_strata(frame, "s").collect()}
    assert merged == {0: 0, 2: 0, 3: 3, 6: 6, 7: 6}
    lone = spark.createDataFrame([(0, 1), (1, 2)], "k int, s int")
    assert {r.merged for r in ordered.merge_strata(lone, "s").collect()} == {1}
    held = ordered.stratified_split(frame, "s", "k", 0.2, merge=True)
    assert held.where("held").count() == 2 + 1 + 1 and held.columns == ["k", "s", "held"]


def test_scales_are_borrowed_and_pooled(spark):
    rng = np.random.default_rng(6)
    rows = [(int(c), int(g), float(abs(rng.normal()) * (1 + g))) for g, n in ((0, 60), (1, 4), (2, 3), (5, 2)) for c in range(n) for _ in range(2)]
    frame = spark.createDataFrame(rows, "cfg int, grp int, s double")
    got = {r.grp: r for r in conformal.group_table(frame, "s", "cfg", "grp", 0.1, 10).collect()}
    assert {g: r.source for g, r in got.items()} == {0: 0, 1: 0, 2: 0, 5: 0} and got[1].q == got[0].q and got[5].n_atom == 4
    pooled = {r.grp: r for r in conformal.group_table(frame, "s", "cfg", "grp", 0.1, 1000).collect()}
    s, w = np.array([r[2] for r in rows]), np.full(len(rows), 0.5)
    assert all(r.source == -1 and r.lam == pytest.approx(np.sqrt((w * s**2).sum() / (3 * w.sum()))) for r in pooled.values())
    assert pooled[0].r == pytest.approx(pooled[0].q / (pooled[0].lam * 2.5002777108094003))


def test_searches_in_blocks_and_sums_by_group(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 3))
    frame = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "k int, v array<double>")
    got = {r.k: r.nn for r in neighbours.nearest(frame.where("k % 3 = 0"), frame, "k", "k", "v", others=True, block=6).collect()}
    d = ((x[:, None] - x) ** 2).sum(2) + np.diag(np.full(60, np.inf))
    assert got == {i: int(d[i].argmin()) for i in range(0, 60, 3)}
    rows = [(g, float(i), int(rng.integers(1, 9))) for g in ("a", "b", None) for i in rng.permutation(40)]
    table = spark.createDataFrame(rows, "g string, o double, n int").repartition(5)
    sums = {(r.g, r.o): r.upto for r in ordered.running(table, "o", "n", "upto", ["g"]).collect()}
    assert sums == {(g, o): sum(n for h, p, n in rows if h == g and p <= o) for g, o, _ in rows}


def test_factors_merge_in_tasks(spark, line):
    frame = line.select(F.array(*[p.cast("double") for p in phi()]).alias("phi"), (F.col("l_extendedprice") / 1e4).alias("y"), F.lit(1.0).alias("w"))
    one, many = (stats.qr_factors(frame.repartition(n), "phi", "y", "w", 4) for n in (1, 300))
    assert all(np.allclose(a, b) for a, b in zip(one, many, strict=True))


def test_significant_digits_of_ties(spark, tmp_path):
    prices = [float(f"{n}5e{e}") for n in range(100, 1000, 3) for e in (-1, 0, 1, 2)] + [1015.0, 101500.0, 1225.0, 124500.0, 1000.0, 999.5, 0.01]
    spark.createDataFrame(list(enumerate(prices)), "o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    db = duckdb.connect()
    db.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    got = {r.o_orderkey: r.s for r in QUERIES["sig_round"](spark, str(tmp_path)).collect()}
    assert got == dict(db.execute(ORACLES["sig_round"]).fetchall()) and got[len(prices) - 6] == 101000.0
    x = np.array(prices)
    scale = 10 ** np.floor(np.log10(x))
    assert [got[i] for i in range(len(x))] == np.round(np.round(x / scale, 2) * scale, 6).tolist()
    odd = spark.createDataFrame([(0.0,), (-2.25,), (None,)], "x double").select(reports.sig_round(F.col("x"), 2).alias("s"))
    assert [r.s for r in odd.collect()] == [0.0, -2.2, None]
