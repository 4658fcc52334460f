"""Drift and outlier scores: density ratios, conformal quantiles under shift, nearest-neighbour scales, subspace distances, clusters, block intervals."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tephra.operators.ordered import hash_share
from tephra.operators.stats import gram_entries, gram_of, kmeans, logistic


def moments(frame: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance (population) and rows, from one aggregation."""
    gram = gram_of(gram_entries(frame, [F.lit(1.0), *map(F.col, features)], F.lit(0.0), F.lit(1.0)).first(), len(features) + 1)
    n = max(gram.n, 1)
    mean = gram.g[0, 1:] / n
    return mean, gram.g[1:, 1:] / n - np.outer(mean, mean), gram.n


def quadratic(features: Sequence[str], mean: np.ndarray, inverse: np.ndarray) -> Column:
    """(x - mean)' inverse (x - mean) as an expression."""
    centred = [F.col(f).cast("double") - float(m) for f, m in zip(features, mean, strict=True)]
    out = F.lit(0.0)
    for i, a in enumerate(centred):
        for j, b in enumerate(centred):
            out = out + a * b * float(inverse[i, j])
    return out


def subspace_distances(train: DataFrame, features: Sequence[str], rank: int) -> tuple[Column, Column]:
    """(T2, Q) of a principal subspace: the scaled distance inside, the squared distance to it."""
    mean, cov, _ = moments(train, features)
    w, v = np.linalg.eigh(cov)
    w, v = w[::-1], v[:, ::-1]
    inside = (v[:, :rank] / np.maximum(w[:rank], 1e-300)) @ v[:, :rank].T
    outside = np.eye(len(features)) - v[:, :rank] @ v[:, :rank].T
    return quadratic(features, mean, inside), quadratic(features, mean, outside)


def leverage(train: DataFrame, features: Sequence[str], ridge: float = 1e-6) -> Column:
    """x' (X'X + ridge)^-1 x."""
    gram = gram_of(gram_entries(train, list(map(F.col, features)), F.lit(0.0), F.lit(1.0)).first(), len(features))
    return quadratic(features, np.zeros(len(features)), np.linalg.inv(gram.g + ridge * np.eye(len(features))))


def density_ratio(calibration: DataFrame, test: DataFrame, features: Sequence[str], group: str, grid: Sequence[float] = (1e-3, 1e-2, 1e-1, 1.0), folds: int = 5, seed: int = 0) -> np.ndarray:
    """Coefficients of the log ratio of test to calibration density: class-balanced logistic regression, the penalty chosen by grouped folds."""
    both = calibration.select(group, *features).withColumn("y", F.lit(0)).unionByName(test.select(group, *features).withColumn("y", F.lit(1)))
    sizes = {r["y"]: r["n"] for r in both.groupBy("y").agg(F.count("*").alias("n")).collect()}
    weighed = both.withColumn("w", F.when(F.col("y") == 1, 0.5 / max(sizes.get(1, 0), 1)).otherwise(0.5 / max(sizes.get(0, 0), 1)))
    weighed = weighed.withColumn("fold", F.floor(hash_share(F.col(group), seed) * folds))

    def loss(beta: np.ndarray, rows: DataFrame) -> float:
        eta = F.lit(float(beta[0]))
        for b, f in zip(beta[1:], features, strict=True):
            eta = eta + F.col(f) * float(b)
        sign = F.when(F.col("y") == 1, -eta).otherwise(eta)
        return rows.agg(F.sum(F.col("w") * F.log1p(F.exp(sign)))).first()[0] or 0.0

    def held_out(l2: float) -> float:
        return sum(loss(logistic(weighed.where(F.col("fold") != k), features, "y", "w", l2), weighed.where(F.col("fold") == k)) for k in range(folds))

    best = min(grid, key=held_out)
    return logistic(weighed, features, "y", "w", best)


def shifted_quantile(scores: np.ndarray, weights: np.ndarray, test_weight: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """For each test weight p: the first score whose weight below, over the total plus p, reaches 1 - alpha, else infinity; and the effective sample size."""
    order = np.argsort(scores, kind="stable")
    s, cum = scores[order], np.cumsum(weights[order])
    total = cum[-1] if len(cum) else 0.0
    at = np.searchsorted(cum, (1 - alpha - 1e-15) * (total + np.asarray(test_weight)))
    q = np.where(at < len(s), s[np.minimum(at, max(len(s) - 1, 0))] if len(s) else np.inf, np.inf)
    return q, float(total**2 / (weights**2).sum()) if len(weights) and (weights**2).sum() > 0 else 0.0


def neighbour_quantile(calibration: DataFrame, test: DataFrame, features: Sequence[str], score: str, key: str, k: int, alpha: float) -> DataFrame:
    """(key, q): the conformal quantile over the k nearest calibration rows of each test row.

    The test rows are a stated set that goes out in one block; every calibration row meets each, and partial results keep k.
    """
    queries = test.select(key, *features).collect()
    ids = np.array([r[key] for r in queries])
    points = np.array([[float(r[f]) for f in features] for r in queries]).reshape(len(queries), len(features))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best_d, best_s = np.full((len(ids), 0), np.inf), np.full((len(ids), 0), np.inf)
        for batch in batches:
            x = batch[list(features)].to_numpy(float)
            d = ((points[:, None, :] - x[None]) ** 2).sum(2)
            best_d, best_s = np.hstack([best_d, d]), np.hstack([best_s, np.broadcast_to(batch[score].to_numpy(float), d.shape)])
            keep = np.argsort(best_d, 1, kind="stable")[:, :k]
            best_d, best_s = np.take_along_axis(best_d, keep, 1), np.take_along_axis(best_s, keep, 1)
        for i, name in enumerate(ids):
            if best_d.shape[1]:
                yield pd.DataFrame({"key": name, "d": best_d[i], "s": best_s[i]})

    def quantile(part: pd.DataFrame) -> pd.DataFrame:
        s = np.sort(part.sort_values(["d", "s"])["s"].to_numpy()[:k])
        at = math.ceil((1 - alpha) * (len(s) + 1) - 1e-9) - 1
        return pd.DataFrame({"key": [part["key"].iloc[0]], "q": [s[at] if at < len(s) else math.inf]})

    kind = dict(test.dtypes)[key]
    found = calibration.select(*features, score).mapInPandas(nearest, f"key {kind}, d double, s double")
    return found.groupBy("key").applyInPandas(quantile, f"key {kind}, q double")


def nn_ratio(train: np.ndarray, query: np.ndarray, q: float = 0.95) -> float:
    """q-quantile of the distance of queries to their nearest training row, over the median spacing of distinct training rows; 1 if none are distinct."""
    def nearest(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
        d = np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0))
        return np.where(d > least, d, np.inf).min(1)

    spacing = nearest(train, train, 1e-9 * max(np.abs(train).max(initial=0), 1))
    spacing = spacing[np.isfinite(spacing)]
    return float(np.quantile(nearest(query, train, -1.0), q) / np.median(spacing)) if len(spacing) else 1.0


def reference_energies(frame: DataFrame, counts: Sequence[str], energy: str, size: str) -> dict[str, float]:
    """Energy of each species: the mean of its isolated atoms where there are any, least squares over the other configurations for the rest."""
    alone = frame.where((F.col(size) == 1) & F.col(energy).isNotNull())
    fixed = alone.agg(*[F.avg(F.when(F.col(c) == 1, F.col(energy))).alias(c) for c in counts]).first().asDict()
    free = [c for c in counts if fixed[c] is None]
    known = {c: v for c, v in fixed.items() if v is not None}
    if not free:
        return known
    rest = F.col(energy)
    for c, v in known.items():
        rest = rest - F.col(c) * float(v)
    gram = gram_of(gram_entries(frame.where(F.col(energy).isNotNull() & (F.col(size) > 1)), list(map(F.col, free)), rest, F.lit(1.0)).first(), len(free))
    return known | dict(zip(free, np.linalg.lstsq(gram.g, gram.b, rcond=None)[0].tolist(), strict=True))


def cluster_scores(frame: DataFrame, features: str, target: str, cluster: str, cov: np.ndarray) -> DataFrame:
    """(cluster, leverage, press, g): delete-one-cluster residuals, squared, and their pull on the coefficients, g = Phi' (I - H)^-1 r.

    ``target`` is the residual of the full fit. A cluster is solved in one task, so clusters are of bounded size.
    """
    def solve(part: pd.DataFrame) -> pd.DataFrame:
        phi, r = np.stack(part[features].to_numpy()).astype(float), part[target].to_numpy(float)
        h = phi @ cov @ phi.T
        left_out = np.linalg.solve(np.eye(len(h)) - h, r)
        return pd.DataFrame({"cluster": [part[cluster].iloc[0]], "leverage": [float(np.linalg.eigvalsh(h)[-1])], "press": [float(left_out @ left_out)], "g": [(phi.T @ left_out).tolist()]})

    kind = dict(frame.dtypes)[cluster]
    return frame.groupBy(cluster).applyInPandas(solve, f"cluster {kind}, leverage double, press double, g array<double>")


def sandwich(cov: np.ndarray, g: np.ndarray) -> np.ndarray:
    """A root of the cluster sandwich covariance: cov (G - mean)'."""
    return cov @ (g - g.mean(0)).T


def elbow(frame: DataFrame, features: Sequence[str], ks: Sequence[int], gain: float = 0.1, seed: int = 0) -> np.ndarray:
    """k-means centres for the first k whose next k cuts the inertia by less than ``gain`` of the first inertia; the last k if none. Starts are seeded rows."""
    begin = frame.select(*features).orderBy(F.xxhash64(F.lit(seed), *features)).limit(max(ks)).collect()
    rows = np.array([[float(v) for v in r] for r in begin])
    fits = []
    for k in sorted(k for k in ks if k <= len(rows)):
        fits.append(kmeans(frame, features, rows[:k].copy()))
        if len(fits) > 1 and (fits[-2][1] - fits[-1][1]) / max(fits[0][1], 1e-300) < gain:
            return fits[-2][0]
    return fits[-1][0]


def merge_small(sizes: dict[int, int], centres: np.ndarray, least: int) -> tuple[dict[int, int], np.ndarray]:
    """(where each cluster goes, centres) when those under ``least`` rows join the nearest other, smallest first; a merged centre is the mean of its rows."""
    to, sizes, centres = {k: k for k in sizes}, dict(sizes), np.array(centres, float)
    while len(sizes) > 1 and min(sizes.values()) < least:
        small = min(sizes, key=lambda k: (sizes[k], k))
        near = min((k for k in sizes if k != small), key=lambda k: (((centres[k] - centres[small]) ** 2).sum(), k))
        a, b = sizes[near], sizes.pop(small)
        centres[near] = (a * centres[near] + b * centres[small]) / (a + b)
        sizes[near] = a + b
        to = {k: near if v == small else v for k, v in to.items()}
    return to, centres


def bootstrap(frame: DataFrame, block: str, sums: dict[str, Column], statistic, n: int = 200, seed: int = 0) -> tuple[float, float, float]:
    """(value, 2.5 %, 97.5 %) of a function of sums, blocks drawn anew n times. Blocks are summed first; each draw weighs them by a Poisson number from a hash, in the tasks."""
    parts = frame.groupBy(block).agg(*[c.alias(k) for k, c in sums.items()])
    names = list(sums)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, whole = np.zeros((n, len(names))), np.zeros(len(names))
        for batch in batches:
            x = batch[names].to_numpy(float)
            draws = np.stack([np.random.default_rng([seed, zlib.crc32(str(key).encode())]).poisson(1.0, n) for key in batch[block]])
            total += draws.T @ x
            whole += x.sum(0)
        yield pd.DataFrame({"i": np.arange(-1, n), "s": np.vstack([whole, total]).tolist()})

    rows = parts.mapInPandas(draw, "i int, s array<double>").select("i", *[F.col("s")[j].alias(k) for j, k in enumerate(names)]).groupBy("i").agg(*[F.sum(k).alias(k) for k in names]).orderBy("i").collect()
    values = [statistic(*[r[k] for k in names]) for r in rows]
    return values[0], float(np.quantile(values[1:], 0.025)), float(np.quantile(values[1:], 0.975))


def mahalanobis(frame: DataFrame, errors: Sequence[str], shape: Sequence[Sequence[Column]], eps: float = 1e-3) -> Column:
    """sqrt(e' (V + eps tr(V) / 3 I)^-1 e) of three errors and a 3 x 3 matrix of columns, by the adjugate."""
    trace = shape[0][0] + shape[1][1] + shape[2][2]
    v = [[shape[i][j] + (eps * trace / 3 if i == j else F.lit(0.0)) for j in range(3)] for i in range(3)]
    minor = lambda i, j: v[(i + 1) % 3][(j + 1) % 3] * v[(i + 2) % 3][(j + 2) % 3] - v[(i + 1) % 3][(j + 2) % 3] * v[(i + 2) % 3][(j + 1) % 3]
    det = sum(v[0][j] * minor(0, j) for j in range(3))
    e = [F.col(c) for c in errors]
    total = F.lit(0.0)
    for i in range(3):
        for j in range(3):
            total = total + e[i] * e[j] * minor(j, i)
    return F.sqrt(total / det)
