"""Evidence, solves and posteriors of linear models: what is summed over rows comes from tasks, what is as large as the features squared is solved on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tephra.operators.stats import Gram, qr_factors
from tephra.plans.optimise import Result, hessian, maximise, polish

LOG_2PI = math.log(2 * math.pi)


def batch_rows(batch: pd.DataFrame, features: str) -> np.ndarray:
    return np.stack(batch[features].to_numpy()).astype(float) if len(batch) else np.zeros((0, 0))


# priors


@dataclass(frozen=True)
class PriorRoot:
    """R0 = blockdiag(diag(1 / dinv), upper): the prior precision is R0' R0. ``upper`` is a triangle of the trailing columns, or None."""

    dinv: np.ndarray
    upper: np.ndarray | None = None

    def matrix(self) -> np.ndarray:
        n, m = len(self.dinv), 0 if self.upper is None else len(self.upper)
        out = np.zeros((n + m, n + m))
        out[:n, :n] = np.diag(1 / self.dinv)
        if m:
            out[n:, n:] = self.upper
        return out

    def rows(self, x: np.ndarray) -> np.ndarray:
        """X R0^-1 on the last axis."""
        return np.linalg.solve(self.matrix().T, np.reshape(x, (-1, x.shape[-1])).T).T.reshape(x.shape)

    def dual(self, g: np.ndarray) -> np.ndarray:
        """R0^-T G on the first axis."""
        return np.linalg.solve(self.matrix().T, g)

    def primal(self, x: np.ndarray) -> np.ndarray:
        """R0^-1 x: coefficients of a scaled solution."""
        return np.linalg.solve(self.matrix(), x)

    def lift(self, z: np.ndarray) -> np.ndarray:
        """R0' z."""
        return self.matrix().T @ z

    def gram(self, g: np.ndarray) -> np.ndarray:
        """R0^-T G R0^-1."""
        return self.dual(self.dual(g).T).T


def prior_precision(gamma: np.ndarray, log_scale: float, fixed: np.ndarray | None = None) -> np.ndarray:
    """gamma^2 / scale^2 for each readout column, then the fixed columns' own precisions."""
    return np.concatenate([gamma**2 * math.exp(-2 * log_scale), np.asarray([] if fixed is None else fixed, float)])


# solves


def solve_qr(frame: DataFrame, features: str, y: str, w: str, root: np.ndarray) -> np.ndarray:
    """The posterior mean by QR: the rows' merged factor under the prior's triangle. The condition is that of the design, not its square."""
    d = len(root)
    r, c, _ = qr_factors(frame, features, y, w, d)
    q, top = np.linalg.qr(np.vstack([root, r]))
    return np.linalg.solve(top, q.T @ np.concatenate([np.zeros(d), c]))


def posterior_qr(frame: DataFrame, features: str, y: str, w: str, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, lower Cholesky factor of the posterior precision) without forming a Gram matrix."""
    d = len(root)
    r, c, _ = qr_factors(frame, features, y, w, d)
    q, top = np.linalg.qr(np.vstack([root, r]))
    sign = np.where(np.diag(top) < 0, -1.0, 1.0)
    return np.linalg.solve(top, q.T @ np.concatenate([np.zeros(d), c])), (top * sign[:, None]).T


@dataclass(frozen=True)
class Operators:
    """A weighted design with the prior's root below it, never formed: each product is a pass over the rows.

    ``frame`` has rows (features, y, w), written before, as every pass reads them.
    """

    frame: DataFrame
    features: str
    y: str
    w: str
    root: np.ndarray

    def normal(self, x: np.ndarray | None) -> tuple[np.ndarray, float]:
        """(A'A x, |A x|^2), or with None (A'y, |y|^2): what LSQR needs of the rows, as sums that merge."""
        features, y, w, d = self.features, self.y, self.w, len(self.root)

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, square = np.zeros(d), 0.0
            for batch in batches:
                if len(batch):
                    a = batch_rows(batch, features) * batch[w].to_numpy(float)[:, None]
                    u = batch[y].to_numpy(float) * batch[w].to_numpy(float) if x is None else a @ x
                    total, square = total + a.T @ u, square + float(u @ u)
            yield pd.DataFrame({"k": np.arange(-1, d), "v": np.concatenate([[square], total])})

        found = self.frame.select(features, y, w).mapInPandas(part, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").toPandas()["v"].to_numpy()
        found = found if len(found) else np.zeros(d + 1)
        if x is None:
            return found[1:], float(found[0])
        below = self.root @ x
        return found[1:] + self.root.T @ below, float(found[0] + below @ below)


def lsqr(operators: Operators, steps: int = 200, tol: float = 1e-12) -> np.ndarray:
    """Matrix-free least squares by conjugate gradients on the normal equations in product form, the iterates that LSQR has in exact arithmetic.

    A step is one pass over the rows. Vectors as long as the data are never held; they enter by their products alone.
    """
    rhs, _ = operators.normal(None)
    x, r = np.zeros(len(rhs)), rhs
    p, rr = r.copy(), float(r @ r)
    first = rr
    for _ in range(steps):
        if rr <= tol**2 * first or rr == 0:
            break
        q, curvature = operators.normal(p)
        if curvature <= 0:
            break
        alpha = rr / curvature
        x, r = x + alpha * p, r - alpha * q
        new = float(r @ r)
        p, rr = r + new / rr * p, new
    return x


# evidence


@dataclass(frozen=True)
class SvdStatistics:
    """One shared noise: squared singular values of R D^-1, the targets in its left basis, and the fixed-prior columns there."""

    s2: np.ndarray
    c: np.ndarray
    fixed: np.ndarray
    fixed_precision: np.ndarray
    yy: float
    n: int
    logw: float


def svd_statistics(r: np.ndarray, c: np.ndarray, rest: float, n: int, logw: float, gamma: np.ndarray, fixed_precision: np.ndarray | None = None) -> SvdStatistics:
    """From a QR factor whose first columns have precisions gamma^2 and whose last ones fixed precisions."""
    d = len(gamma)
    u, s, _ = np.linalg.svd(r[:, :d] / gamma, full_matrices=True)
    p0 = np.asarray([] if fixed_precision is None else fixed_precision, float)
    return SvdStatistics(s**2, u.T @ c, u.T @ r[:, d:], p0, float(c @ c + rest), n, logw)


def log_evidence_svd(log_sigma: float, log_scale: float, sv: SvdStatistics) -> float:
    """Log evidence at a noise and a prior scale in time linear in the features; the fixed columns are eliminated by their Schur complement."""
    noise, prior = math.exp(-2 * log_sigma), math.exp(-2 * log_scale)
    d = len(sv.s2)
    s2 = np.concatenate([sv.s2, np.zeros(len(sv.c) - d)])
    scale = s2 * noise + prior
    fit = float((s2 * sv.c**2 / scale)[:d].sum()) * noise**2
    logdet = float(np.log(scale[:d]).sum()) + 2 * d * log_scale
    if len(sv.fixed_precision):
        weight = prior * noise / scale
        low = np.linalg.cholesky(np.diag(sv.fixed_precision) + (sv.fixed * weight[:, None]).T @ sv.fixed)
        z = np.linalg.solve(low, sv.fixed.T @ (weight * sv.c))
        fit += float(z @ z)
        logdet += 2 * float(np.log(np.diag(low)).sum()) - float(np.log(sv.fixed_precision).sum())
    return -0.5 * (sv.yy * noise - fit) - 0.5 * (logdet - sv.logw + 2 * sv.n * log_sigma) - 0.5 * sv.n * LOG_2PI


def loo_objective(frame: DataFrame, config: str, features: str, y: str, w: str, mean: np.ndarray, precision: np.ndarray, logtau: float, n: int) -> float:
    """Sum over configurations of the log density of their rows given all others, from one fit: blocks of H = P S^-1 P'.

    A configuration's rows are one task's group; rows of weight 0 do not count.
    """
    inverse = np.linalg.inv(precision)

    def block(part: pd.DataFrame) -> pd.DataFrame:
        part = part[part[w] > 0]
        if not len(part):
            return pd.DataFrame({"v": [0.0]})
        weight = part[w].to_numpy(float)
        p = batch_rows(part, features) * weight[:, None]
        low = np.linalg.cholesky(np.eye(len(p)) - p @ inverse @ p.T)
        u = np.linalg.solve(low, part[y].to_numpy(float) * weight - p @ mean)
        return pd.DataFrame({"v": [float(-0.5 * u @ u + np.log(np.diag(low)).sum())]})

    total = frame.select(config, features, y, w).groupBy(config).applyInPandas(block, "v double").agg(F.sum("v")).first()[0]
    return (total or 0.0) + 0.5 * logtau - 0.5 * n * LOG_2PI


def judge(value: float, g: np.ndarray, h: np.ndarray | None, x: np.ndarray, low: np.ndarray, high: np.ndarray, *, gain_tol: float = 1e-3, grad_tol: float = 1e-3) -> dict:
    """Whether an ascent has ended at a stationary point: by the gain of another Newton step in the free variables if the Hessian is known, else by the projected gradient."""
    free = ~(((x <= low) & (g < 0)) | ((x >= high) & (g > 0)))
    pulled = np.where(free, g, 0.0)
    worst = float(np.abs(pulled).max(initial=0.0)) if np.isfinite(pulled).all() else math.inf
    out = {"value": float(value), "gradient": worst, "gain": None}
    if h is None or not np.isfinite(value) or not np.isfinite(g).all():
        return out | {"converged": bool(np.isfinite(value) and worst <= grad_tol)}
    gain = 0.0
    if free.any():
        eig, v = np.linalg.eigh(-np.asarray(h)[np.ix_(free, free)])
        pull = v.T @ g[free]
        gain = math.inf if (eig <= 0).any() else float(0.5 * (pull**2 / eig).sum())
    return out | {"gain": gain, "converged": bool(gain <= gain_tol)}


# grouped priors


@dataclass(frozen=True)
class GroupedEvidence:
    """Evidence of a linear model whose columns share prior precisions exp(a) gamma^2 by group; group -1 keeps gamma^2. h = (log sigma by quantity, a by group)."""

    grams: Sequence[Gram]
    gamma: np.ndarray
    group: np.ndarray

    @property
    def groups(self) -> list[int]:
        return sorted(set(self.group[self.group >= 0].tolist()))

    def _parts(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        q = len(self.grams)
        noise = np.exp(-2 * h[:q])
        scaled = [g.g / np.outer(self.gamma, self.gamma) for g in self.grams]
        a = dict(zip(self.groups, h[q:], strict=True))
        lam = np.exp([a.get(int(k), 0.0) for k in self.group])
        s = sum(n * m for n, m in zip(noise, scaled, strict=True)) + np.diag(lam)
        b = sum(n * g.b for n, g in zip(noise, self.grams, strict=True)) / self.gamma
        return s, b, lam, scaled

    def value_and_gradient(self, h: np.ndarray) -> tuple[float, np.ndarray]:
        """Log evidence (the weights' constant left out) and its gradient."""
        q = len(self.grams)
        s, b, lam, scaled = self._parts(np.asarray(h, float))
        try:
            low = np.linalg.cholesky(s)
        except np.linalg.LinAlgError:
            return -math.inf, np.zeros(len(h))
        x = np.linalg.solve(low.T, np.linalg.solve(low, b))
        inverse = np.linalg.inv(s)
        noise = np.exp(-2 * np.asarray(h[:q]))
        yy, n = np.array([g.yy for g in self.grams]), np.array([g.n for g in self.grams], float)
        value = -0.5 * (noise @ yy - b @ x) - np.log(np.diag(low)).sum() + 0.5 * np.log(lam).sum() - n @ h[:q] - 0.5 * n.sum() * LOG_2PI
        gradient = np.zeros(len(h))
        for i, (g, m) in enumerate(zip(self.grams, scaled, strict=True)):
            bi = g.b / self.gamma
            residual = yy[i] - 2 * x @ bi + x @ m @ x
            gradient[i] = noise[i] * (residual + np.sum(inverse * m)) - n[i]
        for j, k in enumerate(self.groups):
            at = self.group == k
            gradient[q + j] = 0.5 * (at.sum() - lam[at] @ (np.diag(inverse)[at] + x[at] ** 2))
        return float(value), gradient

    def fit(self, h0: np.ndarray, *, reach: float = 12.0, steps: int = 300) -> Result:
        """Type-II maximum likelihood in a box around h0: quasi-Newton ascent, then Newton steps."""
        h0 = np.asarray(h0, float)
        low, high = h0 - reach, h0 + reach
        begin = self.value_and_gradient(h0)
        scale = max(1.0, float(np.linalg.norm(begin[1])))
        found = maximise(lambda h: tuple(v / scale for v in self.value_and_gradient(h)), h0, low, high, steps=steps)
        x = polish(lambda h: self.value_and_gradient(h)[0], found.x, low, high)
        value, g = self.value_and_gradient(x)
        h = hessian(lambda z: self.value_and_gradient(z)[0], x)
        return Result(x, value, found.steps, judge(value, g, h, x, low, high)["converged"])

    def posterior(self, h: np.ndarray, kappa: float = 1.0) -> GroupedPosterior:
        s, b, _, _ = self._parts(np.asarray(h, float))
        return GroupedPosterior(np.linalg.solve(s, b) / self.gamma, np.linalg.cholesky(s), 1 / self.gamma, kappa, np.asarray(h, float))


@dataclass(frozen=True)
class GroupedPosterior:
    """Mean coefficients, and the lower Cholesky factor of the precision in the prior-scaled system."""

    mean: np.ndarray
    chol: np.ndarray
    dinv: np.ndarray
    kappa: float
    h: np.ndarray

    def covariance(self) -> np.ndarray:
        half = np.linalg.solve(self.chol, np.diag(self.dinv))
        return half.T @ half

    def shape_factor(self, scores: np.ndarray, tau: float = 1.0) -> np.ndarray:
        """R = S^-1 D^-1 (G - mean), cut to the smallest rank that holds a share tau of its energy; one zero column without spread. ``scores`` (features, clusters)."""
        centred = (scores - scores.mean(1, keepdims=True)) * self.dinv[:, None]
        q = np.linalg.solve(self.chol.T, np.linalg.solve(self.chol, centred))
        if q.shape[1] <= q.shape[0] and tau >= 1:
            return q
        u, s, _ = np.linalg.svd(q, full_matrices=False)
        energy = np.cumsum(s**2)
        if not len(energy) or energy[-1] == 0:
            return np.zeros((len(q), 1))
        rank = int(np.searchsorted(energy / energy[-1], min(tau, 1.0) - 1e-12)) + 1
        return u[:, :rank] * s[:rank]


def grouped_predictions(frame: DataFrame, features: str, posterior: GroupedPosterior, factor: np.ndarray | None = None) -> DataFrame:
    """Add ``mu`` and ``std``: kappa times the posterior deviation, or with a shape factor R the norm of R' D^-1 phi times kappa. Rows are served in Arrow batches; the factor is as large as the features squared."""
    half = np.linalg.solve(posterior.chol, np.diag(posterior.dinv)) if factor is None else factor.T * posterior.dinv
    mean, kappa = posterior.mean, posterior.kappa

    @F.pandas_udf("mu double, std double")
    def serve(phi: pd.Series) -> pd.DataFrame:
        x = np.stack(phi.to_numpy()).astype(float) if len(phi) else np.zeros((0, len(mean)))
        return pd.DataFrame({"mu": x @ mean, "std": kappa * np.sqrt(((x @ half.T) ** 2).sum(1))})

    return frame.withColumn("_s", serve(features)).select("*", "_s.mu", "_s.std").drop("_s")


def atom_shapes(frame: DataFrame, rows: str, r: np.ndarray, dinv: np.ndarray) -> DataFrame:
    """Add ``shape``, a 3 x 3 array: V_ab = (R' u_a) (R' u_b) with u = D^-1 phi, from an atom's three force rows."""

    @F.pandas_udf("array<array<double>>")
    def shapes(part: pd.Series) -> pd.Series:
        x = np.array([[list(v) for v in three] for three in part], float).reshape(len(part), 3, -1)
        p = (x * dinv) @ r
        return pd.Series(np.einsum("nar,nbr->nab", p, p).tolist())

    return frame.withColumn("shape", shapes(rows))


def committee(r: np.ndarray, dinv: np.ndarray, species: int, many: int, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """D^-1 R as (species, many-body columns, members) and (species, pair columns, members); columns past the readout go."""
    c = (dinv[:, None] * r)[: species * (many + pairs)]
    return c[: species * many].reshape(species, many, -1), c[species * many :].reshape(species, pairs, -1)


# pointwise corrections


def correction_moments(deltas: DataFrame, delta: str, d: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(E[delta delta'], E[delta], n), summed in tasks."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((d + 1, d)), 0
        for batch in batches:
            if len(batch):
                x = batch_rows(batch, delta)
                total += np.vstack([x.T @ x, x.sum(0)])
                n += len(x)
        yield pd.DataFrame({"i": np.arange(d + 2), "row": [*total.tolist(), [float(n)] * d]})

    rows = deltas.select(delta).mapInPandas(part, "i int, row array<double>").groupBy("i").agg(F.array(*[F.sum(F.col("row")[j]) for j in range(d)]).alias("row")).orderBy("i").collect()
    x = np.array([r["row"] for r in rows]) if rows else np.zeros((d + 2, d))
    n = int(x[d + 1, 0]) if d else 0
    return x[:d] / max(n, 1), x[d] / max(n, 1), n


def box_posterior(deltas: DataFrame, delta: str, d: int, percent: float = 0.0, threshold: float = 1e-8) -> np.ndarray:
    """Second moment about 0 of the uniform box that holds the corrections along their principal axes, from the ``percent`` to the 100 - ``percent`` percentile."""
    moment, _, _ = correction_moments(deltas, delta, d)
    eig, axes = np.linalg.eigh(moment)
    axes = axes[:, eig > threshold * max(eig.max(initial=0.0), 0.0)]
    along = [sum((F.col(delta)[i] * float(axes[i, k]) for i in range(d)), F.lit(0.0)).alias(f"u{k}") for k in range(axes.shape[1])]
    seen = deltas.select(*along)
    ends = [(F.min(f"u{k}"), F.max(f"u{k}")) if percent <= 0 else (F.percentile(f"u{k}", percent / 100), F.percentile(f"u{k}", 1 - percent / 100)) for k in range(axes.shape[1])]
    row = seen.agg(*[e.alias(f"e{k}_{s}") for k, pair in enumerate(ends) for s, e in enumerate(pair)]).first()
    low, high = (np.array([row[f"e{k}_{s}"] for k in range(axes.shape[1])], float) for s in (0, 1))
    middle = (low + high) / 2
    return axes @ (np.diag((high - low) ** 2 / 12) + np.outer(middle, middle)) @ axes.T


def quadratic(features: Column, matrix: np.ndarray) -> Column:
    """phi' M phi of an array column."""
    total = F.lit(0.0)
    for i in range(len(matrix)):
        for j in range(len(matrix)):
            total = total + features[i] * features[j] * float(matrix[i, j])
    return total


def moment_variance(features: Column, moment: np.ndarray, mean: np.ndarray) -> Column:
    """Variance of phi' delta over members known by their moments."""
    shift = sum((features[i] * float(m) for i, m in enumerate(mean)), F.lit(0.0))
    return quadratic(features, moment) - shift * shift


def envelope(frame: DataFrame, features: str, deltas: np.ndarray, block: int = 1024) -> DataFrame:
    """Add ``low`` and ``high``, the least and largest phi' delta over members. Members (rows of ``deltas``) are a bounded committee; rows are served in blocks."""

    @F.pandas_udf("low double, high double")
    def bounds(phi: pd.Series) -> pd.DataFrame:
        out = []
        for a in range(0, len(phi), block):
            shift = np.stack(phi.iloc[a : a + block].to_numpy()).astype(float) @ deltas.T
            out.append(np.column_stack([shift.min(1), shift.max(1)]))
        return pd.DataFrame(np.vstack(out) if out else np.zeros((0, 2)), columns=["low", "high"])

    return frame.withColumn("_e", bounds(features)).select("*", "_e.low", "_e.high").drop("_e")


def select_ridge(scores: Mapping[float, float]) -> float:
    """The ridge of least finite score, the first of equals; the first ridge if no score is finite and there is nothing to judge, an error if all are bad."""
    finite = {k: v for k, v in scores.items() if math.isfinite(v)}
    if finite:
        return min(finite, key=finite.get)
    if any(v is not None and not math.isnan(v) for v in scores.values()):
        raise FloatingPointError("every score is infinite")
    return next(iter(scores))


def explained_variance(gram: np.ndarray, axes: np.ndarray) -> float:
    """Share of a standardised second moment that orthonormal axes explain."""
    return float(np.trace(axes.T @ gram @ axes) / np.trace(gram))


# kernels


def cosine_kernel(x: np.ndarray, points: np.ndarray, length: float, tiny: float = 1e-30) -> np.ndarray:
    """exp(-|x^ - p^|^2 / (2 length^2)) of directions."""
    a, b = (v / np.sqrt((v * v).sum(-1, keepdims=True) + tiny) for v in (x, points))
    return np.exp(-np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0) / (2 * length**2))


def squared_rms(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Mean squared difference by component."""
    return np.maximum((x * x).sum(1)[:, None] + (points * points).sum(1) - 2 * x @ points.T, 0) / x.shape[1]


def matern32_kernel(x: np.ndarray, points: np.ndarray, length: float, tiny: float = 1e-30) -> np.ndarray:
    """(1 + u) e^-u with u = sqrt(3) rms distance / length."""
    u = math.sqrt(3) * np.sqrt(squared_rms(x, points) + tiny) / length
    return (1 + u) * np.exp(-u)


def amplitude(s: np.ndarray, log_a: float, log_alpha: float, log_r0: float, log_eps: float) -> np.ndarray:
    """A e^(-alpha u) / (1 + e^(-(alpha + eps) u)) with u = s - r0, in logarithms."""
    alpha, u = math.exp(log_alpha), s - math.exp(log_r0)
    return np.exp(log_a - alpha * u - np.logaddexp(0, -(alpha + math.exp(log_eps)) * u))


def kernel(theta: Mapping[str, float], kind: str, left: tuple[np.ndarray, np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray, np.ndarray], embed: np.ndarray, bump: bool = False, floor: float | None = None) -> np.ndarray:
    """Kernel of sites (descriptor, summary, species): amplitude of both summaries, similarity of descriptors, product of species embeddings, and a smooth magnitude factor with ``bump``."""
    (x, s, z), (p, sp, zp) = left, right
    length = math.exp(theta["log_ell"])
    if kind not in ("cosine", "matern32"):
        raise ValueError(f"unknown kernel {kind!r}")
    similar = cosine_kernel(x, p, length) if kind == "cosine" else matern32_kernel(x, p, length)
    if floor is not None:
        s, sp = np.maximum(s, floor), np.maximum(sp, floor)
    heights = [amplitude(v, *(theta[f"log_{k}"] for k in ("A", "alpha", "r0", "eps"))) for v in (s, sp)]
    out = np.outer(*heights) * similar * (embed[z] @ embed[zp].T)
    return out * np.exp(-squared_rms(x, p) / (2 * math.exp(2 * theta["log_rho"]))) if bump else out


def inducing_gram(theta: Mapping[str, float], kind: str, points: tuple[np.ndarray, np.ndarray, np.ndarray], embed: np.ndarray, jitter: float = 1e-8, **options) -> np.ndarray:
    """Kernel matrix of the inducing points, symmetric, with a jitter of its mean diagonal."""
    k = kernel(theta, kind, points, points, embed, **options)
    k = (k + k.T) / 2
    return k + jitter * np.diag(k).mean() * np.eye(len(k))


def kernel_rows(frame: DataFrame, x: str, s: str, z: str, theta: Mapping[str, float], kind: str, points: tuple[np.ndarray, np.ndarray, np.ndarray], embed: np.ndarray, **options) -> DataFrame:
    """Add ``k``: each site's kernel with the inducing points, a bounded set that goes with the function."""

    @F.pandas_udf("array<double>")
    def rows(xs: pd.Series, ss: pd.Series, zs: pd.Series) -> pd.Series:
        if not len(xs):
            return pd.Series([], dtype=object)
        site = np.stack(xs.to_numpy()).astype(float), ss.to_numpy(float), zs.to_numpy(int)
        return pd.Series(list(kernel(theta, kind, site, points, embed, **options)))

    return frame.withColumn("k", rows(x, s, z))


def select_inducing(frame: DataFrame, key: str, species: str, vector: str, m: int, scale: Sequence[float]) -> DataFrame:
    """Up to m sites of each species, farthest from each other in scaled descriptors, from the least key on; sites whose descriptor is 0 are left out."""
    from tephra.operators.curation import farthest_points

    scaled = F.transform(F.arrays_zip(F.col(vector).alias("v"), F.array(*[F.lit(float(v)) for v in scale]).alias("w")), lambda e: e["v"] * e["w"])
    live = frame.where(F.exists(vector, lambda v: v != 0)).select(key, species, scaled.alias("_x"))
    return farthest_points(live, key, "_x", m, [species])


def radial_second_moment(frame: DataFrame, by: Sequence[str], basis: Sequence[Column], prior: Mapping[tuple, np.ndarray] | None = None) -> dict[tuple, np.ndarray]:
    """Mean second moment of the radial basis by species pair, with prior samples (rows of basis values) counted beside the edges."""
    n = len(basis)
    sums = [F.sum(basis[i] * basis[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]
    out = {}
    for r in frame.groupBy(*by).agg(F.count("*").alias("n"), *sums).collect():
        g, count = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]), r["n"]
        extra = (prior or {}).get(tuple(r[b] for b in by), np.zeros((0, n)))
        out[tuple(r[b] for b in by)] = (g + extra.T @ extra) / (count + len(extra))
    return out


def roughness(w: np.ndarray, d2: np.ndarray, weights: np.ndarray) -> float:
    """Sum over radial functions of weight times W' D2 W."""
    return float(np.einsum("...nq,qp,...np,n->", w, d2, w, weights))
