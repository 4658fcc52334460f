"""Hyperparameters in named blocks with routes, tied noise, profiled inner fits, checks of a fit against rounding, and approximations of its posterior."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np

from tephra.operators.stats import Gram
from tephra.plans.optimise import gradient, laplace, maximise

ROUTES = ("fixed", "lml")


@dataclass(frozen=True)
class Block:
    """Values that are held ('fixed') or optimised ('lml'), with an independent normal prior (centres, widths) or none."""

    name: str
    value: np.ndarray
    route: str
    prior: tuple[np.ndarray, np.ndarray] | None = None


@dataclass(frozen=True)
class Parameters:
    blocks: tuple[Block, ...]

    def __getitem__(self, name: str) -> Block:
        return next(b for b in self.blocks if b.name == name)

    def vector(self, route: str = "lml") -> np.ndarray:
        """The values of a route's blocks, one after another."""
        parts = [np.ravel(b.value) for b in self.blocks if b.route == route]
        return np.concatenate(parts) if parts else np.zeros(0)

    def with_vector(self, x: np.ndarray, route: str = "lml") -> Parameters:
        out, at = [], 0
        for b in self.blocks:
            if b.route == route:
                out.append(replace(b, value=np.reshape(x[at : at + b.value.size], b.value.shape)))
                at += b.value.size
            else:
                out.append(b)
        return Parameters(tuple(out))

    def log_prior(self) -> float:
        """Log density of the optimised blocks that have a prior."""
        total = 0.0
        for b in self.blocks:
            if b.route == "lml" and b.prior is not None:
                z = (np.ravel(b.value) - b.prior[0]) / b.prior[1]
                total += float(-0.5 * z @ z - np.log(b.prior[1]).sum() - 0.5 * len(z) * math.log(2 * math.pi))
        return total


def parse_route(spec: str | Mapping | None) -> dict[str, str]:
    """Block name -> route from a JSON object, a mapping or nothing; an unknown route or other JSON is an error."""
    if not spec:
        return {}
    found = json.loads(spec) if isinstance(spec, str) else spec
    if not isinstance(found, Mapping):
        raise ValueError(f"a route must be an object of block names, not {type(found).__name__}")
    if bad := sorted({str(v) for v in found.values()} - set(ROUTES)):
        raise ValueError(f"unknown routes {bad}; there are {list(ROUTES)}")
    return {str(k): str(v) for k, v in found.items()}


def fit_parameters(hypers: np.ndarray, prior: tuple[np.ndarray, np.ndarray], *, embed: np.ndarray | None = None, n_types: int = 1, sigma_type: bool = False, route: str | Mapping | None = None, width: float = 1.5) -> Parameters:
    """The blocks of a fit: hyperparameters, an embedding if given, and with ``sigma_type`` the log noise ratios of all types but the first (E, F, V each). Routes of blocks that are not there change nothing; a further optimised block beside the ratios is an error."""
    blocks = [Block("hypers", np.asarray(hypers, float), "lml", prior)]
    if embed is not None:
        blocks.append(Block("embed", np.asarray(embed, float), "fixed"))
    if sigma_type and n_types > 1:
        many = 3 * (n_types - 1)
        blocks.append(Block("sigma_type", np.zeros((n_types - 1, 3)), "lml", (np.zeros(many), np.full(many, width))))
    routes = parse_route(route)
    out = Parameters(tuple(replace(b, route=routes.get(b.name, b.route)) for b in blocks))
    others = [b.name for b in out.blocks if b.route == "lml" and b.name not in ("hypers", "sigma_type")]
    if others and any(b.name == "sigma_type" for b in out.blocks):
        raise ValueError(f"blocks {others} cannot be optimised beside sigma_type")
    return out


def type_ratios(parameters: Parameters, n_types: int) -> np.ndarray:
    """(types, 3) log noise ratios; the first type's are 0."""
    found = [b for b in parameters.blocks if b.name == "sigma_type"]
    return np.vstack([np.zeros((1, 3)), found[0].value]) if found else np.zeros((n_types, 3))


def tied(likelihood: Callable[[np.ndarray], tuple[float, np.ndarray]], shared: int, followers: Sequence[int]) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """The likelihood with some coordinates set to a shared one; their gradients move onto it."""

    def f(x: np.ndarray) -> tuple[float, np.ndarray]:
        y = np.array(x, float)
        y[list(followers)] = y[shared]
        value, g = likelihood(y)
        g = np.array(g, float)
        g[shared] += g[list(followers)].sum()
        g[list(followers)] = 0.0
        return value, g

    return f


# profiled fits


def inner_solve(phi: np.ndarray, y: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Least squares with a prior's root below the rows, by QR."""
    q, r = np.linalg.qr(np.vstack([phi, root]))
    return np.linalg.solve(r, q.T @ np.concatenate([y, np.zeros(len(root))]))


def learn(eta0: np.ndarray, statistics: Callable[[np.ndarray], Gram], prior: np.ndarray, *, reach: float = 5.0, steps: int = 100) -> tuple[np.ndarray, float]:
    """(eta, residual): outer parameters of a design whose linear coefficients are profiled out: the squared residual at the inner solution is least.

    ``statistics`` sums the Gram matrix of the design at eta over the rows, in tasks; each value is one such pass.
    """

    def residual(eta: np.ndarray) -> float:
        gram = statistics(eta)
        c = np.linalg.solve(gram.g + np.diag(prior), gram.b)
        return float(gram.yy - 2 * c @ gram.b + c @ gram.g @ c)

    f = lambda eta: (-residual(eta), -gradient(residual, eta, 1e-4))
    found = maximise(f, eta0, np.asarray(eta0) - reach, np.asarray(eta0) + reach, steps=steps, tol=1e-6)
    return found.x, -found.value


def holdout_score(fit: Gram, validation: Mapping[str, Gram], prior: np.ndarray, log_sigma: Mapping[str, float]) -> float:
    """Sum over quantities of the squared error on held-out rows over sigma squared, by the posterior mean of the fit; a quantity without rows is left out."""
    c = np.linalg.solve(fit.g + np.diag(prior), fit.b)
    return float(sum((g.yy - 2 * c @ g.b + c @ g.g @ c) * math.exp(-2 * log_sigma[q]) for q, g in validation.items() if g.n))


def rounding_check(r: np.ndarray, c: np.ndarray, prior: np.ndarray, *, eps: float = 2.0**-24, seed: int = 0, stable: float = 0.01, unstable: float = 0.1) -> dict:
    """How the training residual moves when a QR factor is perturbed at the rounding of single precision: stable, marginal or unstable."""
    rng = np.random.default_rng(seed)
    noise = eps * np.linalg.norm(r, axis=0) / math.sqrt(len(r))
    moved = r + rng.normal(size=r.shape) * noise
    solve = lambda a: np.linalg.solve(a.T @ a + np.diag(prior), a.T @ c)
    error = lambda x: float(np.sqrt(np.mean((r @ x - c) ** 2)))
    base, other = error(solve(r)), error(solve(moved))
    change = abs(other - base) / max(base, 1e-300)
    return {"eps": eps, "change": change, "verdict": "stable" if change <= stable else "marginal" if change <= unstable else "unstable"}


def block_ascent(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x0: np.ndarray, blocks: Sequence[Sequence[int]], low: np.ndarray, high: np.ndarray, *, rounds: int = 10, steps: int = 30, tol: float = 1e-6) -> tuple[np.ndarray, float]:
    """Quasi-Newton ascent by blocks of coordinates in turn, each scaled by its own curvature pairs, until a round gains nothing."""
    x, value = np.clip(np.asarray(x0, float), low, high), -math.inf
    for _ in range(rounds):
        before = value
        for block in blocks:
            at = np.asarray(block)

            def part(z: np.ndarray, at=at, x=x) -> tuple[float, np.ndarray]:
                y = x.copy()
                y[at] = z
                v, g = f(y)
                return v, np.asarray(g)[at]

            found = maximise(part, x[at], low[at], high[at], steps=steps, tol=tol)
            x = x.copy()
            x[at] = found.x
            value = found.value
        if value - before <= tol * max(1.0, abs(value)):
            break
    return x, value


# posteriors of few hyperparameters


def random_walk(log_density: Callable[[np.ndarray], float], x0: np.ndarray, scale: np.ndarray, n: int, *, seed: int = 0, burn: int = 200) -> np.ndarray:
    """Draws by Metropolis steps whose size is tuned until the burn-in ends."""
    rng = np.random.default_rng(seed)
    x, value = np.asarray(x0, float), log_density(x0)
    size, out = 2.4 / math.sqrt(len(x)), []
    for i in range(burn + n):
        new = x + size * scale * rng.normal(size=len(x))
        new_value = log_density(new)
        accepted = math.log(rng.random()) < new_value - value
        if accepted:
            x, value = new, new_value
        if i < burn:
            size *= math.exp((float(accepted) - 0.3) / math.sqrt(i + 1))
        else:
            out.append(x)
    return np.array(out)


def mean_field(log_density: Callable[[np.ndarray], float], x0: np.ndarray, n: int, *, steps: int = 300, seed: int = 0, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(centre, log deviations) of the independent normal nearest to a density, by stochastic steps along numeric gradients."""
    rng = np.random.default_rng(seed)
    mu, log_sd = np.array(x0, float), np.full(len(x0), -2.0)
    m, v = np.zeros(2 * len(mu)), np.zeros(2 * len(mu))
    for i in range(1, steps + 1):
        g = np.zeros(2 * len(mu))
        for _ in range(n):
            e = rng.normal(size=len(mu))
            slope = gradient(log_density, mu + np.exp(log_sd) * e, 1e-4)
            g += np.concatenate([slope, slope * e * np.exp(log_sd) + 1]) / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8) / math.sqrt(1 + i / 50)
        mu, log_sd = mu + step[: len(mu)], log_sd + step[len(mu) :]
    return mu, log_sd


def ladder(log_density: Callable[[np.ndarray], float], best: np.ndarray, rungs: Sequence[str], n: int, seed: int = 0) -> dict[str, np.ndarray]:
    """Draws of each approximation asked for: 'map' (the optimum), 'laplace', 'walk', 'vi'. An unknown one is an error."""
    out = {}
    for rung in rungs:
        if rung == "map":
            out[rung] = np.asarray(best)[None, :]
        elif rung == "laplace":
            out[rung] = laplace(log_density, np.asarray(best, float), n, seed)
        elif rung == "walk":
            spread = laplace(log_density, np.asarray(best, float), 200, seed).std(0)
            out[rung] = random_walk(log_density, best, spread, n, seed=seed)
        elif rung == "vi":
            mu, log_sd = mean_field(log_density, best, 4, seed=seed)
            out[rung] = mu + np.exp(log_sd) * np.random.default_rng(seed).normal(size=(n, len(mu)))
        else:
            raise ValueError(f"unknown approximation {rung!r}")
    return out
