"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Statistics of every text are computed once and written (a few hundred bytes a document). Tasks sum the normal equations
of their rows; the sums are added up row by row of the matrix, so the driver only sees one matrix of ``n_features``
squared. Cosines of seeded random projections approximate a Gaussian kernel. A part of the labelled rows, chosen by a
hash, is left out of the fit and calibrates its raw scores.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tephra.llm.calibrate import Curve, fit_curve
from tephra.session import tidy, written

SYMBOLS = b"!#$%&*|?.,;:-_/\\\"'()[]{}<>@=+~^`"
#: Indicator of byte classes; a text's byte counts times this are its character statistics.
CLASSES = np.zeros((256, 8 + len(SYMBOLS)))
CLASSES[[*range(65, 91)], 0] = CLASSES[[*range(97, 123)], 1] = CLASSES[[*range(48, 58)], 2] = CLASSES[32, 3] = CLASSES[10, 4] = CLASSES[128:, 5] = 1
CLASSES[[*range(0, 9), *range(11, 32), 127], 6] = CLASSES[9, 7] = 1
for _i, _c in enumerate(SYMBOLS):
    CLASSES[_c, 8 + _i] = 1


def statistics(text: str | None) -> np.ndarray:
    """Statistics of one text, all of them near 0 to 1; of null and empty texts all are 0."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts @ CLASSES / max(n, 1)
    p = counts[counts > 0] / max(n, 1)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    k = max(len(words), 1)
    distinct = set(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    repeated = sum(map(bytes.__eq__, words, words[1:])) / k
    ends = bytes(w[-1] for w in words)
    ends_share = np.bincount(np.frombuffer(ends, np.uint8), minlength=256) @ CLASSES / k
    more = [
        math.log1p(n) / 16,
        math.log1p(len(words)) / 14,
        -(p * np.log2(p)).sum() / 8 if n else 0.0,
        lengths.mean() / 16 if len(words) else 0.0,
        lengths.std() / 16 if len(words) else 0.0,
        min(int(lengths.max(initial=0)), 256) / 256,
        len(distinct) / k,
        len(distinct) / k**0.75 / 4,
        repeated,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        min(len(lines) / k, 1.0),
        len(zlib.compress(raw, 1)) / max(n, 1) if n else 0.0,
        float(raw.isupper()),
        float(np.mean(lengths == 1)) if len(words) else 0.0,
    ]
    return np.concatenate([np.array(more), np.sqrt(share), np.sqrt(ends_share[[0, 1, 2, 5]]), [math.sqrt(ends_share[8:].sum())]]).astype(np.float32)


N_STATS = len(statistics(""))


def with_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats): a row per row of ``docs``."""

    @tidy
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "stats": [statistics(t) for t in batch["text"]]})

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(measure, f"doc_id {kind}, stats array<float>")


@dataclass(frozen=True)
class Kernel:
    """Seeded random Fourier features of standardised statistics."""

    mean: np.ndarray
    scale: np.ndarray
    n_features: int
    width: float
    seed: int

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        draw = np.random.default_rng(self.seed)
        w = draw.standard_normal((len(self.mean), self.n_features)) / self.width
        b = draw.uniform(0, 2 * np.pi, self.n_features)
        x = np.clip((stats - self.mean) * self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / self.n_features) * np.cos(x @ w + b), np.ones((len(x), 1))])


@dataclass(frozen=True)
class Model:
    kernel: Kernel
    weights: np.ndarray
    curve: Curve

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.kernel(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Chance of label 1; raw scores break ties within a step of the calibration."""
        raw = self.raw(stats)
        return np.clip(self.curve(raw) * (1 - 1e-6) + 1e-6 * (np.clip(raw, -1, 2) + 1) / 3, 0, 1)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, N_STATS))


def moments(stats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and 1/deviation of every statistic over all rows, from sums by task."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, N_STATS))
        for batch in batches:
            x = _stack(batch["stats"])
            total += [np.full(N_STATS, len(x)), x.sum(0), (x * x).sum(0)]
        yield pd.DataFrame({"j": np.arange(N_STATS), "n": total[0], "s": total[1], "ss": total[2]})

    rows = stats.select("stats").mapInPandas(sums, "j int, n double, s double, ss double").groupBy("j").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")]).orderBy("j").toPandas()
    if not len(rows):
        return np.zeros(N_STATS), np.zeros(N_STATS)
    n = np.maximum(rows["n"].to_numpy(), 1)
    mean = rows["s"].to_numpy() / n
    spread = np.sqrt(np.maximum(rows["ss"].to_numpy() / n - mean**2, 0))
    return mean, np.where(spread > 1e-6, 1 / np.maximum(spread, 1e-6), 0.0)


def normal_equations(labelled: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over (stats, label) rows: summed in each task, then added up by row of the matrix."""
    d = kernel.n_features + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros((d, d + 1)), 0
        for batch in batches:
            z, y = kernel(_stack(batch["stats"])), batch["label"].to_numpy(float)
            total += np.hstack([z.T @ z, (z.T @ y)[:, None]])
            seen += len(z)
        if seen:
            yield pd.DataFrame({"i": np.arange(d), "row": [r.tobytes() for r in total]})

    def add(key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = sum(np.frombuffer(r) for part in rows for r in part["row"])
        yield pd.DataFrame({"i": [key[0]], "row": [total.tobytes()]})

    summed = labelled.select("stats", "label").mapInPandas(partial, "i int, row binary").groupBy("i").applyInPandas(add, "i int, row binary")
    rows = summed.toPandas().sort_values("i")
    if not len(rows):
        return np.zeros((d, d)), np.zeros(d)
    whole = np.stack([np.frombuffer(r) for r in rows["row"]])
    return whole[:, :d], whole[:, d]


def held_out(key: Column, mod: int, rest: int) -> Column:
    """crc32 of the key as text, modulo ``mod``, equals ``rest``; a null key counts as ''."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(mod)) == rest


def fit(stats: DataFrame, labels: DataFrame, *, n_features: int = 384, width: float = 9.0, ridge: float = 1e-3, seed: int = 5, calibrate_share: int = 5) -> Model:
    """Fit on ``labels`` (doc_id, label); repeated labels of a document count as their mean, null labels not at all.

    One in ``calibrate_share`` labelled documents, by hash, calibrates. Without labels every score is 1/2.
    """
    mean, scale = moments(stats)
    kernel = Kernel(mean, scale, n_features, width, seed)
    known = labels.where("label is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.avg("label").alias("label"))
    joined = written(stats.join(known, stats["doc_id"] == known["label_id"]).select("doc_id", "stats", "label"), "labelled")
    aside = F.pmod(F.xxhash64("doc_id"), F.lit(calibrate_share)) == 0
    zz, zy = normal_equations(joined.where(~aside), kernel)
    n = max(zz[-1, -1], 1.0)  # the last feature is 1: its square sums to the rows
    penalty = np.full(len(zz), ridge * n / len(zz) * np.trace(zz) / n + 1e-9)
    penalty[-1] = 1e-9
    weights = np.linalg.solve(zz + np.diag(penalty), zy)
    raw = raw_udf(kernel, weights)
    curve = fit_curve(joined.where(aside).select("label", raw("stats").alias("raw")), F.col("raw"), F.round("label"), -0.5, 1.5)
    return Model(kernel, weights, curve)


def raw_udf(kernel: Kernel, weights: np.ndarray):
    @F.pandas_udf("double")
    def raw(stats: pd.Series) -> pd.Series:
        return pd.Series(kernel(_stack(stats)) @ weights)

    return raw


def score(stats: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` to rows with ``stats``."""

    @F.pandas_udf("double")
    def scored(column: pd.Series) -> pd.Series:
        return pd.Series(model.score(_stack(column)))

    return stats.withColumn("score", scored("stats"))


def classify(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", mod: int = 5, rest: int = 0, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; labels of held-out documents are never read."""
    stats = written(with_statistics(docs), "stats")
    known = labels.where(~held_out(F.col("doc_id"), mod, rest)).select("doc_id", F.col(label_col).cast("double").alias("label"))
    scored = score(stats, fit(stats, known))
    return scored.select("doc_id", held_out(F.col("doc_id"), mod, rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", mod: int = 5, rest: int = 0, threshold: float = 0.3) -> DataFrame:
    """The documents that are not rejected, with all their columns. Texts are scored where they lie, so none is shuffled."""
    known = labels.where(~held_out(F.col("doc_id"), mod, rest)).select("doc_id", F.col(label_col).cast("double").alias("label"))
    model = fit(written(with_statistics(docs), "stats"), known)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        stats = np.stack([statistics(t) for t in texts]).astype(np.float64) if len(texts) else np.zeros((0, N_STATS))
        return pd.Series(model.score(stats) >= threshold)

    return docs.where(good("text"))
