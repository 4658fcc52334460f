"""Isotonic calibration of scores that were counted into bins of fixed number."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 2048


@dataclass(frozen=True)
class Curve:
    """A non-decreasing map from raw scores to chances, straight between its knots."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        if not len(self.x):
            return np.full(np.shape(raw), 0.5)
        return np.clip(np.interp(raw, self.x, self.y), 0.0, 1.0)


def pool_adjacent(x: np.ndarray, hits: np.ndarray, n: np.ndarray, prior: float = 1.0) -> Curve:
    """Pool neighbours that fall, weighted by their counts. Each pool is shrunk by ``prior`` rows of the overall rate; no rows give 1/2."""
    keep = n > 0
    x, hits, n = x[keep], hits[keep].astype(float), n[keep].astype(float)
    if not len(x):
        return Curve(np.zeros(0), np.zeros(0))
    rate = hits.sum() / n.sum()
    pools: list[list[float]] = []  # hits, n, first x, last x
    for a, h, k in zip(x, hits, n, strict=True):
        pools.append([h, k, a, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            h2, k2, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + h2, pools[-1][1] + k2, pools[-1][2], last]
    value = np.array([(h + prior * rate) / (k + prior) for h, k, _, _ in pools])
    value = np.maximum.accumulate(value)
    return Curve(np.array([v for p in pools for v in p[2:]]), np.repeat(value, 2))


def fit_curve(scored: DataFrame, raw: Column, label: Column, low: float, high: float) -> Curve:
    """Count (raw score, 0/1 label) rows into ``BINS`` bins of [low, high] and pool them. ``BINS`` rows reach the driver."""
    width = (high - low) / BINS
    slot = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((raw - F.lit(low)) / F.lit(width)))).cast("int")
    rows = scored.select(slot.alias("slot"), label.cast("double").alias("label")).groupBy("slot").agg(F.sum("label").alias("hits"), F.count("label").alias("n")).orderBy("slot").toPandas()
    rows = rows.dropna()
    centre = low + (rows["slot"].to_numpy(float) + 0.5) * width
    return pool_adjacent(centre, rows["hits"].to_numpy(float), rows["n"].to_numpy(float))
