"""Bloch sums of operator blocks, bands, occupations and what compares spectra."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bloch_sum(blocks: DataFrame, points: DataFrame) -> DataFrame:
    """(struct_id, k, row, col, re, im): sum over R of exp(2 pi i k.R) v; blocks (struct_id, rx, ry, rz, row, col, v), points (k, kx, ky, kz) few."""
    phase = 2 * np.pi * (F.col("kx") * F.col("rx") + F.col("ky") * F.col("ry") + F.col("kz") * F.col("rz"))
    each = blocks.join(F.broadcast(points), F.lit(True))  # a stated set of k points
    return each.groupBy("struct_id", "k", "row", "col").agg(F.sum(F.cos(phase) * F.col("v")).alias("re"), F.sum(F.sin(phase) * F.col("v")).alias("im"))


def bands(h: DataFrame, s: DataFrame) -> DataFrame:
    """(struct_id, k, band, energy) of H c = e S c from Bloch sums; a task solves one structure and point."""

    def solve(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        n = int(max(a[["row", "col"]].max().max(), b[["row", "col"]].max().max())) + 1

        def matrix(t: pd.DataFrame) -> np.ndarray:
            m = np.zeros((n, n), complex)
            np.add.at(m, (t["row"], t["col"]), t["re"] + 1j * t["im"])
            return (m + m.conj().T) / 2

        low = np.linalg.cholesky(matrix(b))
        half = np.linalg.solve(low, matrix(a))
        e = np.linalg.eigvalsh(np.linalg.solve(low, half.conj().T))
        return pd.DataFrame({"struct_id": key[0], "k": key[1], "band": np.arange(n), "energy": e})

    other = s.toDF(*s.columns)  # its own columns, where both come from one table
    return h.groupBy("struct_id", "k").cogroup(other.groupBy("struct_id", "k")).applyInPandas(solve, "struct_id long, k int, band int, energy double")


def occupations(energies: np.ndarray, weights: np.ndarray, electrons: float, width: float, kind: str = "fermi-dirac", degeneracy: float = 2.0) -> tuple[float, np.ndarray]:
    """Fermi level by 100 bisections and the occupation of each state, smeared."""
    from math import erfc

    def filled(mu: float) -> np.ndarray:
        x = (energies - mu) / width
        if kind == "fermi-dirac":
            return degeneracy * np.exp(-np.logaddexp(0, x))
        return degeneracy * 0.5 * np.vectorize(erfc)(x)

    low, high = energies.min() - 20 * width, energies.max() + 20 * width
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (weights * filled(mid)).sum() < electrons else (low, mid)
    mu = (low + high) / 2
    return mu, filled(mu)


def spectrum_distance(reference: DataFrame, predicted: DataFrame, by: Sequence[str] = ("struct_id",)) -> DataFrame:
    """Wasserstein-1 distance of two level sets a structure, by a running sum over sorted levels; levels (by, energy, weight)."""
    both = reference.select(*by, "energy", (-F.col("weight")).alias("d")).unionByName(predicted.select(*by, "energy", F.col("weight").alias("d")))
    w = Window.partitionBy(*by).orderBy("energy", "d")
    gap = F.lead("energy").over(w) - F.col("energy")
    run = F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    stepped = both.select(*by, (F.abs(run) * gap).alias("area"))
    total = reference.groupBy(*by).agg(F.sum("weight").alias("_n"))
    return stepped.groupBy(*by).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("_a")).join(total, list(by)).select(*by, (F.col("_a") / F.col("_n")).alias("distance"))


def summary(errors: DataFrame, key: str, value: str) -> DataFrame:
    """One row: rms, median and worst structure."""
    return errors.agg(F.sqrt(F.avg(F.pow(value, 2))).alias("rms"), F.percentile(value, 0.5).alias("median"), F.max(value).alias("worst"), F.max_by(key, F.struct(F.col(value), -F.col(key))).alias("worst_id"))
