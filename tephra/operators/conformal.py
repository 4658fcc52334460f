"""Conformal calibration by group: weights, scales, quantiles, bands, borrowing, recalibration."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def effective_n_min(n_min: int, alpha: float) -> int:
    """Configurations a group needs for a finite quantile."""
    return max(n_min, math.ceil((1 - alpha) / alpha - 1e-9))


def config_weights(frame: DataFrame, config: str, group: str, out: str = "w") -> DataFrame:
    """Weight 1 / rows of the same configuration and group."""
    counts = frame.groupBy(config, group).agg((1.0 / F.count("*")).alias(out))
    return frame.join(counts, [config, group])


def pooled_lam(frame: DataFrame, score: str, weight: str = "w", by: Sequence[str] = ()) -> DataFrame:
    """sqrt(sum w s^2 / (3 sum w))."""
    return frame.groupBy(*by).agg(F.sqrt(F.try_divide(F.sum(F.col(weight) * F.pow(score, 2)), 3 * F.sum(weight))).alias("lam"))


def weighted_quantile(frame: DataFrame, score: str, weight: str, config: str, alpha: float, by: Sequence[str]) -> DataFrame:
    """By group: the first score at which the weight below, over the total plus one mean configuration's, reaches 1 - alpha; else infinity.

    Equal scores are summed first, and a group's distinct scores are ranged over many tasks.
    """
    from tephra.operators.ordered import running

    sums = frame.groupBy(*by, score).agg(F.sum(weight).alias("_w"))
    total = frame.groupBy(*by).agg(F.sum(weight).alias("_t"), F.countDistinct(config).alias("n_cfg"))
    reached = running(sums, score, "_w", "_c", by).join(total, list(by))
    enough = F.col("_c") / (F.col("_t") + F.col("_t") / F.col("n_cfg")) >= 1 - alpha - 1e-15
    return reached.groupBy(*by, "n_cfg").agg(F.coalesce(F.min(F.when(enough, F.col(score))), F.lit(float("inf"))).alias("q"))


def band_edges(frame: DataFrame, d: str, levels: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """One row: distinct quantiles of d above its minimum."""
    kept = frame.where(~F.isnan(d))
    row = kept.agg(F.array_distinct(F.percentile(d, F.array(*[F.lit(x) for x in levels]))).alias("edges"), F.min(d).alias("_m"))
    return row.select(F.filter("edges", lambda e: e > F.col("_m")).alias("edges"))


def assign_group(d: Column, z: Column, mode: Column, edges: Column) -> Column:
    """2 * band + (z differs from its mode); a NaN d is in the top band."""
    band = F.when(F.isnan(d), F.size(edges)).otherwise(F.size(F.filter(edges, lambda e: e <= d)))
    return 2 * band + (z != mode).cast("int")


def modal_value(frame: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """The commonest value, the least of equals."""
    counts = frame.groupBy(*by, column).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(F.max_by(column, F.struct(F.col("_n"), -F.col(column))).alias("mode"))


def borrow(scales: DataFrame, n_eff: int, pooled_q: float, pooled_lam: float) -> DataFrame:
    """Scales (grp, n_cfg, q, lam) with small groups filled from others: nearest band of the same flag, lower band on ties, then of the other flag, else pooled.

    Adds ``source``: the group whose values serve, -1 for the pool. Groups are few: as many as bands twice.
    """
    rich = scales.where(F.col("n_cfg") >= n_eff).select(F.col("grp").alias("o"), F.col("q").alias("o_q"), F.col("lam").alias("o_lam"))
    pairs = scales.join(F.broadcast(rich), F.when(F.col("n_cfg") >= n_eff, F.col("grp") == F.col("o")).otherwise(F.lit(True)), "left")
    band, other = F.expr("grp div 2"), F.expr("o div 2")
    rank = F.struct((F.col("grp") % 2 != F.col("o") % 2).cast("int"), F.abs(band - other), other)
    best = pairs.groupBy("grp", "n_cfg").agg(F.min_by(F.struct("o", "o_q", "o_lam"), F.when(F.col("o").isNotNull(), rank)).alias("b"))
    return best.select("grp", "n_cfg", F.coalesce("b.o", F.lit(-1)).alias("source"), F.coalesce("b.o_q", F.lit(pooled_q)).alias("q"), F.coalesce("b.o_lam", F.lit(pooled_lam)).alias("lam"))


def group_table(frame: DataFrame, score: str, config: str, group: str, alpha: float, n_min: int) -> DataFrame:
    """(grp, n_cfg, n_atom, source, q, lam, r): scales of every group that has rows, small ones borrowed from others or the pool of all.

    In the pool a configuration weighs one for every group that it spans. r = q / (lam chi3 quantile) is 1 where errors
    are normal with the scale lam.
    """
    from tephra.functions.special import chi_ppf
    from tephra.session import written

    weighted = written(config_weights(frame.select(F.col(config).alias("cfg"), F.col(group).alias("grp"), F.col(score).alias("s")), "cfg", "grp"), "weighted")
    sizes = weighted.groupBy("grp").agg(F.count("*").alias("n_atom"))
    scales = written(weighted_quantile(weighted, "s", "w", "cfg", alpha, ["grp"]).join(pooled_lam(weighted, "s", by=["grp"]), "grp").join(sizes, "grp"), "scales")
    pool = weighted.withColumn("_all", F.lit(0))
    q_all = weighted_quantile(pool, "s", "w", "cfg", alpha, ["_all"]).first()
    lam_all = pooled_lam(pool, "s").first()["lam"]
    served = borrow(scales.select("grp", "n_cfg", "q", "lam"), effective_n_min(n_min, alpha), q_all["q"] if q_all else math.inf, lam_all if lam_all is not None else math.nan)
    return served.join(F.broadcast(scales.select("grp", "n_atom")), "grp").withColumn("r", F.col("q") / (F.col("lam") * chi_ppf(1 - alpha)))


def transfer_exponent(lam1: float, lam2: float, n1: float, n2: float) -> float:
    """clip(ln(lam1 / lam2) / ln(n1 / n2), 0, 1/2); 1/2 where that has no value."""
    try:
        value = math.log(lam1 / lam2) / math.log(n1 / n2)
    except (ValueError, ZeroDivisionError):
        return 0.5
    return min(0.5, max(0.0, value)) if math.isfinite(value) else 0.5


def recalibrate(stored: DataFrame, new: DataFrame, mode: str, group: str = "grp", config: str = "cfg", n_eff: int = 0) -> DataFrame:
    """Stored and new scores together. ``replace`` drops all stored rows, ``append`` keeps them, ``per_group`` drops those of groups with ``n_eff`` new configurations.

    Configurations of the new rows are numbered after the stored ones; ``src`` is one more than the largest stored.
    """
    if mode == "replace":
        kept = stored.limit(0)
    elif mode == "append":
        kept = stored
    else:
        full = new.groupBy(group).agg(F.countDistinct(config).alias("_n")).where(F.col("_n") >= n_eff).select(group)
        kept = stored.join(full, group, "left_anti").select(*stored.columns)
    last = stored.agg(F.coalesce(F.max(config) + 1, F.lit(0)).alias("_c"), F.coalesce(F.max("src") + 1, F.lit(0)).alias("_s"))
    moved = new.crossJoin(F.broadcast(last))  # one row
    moved = moved.withColumn(config, F.col(config) + F.col("_c")).withColumn("src", F.col("_s")).select(*stored.columns)
    return kept.unionByName(moved)
