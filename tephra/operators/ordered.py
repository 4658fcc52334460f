"""Running sums and quantiles over a whole table without sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(frame: DataFrame, order: str, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Add the sum of ``value`` over rows of lower or equal ``order`` (of the same group); equal orders share a sum only if they are one row.

    Rows are ranged by group and ``order`` into as many parts as their size asks for and written once, so a group may be
    many parts; a part's offset is the sum of its group's parts before it.
    """
    from tephra.session import written

    ranged = written(frame.repartitionByRange(*[F.col(c) for c in by], F.col(order)).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy(*by, "_part").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part and group
    offset = F.broadcast(sums.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_p"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off")))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    inner = F.sum(value).over(Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(offset, same).withColumn(out, inner + F.col("_off")).drop("_part", "_p", "_off", *[f"_by{i}" for i in range(len(by))])


def top_k(frame: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k rows of highest score, ties to the lower key."""
    return frame.orderBy(F.desc(score), F.asc(key)).limit(k)


def nearest_row(frame: DataFrame, by: Sequence[str], distance: Column, key: str) -> DataFrame:
    """In each group the row of least distance, ties to the lower key."""
    columns = [c for c in frame.columns if c not in by]
    best = frame.groupBy(*by).agg(F.min_by(F.struct(*columns), F.struct(distance, F.col(key))).alias("_r"))
    return best.select(*by, *[F.col(f"_r.{c}").alias(c) for c in columns])


def merge_strata(frame: DataFrame, stratum: str, least: int = 2) -> DataFrame:
    """Add ``merged``: strata of fewer than ``least`` rows, the greatest first, join the next lower one that has rows; the lowest stays.

    Strata are few and numbered or ordered as text; their sizes alone reach the driver.
    """
    sizes = sorted((r[0], r[1]) for r in frame.where(F.col(stratum).isNotNull()).groupBy(stratum).count().collect())
    to, counts = {k: k for k, _ in sizes}, dict(sizes)
    for k, _ in reversed(sizes):
        lower = [j for j in counts if j < k]
        if counts[k] < least and lower:
            into = max(lower)
            counts[into] += counts.pop(k)
            to = {a: into if b == k else b for a, b in to.items()}
    moved = [F.when(F.col(stratum) == a, F.lit(b)) for a, b in to.items() if a != b]
    return frame.withColumn("merged", F.coalesce(*moved, F.col(stratum)))


def stratified_split(frame: DataFrame, stratum: str, key: str, share: float, least: int = 2, seed: int = 0, merge: bool = False) -> DataFrame:
    """Mark a share of every stratum, at least one row on each side; strata under ``least`` rows stay whole, or ``merge`` joins them to the next lower one first.

    Rows go by md5 of seed and key, so reruns agree; the share is rounded half to even.
    """
    if merge:
        return stratified_split(merge_strata(frame, stratum, least), "merged", key, share, least, seed).drop("merged")
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)))
    n = F.count("*").over(Window.partitionBy(stratum))
    take = F.least(F.greatest(F.lit(1), F.bround(n * share)), n - 1)
    return frame.withColumn("held", (n >= least) & (rank <= take))


def hash_share(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from md5 of seed and key, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 7), 16, 10).cast("double") / float(1 << 28)


def split_by_hash(frame: DataFrame, key: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """Add ``role``: rows are dealt by ``hash_share`` in the given shares, the last taking the rest."""
    names, total = list(shares), 0.0
    role = None
    for name in names[:-1]:
        total += shares[name]
        role = F.when(hash_share(F.col(key), seed) < total, name) if role is None else role.when(hash_share(F.col(key), seed) < total, name)
    return frame.withColumn("role", F.lit(names[-1]) if role is None else role.otherwise(names[-1]))


def size_bucket(n: Column) -> Column:
    """Batch size class: a power of 2 up to 8, a multiple of 8 up to 128, then quarter octaves rounded up to a multiple of 8."""
    power = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))))
    steps = F.array(*[F.lit(float(-(-int(-(-128 * 2 ** (k / 4) // 1)) // 8) * 8)) for k in range(1, 81)])
    octave = F.element_at(F.filter(steps, lambda s: s >= n), 1)
    return F.when(n <= 8, power).when(n <= 128, F.ceil(n / 8) * 8).otherwise(octave).cast("long")


def pareto_front(frame: DataFrame, cost: str, value: str) -> DataFrame:
    """Rows whose value is below that of every cheaper row. Candidates are cut by part first, so one task only sees a front of fronts."""
    spread = frame.withColumn("_part", F.spark_partition_id())
    before = Window.orderBy(cost, value).rowsBetween(Window.unboundedPreceding, -1)
    local = Window.partitionBy("_part").orderBy(cost, value).rowsBetween(Window.unboundedPreceding, -1)
    cut = spread.withColumn("_m", F.min(value).over(local)).where(F.col("_m").isNull() | (F.col(value) < F.col("_m"))).drop("_m", "_part")
    return cut.withColumn("_m", F.min(value).over(before)).where(F.col("_m").isNull() | (F.col(value) < F.col("_m"))).drop("_m")
