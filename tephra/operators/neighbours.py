"""Neighbour pairs: a range join made of an equi join on grid cells, and what is derived from its edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        out = out + F.pow(x - y, 2)
    return F.sqrt(out)


def range_join(left: DataFrame, right: DataFrame, axes: Sequence[str], cutoff: float, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows (columns l_*, r_*, and ``dist``) of the same keys that are less than ``cutoff`` apart along ``axes``.

    Rows of the right side stand once, in their cell; rows of the left side are copied to the 3^d cells around, so the
    join is an equi join that spreads over cells.
    """
    def cell(c: str) -> Column:
        return F.floor(F.col(c) / cutoff)

    a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns], *[cell(c).alias(f"_c{i}") for i, c in enumerate(axes)])
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], *[cell(c).alias(f"_d{i}") for i, c in enumerate(axes)])
    for i in range(len(axes)):
        a = a.withColumn(f"_c{i}", F.explode(F.array(*[F.col(f"_c{i}") + s for s in (-1, 0, 1)])))
    on = F.lit(True)
    for i in range(len(axes)):
        on = on & (F.col(f"_c{i}") == F.col(f"_d{i}"))
    for k in keys:
        on = on & (F.col(f"l_{k}") == F.col(f"r_{k}"))
    d = distance([F.col(f"l_{c}") for c in axes], [F.col(f"r_{c}") for c in axes])
    joined = a.join(b, on).withColumn("dist", d).where(F.col("dist") < cutoff)
    return joined.drop(*[f"_c{i}" for i in range(len(axes))], *[f"_d{i}" for i in range(len(axes))])


def edges(points: DataFrame, axes: Sequence[str], cutoff: float, key: str, keys: Sequence[str] = ()) -> DataFrame:
    """Directed pairs i -> j of different points, both ways."""
    return range_join(points, points, axes, cutoff, keys).where(F.col(f"l_{key}") != F.col(f"r_{key}"))


def periodic_edges(atoms: DataFrame, cells: DataFrame, cutoff: float, carry: Sequence[str] = ()) -> DataFrame:
    """Neighbours of atoms (cfg, atom, x, y, z) under the cells (cfg, a array<array<double>>, pbc array<boolean>): (cfg, i, j, sx, sy, sz, dx, dy, dz, dist).

    Images within ceil(cutoff / width) cells on periodic axes are made of the receivers; then grid cells join. Columns to
    ``carry`` come along from both atoms, as name_i and name_j.
    """
    def cross(u: Column, v: Column) -> Column:
        return F.array(*[u[(i + 1) % 3] * v[(i + 2) % 3] - u[(i + 2) % 3] * v[(i + 1) % 3] for i in range(3)])

    def dot(u: Column, v: Column) -> Column:
        return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]

    a = F.col("a")
    normal = [cross(a[(i + 1) % 3], a[(i + 2) % 3]) for i in range(3)]
    volume = F.abs(dot(a[0], normal[0]))
    ranges = cells.select("cfg", "a", *[F.when(F.col("pbc")[i], F.ceil(cutoff * F.sqrt(dot(normal[i], normal[i])) / volume)).otherwise(0).cast("int").alias(f"n{i}") for i in range(3)])
    images = ranges
    for i, s in enumerate(("sx", "sy", "sz")):
        images = images.withColumn(s, F.explode(F.sequence(-F.col(f"n{i}"), F.col(f"n{i}"))))
    moved = atoms.join(images, "cfg").select("cfg", "atom", *carry, "sx", "sy", "sz", *[(F.col(c) + F.col("sx") * a[0][i] + F.col("sy") * a[1][i] + F.col("sz") * a[2][i]).alias(c) for i, c in enumerate("xyz")])
    found = range_join(atoms.select("cfg", "atom", *carry, "x", "y", "z"), moved, ("x", "y", "z"), cutoff, ("cfg",))
    home = (F.col("l_atom") == F.col("r_atom")) & (F.col("r_sx") == 0) & (F.col("r_sy") == 0) & (F.col("r_sz") == 0)
    return found.where(~home).select(F.col("l_cfg").alias("cfg"), F.col("l_atom").alias("i"), F.col("r_atom").alias("j"), *[F.col(f"r_{s}").alias(s) for s in ("sx", "sy", "sz")], *[(F.col(f"r_{c}") - F.col(f"l_{c}")).alias(f"d{c}") for c in "xyz"], "dist", *[F.col(f"{side}_{c}").alias(f"{c}_{end}") for c in carry for side, end in ("li", "rj")])


def slots(found: DataFrame, centre: str, order: Sequence[str]) -> DataFrame:
    """Add each edge's place among its centre's edges, from 0."""
    return found.withColumn("slot", F.row_number().over(Window.partitionBy(centre).orderBy(*order)) - 1)


def reverse_slots(found: DataFrame, i: str, j: str, vector: Sequence[str], step: float = 1e-6) -> DataFrame:
    """Match each edge with the one back: same pair, opposite vector to ``step``. Unmatched edges have a null ``back``."""
    key = [F.round(F.col(c) / step).cast("long") for c in vector]
    there = found.withColumn("_k", F.array(*key))
    back = found.select(F.col(i).alias("_i"), F.col(j).alias("_j"), F.array(*[-k for k in key]).alias("_b"), F.col("slot").alias("back"))
    return there.join(back, (F.col(i) == F.col("_j")) & (F.col(j) == F.col("_i")) & (F.col("_k") == F.col("_b")), "left").drop("_k", "_i", "_j", "_b")


def shell_features(found: DataFrame, centre: str, r1: float) -> DataFrame:
    """(centre, z, d): edges shorter than r1; population deviation over mean of their lengths, NaN for fewer than two."""
    near = F.when(F.col("dist") < r1, F.col("dist"))
    return found.groupBy(centre).agg(F.count(near).alias("z"), F.when(F.count(near) >= 2, F.stddev_pop(near) / F.avg(near)).otherwise(F.lit(float("nan"))).alias("d"))


def site_summary(found: DataFrame, centre: str, r0: float, cutoff: float, power: int = 10) -> DataFrame:
    """(centre, s): r0 (sum of fc(r) (r0 / r)^p + 1e-30)^(-1/p) with fc = (1 - (r / cutoff)^2)^2."""
    fc = F.pow(1 - F.pow(F.col("dist") / cutoff, 2), 2)
    total = F.sum(fc * F.pow(r0 / F.col("dist"), power)) + 1e-30
    return found.groupBy(centre).agg((r0 * F.pow(total, -1.0 / power)).alias("s"))


def min_coordination(points: DataFrame, found: DataFrame, key: str, centre: str) -> DataFrame:
    """One row: the least number of neighbours of any point, those without edges included."""
    n = points.select(F.col(key).alias("_k")).join(found.groupBy(F.col(centre).alias("_k")).agg(F.count("*").alias("_n")), "_k", "left")
    return n.agg(F.min(F.coalesce("_n", F.lit(0))).alias("min_coordination"))


def vector_distance2(a: Column, b: Column) -> Column:
    """Squared distance of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, v: s + v)


def nearest(queries: DataFrame, base: DataFrame, q_key: str, b_key: str, vector: str, *, others: bool = False, block: int = 4_096) -> DataFrame:
    """(q_key, nn, d2): the nearest base row of each query, exact, ties to the lower key.

    The queries are a stated set; they go out in blocks of about ``block``, each a pass over the base rows, so what is
    broadcast has a bound. ``others`` leaves out the row of the query's own key.
    """
    from tephra.session import written

    asked = written(queries.select(F.col(q_key).alias("_q"), F.col(vector).alias("_qv")), "queries")
    blocks = max(1, -(-asked.count() // block))
    rows = base.select(F.col(b_key).alias("_b"), F.col(vector).alias("_bv"))
    found = None
    for number in range(blocks):
        q = F.broadcast(asked.where(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == number) if blocks > 1 else asked)  # about a block
        pairs = rows.join(q, F.col("_b") != F.col("_q") if others else F.lit(True)).withColumn("_d", vector_distance2(F.col("_qv"), F.col("_bv")))
        best = pairs.groupBy("_q").agg(F.min(F.struct("_d", "_b")).alias("_m"))
        part = best.select(F.col("_q").alias(q_key), F.col("_m._b").alias("nn"), F.col("_m._d").alias("d2"))
        found = part if found is None else found.unionByName(part)
    return found


def grid_blocks(frame: DataFrame, axes: Sequence[str], side: float, key: Sequence[str] = ()) -> DataFrame:
    """Add ``block``: the grid cell of side ``side`` as text."""
    return frame.withColumn("block", F.concat_ws(":", *[F.col(k).cast("string") for k in key], *[F.floor(F.col(a) / side).cast("string") for a in axes]))
