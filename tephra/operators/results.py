"""Tables over result rows: scans, case keys, pivots, verdicts, costs, families, coverage by cell, binned correlations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_results(spark: SparkSession, folder: str, pattern: str = "*.jsonl", schema: str | None = None) -> DataFrame:
    """The JSON lines of a folder's files and of those of the same names in ``repeats`` below it, with their ``_file`` stem.

    Blank lines are no rows. A folder without such files gives an error, one without repeats does not.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/repeats/{pattern}")
    again = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    rows = reader.json([f"{folder}/{pattern}", *([f"{folder}/repeats/{pattern}"] if again else [])])
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    return rows.withColumn("_file", F.regexp_replace(name, r"\.[^.]*$", ""))


def with_parts(rows: DataFrame, path: str, names: Sequence[str]) -> DataFrame:
    """Fill columns from the parts of a path-like key that has as many parts as there are names; '' skips a part, values that are there stay."""
    parts = F.split(F.coalesce(F.col(path), F.lit("")), "/")
    for i, name in enumerate(names):
        if name:
            found = F.when(F.size(parts) == len(names), parts[i])
            rows = rows.withColumn(name, F.coalesce(F.col(name), found) if name in rows.columns else found)
    return rows


def case_key(key: Column, host: Column, identity: Sequence[Column]) -> Column:
    """What makes two rows one case: host and key where there is a key, else the identity columns, as JSON (nulls written out)."""
    options = {"ignoreNullFields": "false"}
    return F.when(key.isNotNull(), F.to_json(F.struct(host.alias("host"), key.alias("key")), options)).otherwise(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(identity)]), options))


def at_fixed_size(rows: DataFrame, by: Sequence[str], size: str, target: Column, key: str) -> DataFrame:
    """By group the row whose size is nearest to a target, the lower key on ties."""
    columns = [c for c in rows.columns if c not in by]
    best = rows.groupBy(*by).agg(F.min_by(F.struct(*columns), F.struct(F.abs(F.col(size) - target), F.col(key))).alias("_r"))
    return best.select(*by, *[F.col(f"_r.{c}").alias(c) for c in columns])


def parity_table(rows: DataFrame, by: Sequence[str], status: str, gaps: Sequence[str], timed: DataFrame) -> DataFrame:
    """By group: passed, run, errors, and the largest absolute gaps of rows that are no errors (a missing gap counts as 0); then a pending row for each timed host without any.

    ``by`` begins with the host; ``timed`` has the hosts that were timed.
    """
    compared = F.col(status) != "error"
    found = rows.where(F.col(status).startswith("parity_") | (F.col(status) == "error")).groupBy(*by).agg(
        F.sum((F.col(status) == "parity_ok").cast("int")).alias("passed"), F.count("*").alias("run"), F.sum((~compared).cast("int")).alias("errors"),
        *[F.max(F.when(compared, F.abs(F.coalesce(F.col(g), F.lit(0.0))))).alias(g) for g in gaps],
    )
    host = by[0]
    pending = timed.select(host).distinct().join(found.select(host), host, "left_anti")
    return found.unionByName(pending, allowMissingColumns=True)


def pivot_ratio(rows: DataFrame, by: Sequence[str], series: str, value: str, num: str, den: str) -> DataFrame:
    """By group the values of two series beside each other, and their ratio; null where one is missing."""
    wide = rows.groupBy(*by).pivot(series, [num, den]).agg(F.first(value, True))
    return wide.withColumn("ratio", F.try_divide(F.col(num), F.col(den)))


def phases(after: DataFrame, before: DataFrame, is_own: Column, is_reference: Column, mode: str) -> DataFrame:
    """One series of rows with ``phase``: own rows after and before (modes that were run after only), and the reference once for every mode run after. Nothing where there is no own row after."""
    own = after.where(is_own)
    modes = own.select(F.col(mode).alias("_m")).distinct()
    old = before.where(is_own).join(F.broadcast(modes), F.col(mode) == F.col("_m"), "left_semi")  # modes are few
    other = after.where(is_reference).drop(mode).join(F.broadcast(modes).withColumnRenamed("_m", mode))  # one row a mode
    return own.withColumn("phase", F.lit("after")).unionByName(old.withColumn("phase", F.lit("before"))).unionByName(other.withColumn("phase", F.lit("reference")).select(*own.columns, "phase"))


def parameter_cases(models: DataFrame, choices: Mapping[str, Sequence[tuple[str, Sequence[str]]]], code: str, ladder: Column, barred: Column) -> DataFrame:
    """Every model with each mode and precision that its code has, at every size of its ladder; barred combinations are left out.

    ``choices``: code -> (mode, precisions). ``barred`` may use the columns of ``models``, ``mode`` and ``dtype``.
    """
    pairs = F.lit(None)
    for name, modes in choices.items():
        listed = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(p).alias("dtype")) for m, precisions in modes for p in precisions])
        pairs = F.when(F.col(code) == name, listed).otherwise(pairs)
    out = models.withColumn("_p", F.explode(pairs)).select(*models.columns, "_p.mode", "_p.dtype")
    return out.where(~barred).withColumn("n_atoms", F.explode(ladder))


def blocked(rows: DataFrame, code: str, status: str, gate: str, separate: str, standalone: Sequence[str]) -> DataFrame:
    """(code, mode) lines that a failed or erring gate rules out: the embedded line unless the gate is ``separate``, the standalone line for standalone gates."""
    bad = rows.where(F.col(status).isin("parity_fail", "error"))
    embedded = bad.where(~F.col(gate).eqNullSafe(separate)).select(code, F.lit("embedded").alias("mode"))
    return embedded.union(bad.where(F.col(gate).isin(*standalone)).select(code, F.lit("standalone").alias("mode"))).distinct()


def criteria(targets: DataFrame, before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Targets (key, kind 'most' or 'least', target) beside measured values before and after, and whether after meets them; a missing value misses, criteria never measured after are left out."""
    b, a = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    joined = targets.join(a, key).join(b, key, "left")
    met = F.when(F.col("kind") == "most", F.col("after") <= F.col("target")).otherwise(F.col("after") >= F.col("target"))
    return joined.withColumn("met", F.coalesce(met, F.lit(False)))


def split_hash(parts: Sequence[tuple[DataFrame, Column]], digits: int = 12) -> str:
    """A digest of tables given as (rows, their text): equal for the same rows of each part in any order, however they lie.

    Row digests are summed by 15 hex digits at a time in the tasks, so no task sees a part whole.
    """
    import hashlib

    whole = hashlib.sha256()
    for rows, text in parts:
        whole.update(repr(tuple(map(int, rows.select(*digest_sums(text)).first()))).encode())
    return whole.hexdigest()[:digits]


def digest_sums(text: Column) -> list[Column]:
    """Number of rows and four sums of their sha256, aggregates that merge."""
    digest = F.sha2(text, 256)
    return [F.count("*").alias("n"), *[F.sum(F.conv(F.substring(digest, 15 * i + 1, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(4)]]


def curve_minima(rows: DataFrame, by: Sequence[str], x: str, y: str, reference: Mapping[str, object], scale: float = 1e3) -> DataFrame:
    """By group the x and y where y is least (least x on ties), and y's excess over the reference group's, scaled."""
    least = rows.groupBy(*by).agg(F.min(F.struct(y, x)).alias("_m")).select(*by, F.col(f"_m.{x}").alias("x0"), F.col(f"_m.{y}").alias("y0"))
    same = F.lit(True)
    for name, v in reference.items():
        same = same & (F.col(name) == v)
    base = least.where(same).agg(F.min("y0").alias("_base"))
    return least.crossJoin(F.broadcast(base)).withColumn("excess", scale * (F.col("y0") - F.col("_base"))).drop("_base")  # one row


def seed_parts(size: Column) -> tuple[Column, Column]:
    """(base, seed) of names like base_s3; a name without a seed is its own base and has a null seed."""
    base, seed = F.regexp_extract(size, r"^(.+)_s(\d+)$", 1), F.regexp_extract(size, r"^(.+)_s(\d+)$", 2)
    return F.when(base != "", base).otherwise(size), F.when(seed != "", seed).cast("int")


def family(rules: Sequence[tuple[Column, Column | str]], otherwise: Column) -> Column:
    """The value of the first rule that holds."""
    out = otherwise
    for holds, value in reversed(rules):
        out = F.when(holds, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def with_aliases(rows: DataFrame, column: str, aliases: Sequence[tuple[str | Column, Column]]) -> DataFrame:
    """The rows, and for each alias (new value, condition) copies of the rows that it holds for under the new value."""
    copies = [rows.where(holds).withColumn(column, value if isinstance(value, Column) else F.lit(value)) for value, holds in aliases]
    out = rows
    for copy in copies:
        out = out.unionByName(copy)
    return out


def ordered_models(rows: DataFrame, families: Sequence[str], family_col: str, size: Column, name: Column, first: tuple[str, str, str]) -> DataFrame:
    """(rank, family, label, model): a fixed first row, then each listed family's rows by size. Ranks are by family and size."""
    place = F.array_position(F.array(*map(F.lit, families)), F.col(family_col))
    kept = rows.where(F.col(family_col).isin(*families))
    ranked = kept.select(F.row_number().over(Window.partitionBy(family_col).orderBy(F.coalesce(size, F.lit(0)), name)).alias("rank"), place.alias("block"), F.col(family_col).alias("family"), size.alias("label"), name.alias("model"))
    spark = rows.sparkSession
    return spark.createDataFrame([(1, 0, *first)], "rank int, block long, family string, label string, model string").unionByName(ranked.withColumn("label", F.col("label").cast("string")))


def cheapest_runs(rows: DataFrame, gates: DataFrame, *, name: str, cost: Column, file: str, line: Sequence[str], needs_gate: Column, preferred: Sequence[str] = ()) -> DataFrame:
    """(name, cost, file) of each model's fastest ok run.

    A run that needs a gate counts only if its own file has the gate (file, *line) passed. Models that a preferred file
    times are taken from the first such file alone.
    """
    ok = rows.where(F.col("status") == "ok").withColumn("_cost", cost).where("_cost is not null")
    passed = gates.where(F.col("status") == "parity_ok").select(file, *line).distinct().withColumn("_passed", F.lit(True))
    ok = ok.join(passed, [file, *line], "left").where(~needs_gate | F.coalesce("_passed", F.lit(False)))
    if preferred:
        rank = F.array_position(F.array(*map(F.lit, preferred)), F.col(file))
        first = ok.groupBy(name).agg(F.min(F.when(rank > 0, rank)).alias("_first"))
        ok = ok.join(first, name).where(F.col("_first").isNull() | (rank == F.col("_first")))
    return ok.groupBy(name).agg(F.min(F.struct(F.col("_cost").alias("cost"), F.col(file).alias("file"))).alias("_b")).select(name, "_b.cost", "_b.file")


def speedups(loop: DataFrame, batched: DataFrame, by: Sequence[str], size: str, value: str, sizes: Sequence[int]) -> DataFrame:
    """By group the value at each batch size, the loop's, and the best ratio of the two."""
    wide = batched.groupBy(*by).pivot(size, list(sizes)).agg(F.first(value, True))
    wide = wide.select(*by, *[F.col(str(s)).alias(f"b{s}") for s in sizes])
    joined = wide.join(loop.select(*by, F.col(value).alias("loop")), list(by), "left")
    return joined.withColumn("best", F.try_divide(F.col("loop"), F.least(*[F.col(f"b{s}") for s in sizes]) if len(sizes) > 1 else F.col(f"b{sizes[0]}")))


def live_errors(rows: DataFrame, y: Column, predicted: Column, weight: Column, per: Column) -> DataFrame:
    """Add ``error`` = (predicted - y) / per on rows of positive weight; the others go."""
    return rows.where(weight > 0).withColumn("error", (predicted - y) / F.greatest(per, F.lit(1)))


def leverage_by_group(train: DataFrame, rows: DataFrame, group: str, features: Sequence[str], ridge: float) -> DataFrame:
    """Rows with ``score`` = q (G + ridge tr G / d)^-1 q', G the Gram matrix of the group's training rows; null where the group was not trained.

    Gram matrices are summed in one pass; groups are a small catalogue.
    """
    import numpy as np

    d = len(features)
    x = [F.col(f).cast("double") for f in features]
    sums = [F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d)]
    entries = []
    for r in train.groupBy(group).agg(*sums).collect():
        g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
        entries.append((r[group], np.linalg.inv(g + ridge * np.trace(g) / d * np.eye(d)).ravel().tolist()))
    kind = dict(train.dtypes)[group]
    inverse = F.broadcast(rows.sparkSession.createDataFrame(entries, f"_g {kind}, _inv array<double>"))  # one small matrix a group
    total = F.lit(0.0)
    for i in range(d):
        for j in range(d):
            total = total + x[i] * x[j] * F.col("_inv")[i * d + j]
    return rows.join(inverse, F.col(group) == F.col("_g"), "left").withColumn("score", total).drop("_g", "_inv")


def cluster_grade(clusters: Sequence[tuple[Sequence[float], Sequence[Sequence[float]], float]], features: Sequence[Column]) -> Column:
    """sigma / theta of the cluster (mean, precision, theta) nearest in Mahalanobis distance, the first of equals; clusters are few."""
    found = []
    for i, (mean, precision, theta) in enumerate(clusters):
        gap = [f - float(m) for f, m in zip(features, mean, strict=True)]
        square = F.lit(0.0)
        for a in range(len(gap)):
            for b in range(len(gap)):
                square = square + gap[a] * gap[b] * float(precision[a][b])
        s = F.sqrt(F.greatest(square, F.lit(0.0)))
        found.append(F.struct(s.alias("s"), F.lit(i).alias("i"), (s / theta).alias("grade")))
    return F.array_min(F.array(*found))["grade"]


def conditional_split(rows: DataFrame, hit: str, g: str, g0: str, bins: int = 5, least: int = 20) -> DataFrame:
    """One row ``split``: within quantile bins of g0 the hit rate of rows at or above the bin's median of g less that of rows below, weighed by rows.

    Bins of fewer than ``least`` rows, or of one side only, are left out; null if all are.
    """
    from tephra.operators.reports import quantile_bins

    edges = rows.agg(F.percentile(g0, [i / bins for i in range(1, bins)]).alias("_e"))
    binned = rows.crossJoin(F.broadcast(edges)).withColumn("_bin", quantile_bins(F.col(g0), F.col("_e")))  # one row
    middle = binned.groupBy("_bin").agg(F.percentile(g, 0.5).alias("_med"), F.count("*").alias("_n")).select(F.col("_bin").alias("_b"), "_med", "_n")
    sided = binned.join(F.broadcast(middle), F.col("_bin") == F.col("_b"))  # a row a bin
    high = F.col(g) >= F.col("_med")
    rate = F.col(hit).cast("double")
    per = sided.groupBy("_bin", "_n").agg((F.avg(F.when(high, rate)) - F.avg(F.when(~high, rate))).alias("_gap")).where((F.col("_n") >= least) & F.col("_gap").isNotNull())
    return per.agg(F.try_divide(F.sum(F.col("_n") * F.col("_gap")), F.sum("_n")).alias("split"))


def cell_stats(rows: DataFrame, cell: str, hit: Column, live: Column) -> DataFrame:
    """(cell, hits, n) of every cell over its live rows, 0 where there are none."""
    return rows.groupBy(cell).agg(F.sum(F.when(live, hit.cast("double")).otherwise(0.0)).alias("hits"), F.sum(live.cast("int")).alias("n"))


def coverage_of_cells(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Coverage weighed by rows (``atom``) and by cells (``cell``) from (hits, n)."""
    live = cells.where("n > 0")
    return live.groupBy(*by).agg((F.sum("hits") / F.sum("n")).alias("atom"), F.avg(F.col("hits") / F.col("n")).alias("cell"), F.count("*").alias("cells"))


def closest_pairs(edges: DataFrame, i: str, j: str, distance: str, cfg: Sequence[str] = ()) -> DataFrame:
    """One edge for each unordered pair i < j, that of least distance (images of a pair are several edges)."""
    columns = [c for c in edges.columns if c not in (*cfg, i, j)]
    best = edges.where(F.col(i) < F.col(j)).groupBy(*cfg, i, j).agg(F.min_by(F.struct(*columns), F.struct(distance, *columns)).alias("_r"))
    return best.select(*cfg, i, j, *[F.col(f"_r.{c}").alias(c) for c in columns])


def binned_correlation(pairs: DataFrame, distance: str, edges: Sequence[float], e_i: Sequence[str], e_j: Sequence[str], unit: Sequence[str], mean_square: float) -> DataFrame:
    """(bin, n, c, longitudinal, transverse): correlation of the errors of two points by their distance, as sums by bin that merge.

    ``mean_square`` is the mean squared error of a point. Distances outside the edges are left out.
    """
    cut = F.array(*[F.lit(float(x)) for x in edges])
    place = F.size(F.filter(cut, lambda x: x <= F.col(distance))) - 1
    dot, a, b = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for x, y, u in zip(e_i, e_j, unit, strict=True):
        dot = dot + F.col(x) * F.col(y)
        a, b = a + F.col(x) * F.col(u), b + F.col(y) * F.col(u)
    binned = pairs.select(place.alias("bin"), dot.alias("_s"), (a * b).alias("_l")).where((F.col("bin") >= 0) & (F.col("bin") < len(edges) - 1))
    sums = binned.groupBy("bin").agg(F.count("*").alias("n"), F.sum("_s").alias("_s"), F.sum("_l").alias("_l"))
    c, lon = F.col("_s") / F.col("n") / mean_square, F.col("_l") / F.col("n") / (mean_square / 3)
    return sums.select("bin", "n", c.alias("c"), lon.alias("longitudinal"), ((3 * c - lon) / 2).alias("transverse"))
