"""Spatially blocked validation: groups, folds, buffers, metrics, intervals, reports."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, DataContractError
from .weights import near_pairs


@dataclass(frozen=True)
class Design:
    """A validation design: ``random`` folds, or ``spatial`` folds of grid groups with a buffer."""

    name: str
    kind: str
    n_splits: int = 5
    n_rows: int | None = None
    n_cols: int | None = None
    buffer_distance: float = 0.0


def _edges(points: DataFrame, axis: str, parts: int) -> list[float]:
    shares = [k / parts for k in range(parts + 1)]
    got = points.agg(F.percentile(axis, F.array(*map(F.lit, shares))).alias("q")).first().q
    out = sorted(set(got or []))
    if len(out) < 3:
        raise DataContractError(f"too few distinct values of {axis!r} for a grid")
    return out


def grid_groups(points: DataFrame, n_cols: int = 5, n_rows: int = 5) -> DataFrame:
    """``(i, grp)``: cells of a quantile grid over ``points(i, x, y)``."""
    if n_cols < 2 or n_rows < 2:
        raise ConfigError("a grid needs at least two rows and two columns")
    ex, ey = _edges(points, "x", n_cols), _edges(points, "y", n_rows)

    def bin_of(axis: str, edges: list[float]) -> Column:
        return sum(((F.col(axis) >= e).cast("int") for e in edges[2:-1]), (F.col(axis) >= edges[1]).cast("int"))

    return points.select("i", (bin_of("y", ey) * (len(ex) - 1) + bin_of("x", ex)).alias("grp"))


def random_folds(rows: DataFrame, n_splits: int, seed: int) -> DataFrame:
    """``(i, fold)``: balanced folds in the order of ``md5(seed:i)``.

    Ranks come from hash prefixes: counts of 4096 prefixes give offsets, so no window spans all rows."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("i").cast("string")))
    keyed = rows.select("i", key.alias("k")).withColumn("c", F.substring("k", 1, 3))
    counts = keyed.groupBy("c").agg(F.count("*").alias("n"))
    starts = counts.select("c", (F.sum("n").over(Window.orderBy("c")) - F.col("n")).alias("s"))  # 4096 rows at most
    inside = F.row_number().over(Window.partitionBy("c").orderBy("k", "i"))
    placed = keyed.withColumn("r", inside).join(F.broadcast(starts), "c")
    return placed.select("i", ((F.col("s") + F.col("r") - 1) % n_splits).cast("int").alias("fold"))


def group_folds(groups: DataFrame, n_splits: int) -> DataFrame:
    """``(grp, fold)``: groups by falling size to the lightest fold; ties to the smaller group and fold."""
    sizes = [(r["n"], r.grp) for r in groups.groupBy("grp").agg(F.count("*").alias("n")).collect()]  # one row per grid cell
    if len(sizes) < n_splits:
        raise DataContractError("fewer groups than folds")
    load = [0] * n_splits
    rows = []
    for n, grp in sorted(sizes, key=lambda s: (-s[0], s[1])):
        fold = min(range(n_splits), key=lambda k: (load[k], k))
        load[fold] += n
        rows.append((grp, fold))
    return groups.sparkSession.createDataFrame(rows, "grp int, fold int")


def buffered(train: DataFrame, test: DataFrame, distance: float) -> DataFrame:
    """Train rows whose nearest test point is farther than ``distance``; three must stay."""
    if distance <= 0:
        return train
    close = near_pairs(train, test, distance).select("i").distinct()
    left = train.join(close, "i", "left_anti")
    if left.limit(3).count() < 3:
        raise DataContractError("the buffer leaves fewer than three training rows")
    return left


def design_groups(points: DataFrame, design: Design) -> DataFrame:
    """Groups of a design; -1 for random ones."""
    if design.kind == "random":
        return points.select("i", F.lit(-1).alias("grp"))
    return grid_groups(points, design.n_cols, design.n_rows)


def folds(points: DataFrame, design: Design, seed: int) -> DataFrame:
    """``(i, fold)``: the fold in which a row is tested."""
    if design.kind == "random":
        return random_folds(points, design.n_splits, seed)
    if design.kind != "spatial":
        raise ConfigError(f"unknown validation kind {design.kind!r}")
    if not design.n_rows or not design.n_cols:
        raise ConfigError("a spatial design needs n_rows and n_cols")
    groups = grid_groups(points, design.n_cols, design.n_rows)
    return groups.join(F.broadcast(group_folds(groups, design.n_splits)), "grp").select("i", "fold")


def splits(points: DataFrame, design: Design, seed: int):
    """Yields ``(fold, train, test)`` of ``points(i, x, y, ..)``, the buffer taken out of train."""
    placed = points.join(folds(points, design, seed), "i").cache()
    for fold in range(design.n_splits):
        test = placed.where(F.col("fold") == fold).drop("fold")
        train = placed.where(F.col("fold") != fold).drop("fold")
        yield fold, buffered(train, test, design.buffer_distance if design.kind == "spatial" else 0.0), test


def regression_metrics(rows: DataFrame, by: list[str] = (), truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """rmse, mae and r2 of each group, in one aggregate."""
    y, e = F.col(truth), F.col(truth) - F.col(guess)
    sst = F.var_pop(y) * F.count(y)
    return rows.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.sum(e * e), sst)).alias("r2"))


def interval_metrics(rows: DataFrame, by: list[str] = (), truth: str = "y_true") -> DataFrame:
    """Share of truths inside ``[lower, upper]`` and mean width."""
    inside = F.col(truth).between(F.col("lower"), F.col("upper"))
    return rows.groupBy(*by).agg(F.avg(inside.cast("double")).alias("interval_coverage"), F.avg(F.col("upper") - F.col("lower")).alias("interval_width"))


def conformal_quantile(rows: DataFrame, column: str, coverage: float) -> float:
    """The residual of rank ``ceil((n + 1) * coverage)``, at most n.

    Found by halving the value range with counts, so residuals are never sorted in one place."""
    n = rows.where(F.col(column).isNotNull()).count()
    if not n:
        raise DataContractError("no residuals to take a quantile of")
    rank = min(n, max(1, math.ceil((n + 1) * coverage)))
    # The share lies strictly between two ranks' interpolation points; discrete percentiles pick whole ranks.
    share = (rank - 0.5) / n
    return rows.select(F.expr(f"percentile_disc({share!r}D) within group (order by {column})")).first()[0]


def optimism(metrics: DataFrame) -> DataFrame:
    """Median rmse of each design and model against the design named ``random``."""
    medians = metrics.groupBy("validation", "model").agg(F.median("rmse").alias("rmse"))
    random = medians.where("validation = 'random'").select("model", F.col("rmse").alias("rmse_random"))
    other = medians.where("validation <> 'random'").withColumnRenamed("rmse", "rmse_spatial").join(random, "model", "left")
    return other.select("validation", "model", "rmse_spatial", "rmse_random", ((F.col("rmse_spatial") - F.col("rmse_random")) / F.col("rmse_random")).alias("optimism_relative"))


def summary(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Median, mean and sample deviation of columns by design and model."""
    stats = [f(c).alias(f"{c}_{name}") for c in columns for name, f in (("median", F.median), ("mean", F.avg), ("std", F.stddev_samp))]
    return metrics.groupBy("validation", "model").agg(*stats)


def gates(metrics: DataFrame, local: DataFrame, coverage_target: float, baseline: str = "M0") -> DataFrame:
    """Per model: designs in which its median rmse beats the baseline's, share of local clusters
    that are significant, and median coverage against the target."""
    medians = metrics.groupBy("validation", "model").agg(F.median("rmse").alias("rmse"), F.median("interval_coverage").alias("coverage"))
    base = medians.where(F.col("model") == baseline).select("validation", F.col("rmse").alias("base"))
    wins = medians.join(base, "validation").groupBy("model").agg(F.count_if(F.col("rmse") < F.col("base")).alias("wins"), F.count("*").alias("designs"), F.median("coverage").alias("coverage_median"))
    shares = local.groupBy("model").agg(F.avg((F.col("cluster") != "NS").cast("double")).alias("significant_share"))
    return wins.join(shares, "model", "left").withColumn("coverage_reached", F.col("coverage_median") >= coverage_target)
