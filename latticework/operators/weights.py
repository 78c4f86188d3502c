"""Spatial weights as edge tables.

Edges are ``(i, j, weight)`` over units ``(i, id)``; ``i`` and ``j`` are dense indexes.  Units
without edges (islands) exist in the unit table only.  Neighbour searches are equi-joins on
grid cells, so no pair of far units is ever formed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import WeightsError
from .lineage import cut
from .quality import normal_key

ROOK = ((-1, 0), (1, 0), (0, -1), (0, 1))
QUEEN = (*ROOK, (-1, -1), (-1, 1), (1, -1), (1, 1))


def offsets(steps: tuple[tuple[int, int], ...]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps]))


def lattice_contiguity(units: DataFrame, kind: str = "rook") -> DataFrame:
    """Binary edges of box units on a lattice ``(i, row, col)``: shared sides, or also corners."""
    if kind not in ("rook", "queen"):
        raise WeightsError(f"unknown contiguity {kind!r}")
    asked = units.select(F.col("i"), "row", "col", offsets(ROOK if kind == "rook" else QUEEN).alias("s"))
    asked = asked.select("i", (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"))
    return asked.join(units.select(F.col("i").alias("j"), "row", "col"), ["row", "col"]).select("i", "j", F.lit(1.0).alias("weight"))


def transform(edges: DataFrame, kind: str = "row_standardized") -> DataFrame:
    """``binary``: all one; ``row_standardized``: shares of the row sum, rows of sum zero go."""
    if kind == "binary":
        return edges.withColumn("weight", F.lit(1.0))
    if kind != "row_standardized":
        raise WeightsError(f"unknown transform {kind!r}")
    total = F.sum("weight").over(Window.partitionBy("i"))
    return edges.withColumn("_t", total).where("_t > 0").withColumn("weight", F.col("weight") / F.col("_t")).drop("_t")


def symmetrize(edges: DataFrame, mode: str = "none") -> DataFrame:
    """``union`` adds missing reverse edges with the same weight; ``mutual`` keeps reciprocated ones."""
    if mode == "none":
        return edges
    back = edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "weight")
    if mode == "union":
        return edges.unionByName(back.join(edges.select("i", "j"), ["i", "j"], "left_anti"))
    if mode == "mutual":
        return edges.join(back.select("i", "j"), ["i", "j"], "left_semi")
    raise WeightsError(f"unknown symmetrization {mode!r}")


def squared_distance(a: str = "", b: str = "o_") -> Column:
    dx, dy = F.col(f"{a}x") - F.col(f"{b}x"), F.col(f"{a}y") - F.col(f"{b}y")
    return dx * dx + dy * dy


def _cells(points: DataFrame, size: float) -> DataFrame:
    return points.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))


def near_pairs(query: DataFrame, reference: DataFrame, radius: float) -> DataFrame:
    """Pairs ``(i, j, d2)`` of ``query(i, x, y)`` and ``reference(i, x, y)`` at most ``radius`` apart."""
    ring = tuple((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1))
    q = _cells(query, radius).select("i", "x", "y", "cx", "cy", offsets(ring).alias("s"))
    q = q.select("i", "x", "y", (F.col("cx") + F.col("s.a")).alias("cx"), (F.col("cy") + F.col("s.b")).alias("cy"))
    r = _cells(reference, radius).select(F.col("i").alias("j"), F.col("x").alias("o_x"), F.col("y").alias("o_y"), "cx", "cy")
    pairs = q.join(r, ["cx", "cy"]).select("i", "j", squared_distance().alias("d2"))
    return pairs.where(F.col("d2") <= F.lit(radius) * F.lit(radius))


def distance_band(points: DataFrame, threshold: float, power: float = 0.0) -> DataFrame:
    """Edges between points at most ``threshold`` apart; weight 1 or distance to the minus power.

    Coincident points with a positive power are an error, as their weight is not finite."""
    if threshold <= 0 or power < 0:
        raise WeightsError("threshold must be positive and power not negative")
    pairs = near_pairs(points, points, threshold).where("i <> j")
    if power == 0:
        return pairs.select("i", "j", F.lit(1.0).alias("weight"))
    safe = F.when(F.col("d2") > 0, F.col("d2")).otherwise(F.raise_error(F.lit("coincident points have no inverse distance")).cast("double"))
    return pairs.select("i", "j", F.pow(F.sqrt(safe), F.lit(-power)).alias("weight"))


def nearest(query: DataFrame, reference: DataFrame, k: int, same: bool = False, max_rounds: int = 40) -> DataFrame:
    """The ``k`` nearest references of each query point: ``(i, j, d2, rank)``, ties to smaller j.

    Grid search with growing cells: a point is settled once ``k`` references lie within the cell
    size, which the 3 x 3 cells around it cover for sure; the others go on with cells of twice
    the size.  ``same``: both tables are one, and a point is not its own neighbour."""
    told = reference.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    have = told.n - (1 if same else 0)
    if k < 1 or have < 1:
        raise WeightsError("k and the number of points must be at least one")
    k = min(k, have)
    spread = max(told.x1 - told.x0, told.y1 - told.y0, 1e-12)
    box = query.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if box.x0 is None:
        return query.select("i", F.col("i").alias("j"), F.lit(0.0).alias("d2"), F.lit(1).alias("rank")).limit(0)
    reach = 2 * math.hypot(max(told.x1, box.x1) - min(told.x0, box.x0), max(told.y1, box.y1) - min(told.y0, box.y0)) + spread
    size = spread * math.sqrt(max(1.0, k) / told.n)
    order = Window.partitionBy("i").orderBy("d2", "j")
    left, done = query.select("i", "x", "y"), None
    for _ in range(max_rounds):
        pairs = near_pairs(left, reference, size)
        if same:
            pairs = pairs.where("i <> j")
        best = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = cut(best.withColumn("found", F.max("rank").over(Window.partitionBy("i"))).where(F.col("found") == k).drop("found"))
        done = best if done is None else done.unionByName(best)
        left = cut(left.join(best.where("rank = 1").select("i"), "i", "left_anti"))
        if size >= reach or left.isEmpty():
            break
        size *= 2
    return done


def knn(points: DataFrame, k: int, symmetrization: str = "none") -> DataFrame:
    """Binary edges to the k nearest other points; k must be below the number of points."""
    if points.limit(k + 1).count() <= k:
        raise WeightsError("k must be smaller than the number of units")
    return symmetrize(nearest(points, points, k, same=True).select("i", "j", F.lit(1.0).alias("weight")), symmetrization)


def weighted_nearest(near: DataFrame, weighting: str = "uniform", power: float = 1.0) -> DataFrame:
    """Row-standardised weights of nearest pairs: uniform, or ``1 / max(d, 1e-12) ** power``."""
    if weighting not in ("uniform", "inverse_distance"):
        raise WeightsError(f"unknown weighting {weighting!r}")
    raw = F.lit(1.0) if weighting == "uniform" else 1 / F.pow(F.greatest(F.sqrt("d2"), F.lit(1e-12)), F.lit(power))
    return transform(near.select("i", "j", raw.alias("weight")))


def from_edges(listed: DataFrame, units: DataFrame, kind: str = "row_standardized") -> DataFrame:
    """Weights from ``listed(origin_id, destination_id, weight)`` over ``units(i, id)``.

    Unknown ids and weights that are not finite, not numbers, or negative are errors; self loops
    go, repeated edges add up, zeros go."""
    edges = listed.select(normal_key("origin_id").alias("o"), normal_key("destination_id").alias("d"), F.trim(F.col("weight").cast("string")).try_cast("double").alias("w"))
    known = units.select("i", normal_key("id").alias("id"))
    ids = edges.select(F.col("o").alias("id")).union(edges.select("d"))
    unknown = [r.id for r in ids.join(known, "id", "left_anti").distinct().orderBy("id").limit(5).collect()]
    if unknown:
        raise WeightsError(f"edges name unknown units, such as {unknown}")
    bad = edges.agg(F.count_if(F.col("w").isNull() | F.isnan("w") | (F.abs("w") == float("inf")) | (F.col("w") < 0)).alias("n")).first().n
    if bad:
        raise WeightsError(f"{bad} weights are not finite numbers of at least zero")
    indexed = edges.join(known.select(F.col("id").alias("o"), "i"), "o").join(known.select(F.col("id").alias("d"), F.col("i").alias("j")), "d")
    summed = indexed.where("i <> j").groupBy("i", "j").agg(F.sum("w").alias("weight")).where("weight > 0")
    return transform(summed, kind)


def lag(edges: DataFrame, units: DataFrame, column: str = "x") -> DataFrame:
    """``(i, lag)`` for every unit; islands have lag zero."""
    values = units.select(F.col("i").alias("j"), F.col(column).alias("_v"))
    sums = edges.join(values, "j").groupBy("i").agg(F.sum(F.col("weight") * F.col("_v")).alias("lag"))
    return units.select("i").join(sums, "i", "left").select("i", F.coalesce("lag", F.lit(0.0)).alias("lag"))


def islands(edges: DataFrame, units: DataFrame) -> DataFrame:
    """Units without edges."""
    return units.join(edges.select("i").distinct(), "i", "left_anti")


def cardinalities(edges: DataFrame, units: DataFrame) -> DataFrame:
    counts = edges.groupBy("i").agg(F.count("*").alias("neighbors"))
    return units.select("i").join(counts, "i", "left").select("i", F.coalesce("neighbors", F.lit(0)).alias("neighbors"))


def components(edges: DataFrame, units: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(i, component)``: smallest index reachable along edges in either direction.

    Labels fall to the smallest of the neighbourhood and then jump to their label's label, so
    rounds grow with the logarithm of a component's diameter; each round is checkpointed."""
    both = edges.where("i <> j").select("i", "j").union(edges.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    both = cut(both)
    labels = cut(units.select("i", F.col("i").alias("component")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("i").alias("j"), F.col("component").alias("c")), "j").groupBy("i").agg(F.min("c").alias("c"))
        lower = labels.join(near, "i", "left").select("i", "component", F.least("component", F.coalesce("c", "component")).alias("low"))
        jump = lower.select(F.col("i").alias("low"), F.col("low").alias("up"))
        step = cut(lower.join(jump, "low").select("i", F.col("up").alias("component"), (F.col("up") < F.col("component")).alias("moved")))
        labels = step.select("i", "component")
        if not step.where("moved").limit(1).count():
            return labels
    raise WeightsError("components did not settle")


def diagnostics(edges: DataFrame, units: DataFrame) -> DataFrame:
    """One row: n, s0, islands, components, largest_component, min/mean/max_neighbors."""
    counts = cardinalities(edges, units).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("neighbors") == 0).alias("islands"),
        F.min("neighbors").alias("min_neighbors"),
        F.avg("neighbors").alias("mean_neighbors"),
        F.max("neighbors").alias("max_neighbors"),
    )
    s0 = edges.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("s0"))
    sizes = components(edges, units).groupBy("component").count()
    parts = sizes.agg(F.count("*").alias("components"), F.max("count").alias("largest_component"))
    return counts.join(s0).join(parts)  # three one-row tables


def island_ids(edges: DataFrame, units: DataFrame) -> list[str]:
    return [r.id for r in islands(edges, units).select("id").orderBy("id").collect()]


def edge_list(edges: DataFrame, units: DataFrame) -> DataFrame:
    """``origin_index, origin_id, destination_index, destination_id, weight``."""
    a = units.select(F.col("i").alias("origin_index"), F.col("id").alias("origin_id"))
    b = units.select(F.col("i").alias("destination_index"), F.col("id").alias("destination_id"))
    e = edges.select(F.col("i").alias("origin_index"), F.col("j").alias("destination_index"), "weight")
    return e.join(a, "origin_index").join(b, "destination_index").select("origin_index", "origin_id", "destination_index", "destination_id", "weight")
