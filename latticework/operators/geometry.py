"""Geometry in WKB columns: measures, validity, repair, contiguity, reprojection.

Geometries travel as little-endian WKB polygons and multipolygons; functions run on Arrow
batches.  Neighbour candidates come from an equi-join on the grid cells that boxes cover.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DataContractError, WeightsError
from ..functions.crs import transform_points
from .weights import transform  # noqa: F401  (used by callers next to contiguity)

Polygon = list[np.ndarray]  # rings, each n x 2 and closed; the first is the shell


def read_wkb(raw: bytes) -> list[Polygon]:
    """Polygons of a WKB polygon or multipolygon; others are an error."""
    at = 0

    def header() -> tuple[str, int]:
        nonlocal at
        order = "<" if raw[at] == 1 else ">"
        kind = struct.unpack_from(order + "I", raw, at + 1)[0] & 0xFF
        at += 5
        return order, kind

    def rings(order: str) -> Polygon:
        nonlocal at
        (n,) = struct.unpack_from(order + "I", raw, at)
        at += 4
        out = []
        for _ in range(n):
            (m,) = struct.unpack_from(order + "I", raw, at)
            out.append(np.frombuffer(raw, order + "f8", 2 * m, at + 4).reshape(m, 2).astype(float))
            at += 4 + 16 * m
        return out

    order, kind = header()
    if kind == 3:
        return [rings(order)]
    if kind != 6:
        raise DataContractError(f"geometry type {kind} is not supported")
    (n,) = struct.unpack_from(order + "I", raw, at)
    at += 4
    return [rings(header()[0]) for _ in range(n)]


def write_wkb(polygons: list[Polygon]) -> bytes:
    def body(p: Polygon) -> bytes:
        return struct.pack("<BII", 1, 3, len(p)) + b"".join(struct.pack("<I", len(r)) + np.ascontiguousarray(r, "<f8").tobytes() for r in p)

    if len(polygons) == 1:
        return body(polygons[0])
    return struct.pack("<BII", 1, 6, len(polygons)) + b"".join(map(body, polygons))


def is_empty(polygons: list[Polygon]) -> bool:
    return not any(len(p) and len(p[0]) for p in polygons)


def ring_area(ring: np.ndarray) -> float:
    d = ring - ring[0]
    return float((d[:-1, 0] * d[1:, 1] - d[1:, 0] * d[:-1, 1]).sum() / 2)


def ring_moments(ring: np.ndarray) -> tuple[float, float, float]:
    """Signed area and first moments about the ring's first point."""
    d = ring - ring[0]
    cross = d[:-1, 0] * d[1:, 1] - d[1:, 0] * d[:-1, 1]
    return float(cross.sum() / 2), float(((d[:-1, 0] + d[1:, 0]) * cross).sum() / 6), float(((d[:-1, 1] + d[1:, 1]) * cross).sum() / 6)


def area(polygons: list[Polygon]) -> float:
    return sum(abs(ring_area(p[0])) - sum(abs(ring_area(h)) for h in p[1:]) for p in polygons if p)


def perimeter(polygons: list[Polygon]) -> float:
    return float(sum(np.hypot(*np.diff(r, axis=0).T).sum() for p in polygons for r in p))


def centroid(polygons: list[Polygon]) -> tuple[float, float]:
    total = mx = my = 0.0
    for p in polygons:
        for k, ring in enumerate(p):
            a, sx, sy = ring_moments(ring)
            sign = (1 if a >= 0 else -1) * (1 if k == 0 else -1)
            total += sign * a
            mx += sign * (sx + a * ring[0, 0])
            my += sign * (sy + a * ring[0, 1])
    if total:
        return mx / total, my / total
    points = np.concatenate([r for p in polygons for r in p])
    return float(points[:, 0].mean()), float(points[:, 1].mean())


def segments(polygons: list[Polygon]) -> np.ndarray:
    """Boundary segments ``x0, y0, x1, y1``."""
    return np.concatenate([np.hstack([r[:-1], r[1:]]) for p in polygons for r in p])


def _side(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def _meet(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether each pair of segments of ``s`` and ``t`` shares a point."""
    a, b, c, d = s[:, None, :2], s[:, None, 2:], t[None, :, :2], t[None, :, 2:]
    d1, d2, d3, d4 = _side(c, d, a), _side(c, d, b), _side(a, b, c), _side(a, b, d)
    boxes = (np.minimum(a, b) <= np.maximum(c, d)).all(-1) & (np.minimum(c, d) <= np.maximum(a, b)).all(-1)
    return boxes & (d1 * d2 <= 0) & (d3 * d4 <= 0)


def touches(p: list[Polygon], q: list[Polygon]) -> bool:
    """Whether the boundaries share a point."""
    return bool(_meet(segments(p), segments(q)).any())


def shared_length(p: list[Polygon], q: list[Polygon]) -> float:
    """Length that the boundaries have in common."""
    s, t = segments(p), segments(q)
    a, b, c, d = s[:, None, :2], s[:, None, 2:], t[None, :, :2], t[None, :, 2:]
    along = b - a
    length = np.hypot(along[..., 0], along[..., 1])
    scale = np.maximum(length, np.hypot(*(d - c).transpose(2, 0, 1)))
    flat = (np.abs(_side(a, b, c)) <= 1e-12 * np.maximum(1, scale) ** 2) & (np.abs(_side(a, b, d)) <= 1e-12 * np.maximum(1, scale) ** 2) & (length > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        unit = along / length[..., None]
        u, v = ((c - a) * unit).sum(-1), ((d - a) * unit).sum(-1)
        overlap = np.minimum(length, np.maximum(u, v)) - np.maximum(0, np.minimum(u, v))
    return float(np.where(flat, np.maximum(overlap, 0), 0).sum())


def _crossing(ring: np.ndarray) -> tuple[int, int, np.ndarray] | None:
    """The first proper crossing of two segments of a ring, and its point."""
    s = np.hstack([ring[:-1], ring[1:]])
    a, b, c, d = s[:, None, :2], s[:, None, 2:], s[None, :, :2], s[None, :, 2:]
    proper = (_side(c, d, a) * _side(c, d, b) < 0) & (_side(a, b, c) * _side(a, b, d) < 0)
    found = np.argwhere(np.triu(proper))
    if not len(found):
        return None
    i, j = found[0]
    p, r, q, t = s[i, :2], s[i, 2:] - s[i, :2], s[j, :2], s[j, 2:] - s[j, :2]
    at = ((q[0] - p[0]) * t[1] - (q[1] - p[1]) * t[0]) / (r[0] * t[1] - r[1] * t[0])
    return int(i), int(j), p + at * r


def ring_valid(ring: np.ndarray) -> bool:
    if len(ring) < 4 or not np.isfinite(ring).all() or (ring[0] != ring[-1]).any() or ring_area(ring) == 0:
        return False
    s = np.hstack([ring[:-1], ring[1:]])
    met = _meet(s, s)
    n = len(s)
    k = np.arange(n)
    gap = np.abs(k[:, None] - k[None, :])
    return not (met & (gap > 1) & (gap < n - 1)).any()


def is_valid(polygons: list[Polygon]) -> bool:
    return all(all(map(ring_valid, p)) for p in polygons if p)


def make_valid(polygons: list[Polygon]) -> list[Polygon]:
    """Rings that cross themselves are split at their crossings into simple ones; parts without
    area go.  Other defects are an error."""
    out: list[Polygon] = []
    for p in polygons:
        if not p:
            continue
        todo, shells = [p[0]], []
        while todo:
            ring = todo.pop()
            hit = _crossing(ring)
            if hit is None:
                if abs(ring_area(ring)) > 0:
                    shells.append(ring)
                continue
            i, j, x = hit
            todo.append(np.vstack([x, ring[i + 1 : j + 1], x]))
            todo.append(np.vstack([ring[: i + 1], x, ring[j + 1 :]]))
        holes = p[1:]
        out += [[s, *(holes if len(shells) == 1 else [])] for s in shells]
    if not is_valid(out):
        raise DataContractError("a geometry cannot be repaired")
    return out


def reproject(polygons: list[Polygon], source: int, target: int) -> list[Polygon]:
    return [[transform_points(r, source, target) for r in p] for p in polygons]


# ---- columns -------------------------------------------------------------------------------


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """WKB of an axis-parallel box."""

    @F.pandas_udf("binary")
    def build(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([write_wkb([[np.array([(p, q), (r, q), (r, s), (p, s), (p, q)], float)]]) for p, q, r, s in zip(a, b, c, d, strict=True)])

    return build(*(c.cast("double") for c in (x0, y0, x1, y1)))


MEASURES = "type string, valid boolean, empty boolean, area double, perimeter double, cx double, cy double, xmin double, ymin double, xmax double, ymax double"


def _measure(raw: bytes | None) -> tuple:
    if raw is None:
        return (None, False, True) + (None,) * 8
    p = read_wkb(raw)
    kind = "Polygon" if raw[1 if raw[0] == 1 else 4] == 3 else "MultiPolygon"
    if is_empty(p):
        return (kind, True, True, 0.0, 0.0) + (None,) * 6
    points = np.concatenate([r for q in p for r in q])
    return (kind, is_valid(p), False, area(p), perimeter(p), *centroid(p), *points.min(axis=0).tolist(), *points.max(axis=0).tolist())


def measures(df: DataFrame, column: str = "geom") -> DataFrame:
    """Adds type, valid, empty, area, perimeter, cx, cy and bounds of each geometry.

    A null geometry is not valid and is empty."""
    names = [c.split(" ")[0] for c in MEASURES.split(", ")]

    @F.pandas_udf(MEASURES)
    def told(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_measure(None if r is None else bytes(r)) for r in raw], columns=names)

    return df.withColumn("_m", told(F.col(column))).select(*df.columns, *[F.col(f"_m.{n}").alias(n) for n in names])


def compactness(area: Column, perimeter: Column) -> Column:
    return 4 * math.pi * area / F.greatest(perimeter * perimeter, F.lit(1e-12))


def prepare(df: DataFrame, source: int | None, target: int, repair: bool = True, allow_empty: bool = False, column: str = "geom") -> tuple[DataFrame, dict]:
    """Repairs and reprojects geometries; ``(rows, report)``.  Null geometries count as invalid."""
    if source is None:
        raise DataContractError("the table has no coordinate reference system")
    before = measures(df, column).agg(F.count("*").alias("n"), F.count_if(~F.col("valid")).alias("invalid")).first()

    @F.pandas_udf("binary")
    def fixed(raw: pd.Series) -> pd.Series:
        def one(r):
            if r is None:
                return None
            p = read_wkb(bytes(r))
            return write_wkb(make_valid(p)) if not is_empty(p) and not is_valid(p) else bytes(r)

        return raw.map(one)

    @F.pandas_udf("binary")
    def moved(raw: pd.Series) -> pd.Series:
        return raw.map(lambda r: None if r is None else write_wkb(reproject(read_wkb(bytes(r)), source, target)))

    rows = df.withColumn(column, fixed(F.col(column))) if repair and before.invalid else df
    after = measures(rows, column).agg(F.count_if(~F.col("valid")).alias("invalid"), F.count_if("empty").alias("empty")).first()
    if after.invalid:
        raise DataContractError(f"{after.invalid} geometries are not valid")
    if after.empty and not allow_empty:
        raise DataContractError(f"{after.empty} geometries are empty")
    report = {"geometries": before.n, "invalid_before": before.invalid, "repaired": max(0, before.invalid - after.invalid), "invalid_after": after.invalid, "empty": after.empty}
    return (rows if source == target else rows.withColumn(column, moved(F.col(column)))), report


def spatial_metrics(df: DataFrame, column: str = "geom") -> DataFrame:
    """One row: geometries, least, median and largest area, and bounds."""
    m = measures(df.select(column), column)
    return m.agg(
        F.count("*").alias("geometries"),
        F.min("area").alias("area_min"),
        F.median("area").alias("area_median"),
        F.max("area").alias("area_max"),
        F.min("xmin").alias("xmin"),
        F.min("ymin").alias("ymin"),
        F.max("xmax").alias("xmax"),
        F.max("ymax").alias("ymax"),
    )


def type_counts(df: DataFrame, column: str = "geom") -> DataFrame:
    return measures(df.select(column), column).groupBy("type").agg(F.count("*").alias("geometries"))


def polygon_contiguity(units: DataFrame, kind: str = "rook", tolerance: float = 1e-9, column: str = "geom") -> DataFrame:
    """Binary edges of ``units(i, geom)``: rook if boundaries share more than ``tolerance`` of
    length, queen if they share a point."""
    if kind not in ("rook", "queen"):
        raise WeightsError(f"unknown contiguity {kind!r}")
    m = measures(units.select("i", column), column).where("not empty").select("i", column, "xmin", "ymin", "xmax", "ymax")
    size = m.agg(F.avg(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")))).first()[0] or 1.0
    pad = F.lit(max(tolerance, 1e-9))
    cell = lambda low, high: F.sequence(F.floor((F.col(low) - pad) / size), F.floor((F.col(high) + pad) / size))
    cells = m.withColumn("gx", F.explode(cell("xmin", "xmax"))).withColumn("gy", F.explode(cell("ymin", "ymax")))
    boxes = cells.select("i", "gx", "gy", "xmin", "ymin", "xmax", "ymax")
    other = boxes.select(F.col("i").alias("j"), "gx", "gy", *[F.col(c).alias(f"o_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    near = F.expr("i < j and xmin <= o_xmax and o_xmin <= xmax and ymin <= o_ymax and o_ymin <= ymax")
    pairs = boxes.join(other, ["gx", "gy"]).where(near).select("i", "j").distinct()
    shapes = m.select("i", column)
    both = pairs.join(shapes.withColumnRenamed(column, "a"), "i").join(shapes.select(F.col("i").alias("j"), F.col(column).alias("b")), "j")

    @F.pandas_udf("boolean")
    def joined(a: pd.Series, b: pd.Series) -> pd.Series:
        test = touches if kind == "queen" else lambda p, q: shared_length(p, q) > tolerance
        return pd.Series([test(read_wkb(bytes(p)), read_wkb(bytes(q))) for p, q in zip(a, b, strict=True)])

    found = both.where(joined("a", "b")).select("i", "j")
    return found.union(found.select(F.col("j"), F.col("i"))).select("i", "j", F.lit(1.0).alias("weight"))
