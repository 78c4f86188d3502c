"""Coordinate transformations between EPSG 4326, 3857, 31983 and 6933, by their formulas."""

from __future__ import annotations

import math

import numpy as np

from ..errors import DataContractError

# Axes and flattenings of WGS 84 and GRS 80.
WGS84 = (6378137.0, 1 / 298.257223563)
GRS80 = (6378137.0, 1 / 298.257222101)
GEOGRAPHIC = {4326: True, 4674: True, 3857: False, 31983: False, 6933: False}


def is_geographic(srid: int) -> bool:
    if srid not in GEOGRAPHIC:
        raise DataContractError(f"EPSG:{srid} is not known")
    return GEOGRAPHIC[srid]


class Utm:
    """Transverse Mercator by Krueger's series, to the fourth order."""

    def __init__(self, lon0: float, north0: float, ellipsoid: tuple[float, float] = GRS80, scale: float = 0.9996, east0: float = 500000.0):
        a, f = ellipsoid
        n = f / (2 - f)
        self.e = math.sqrt(f * (2 - f))
        self.lon0, self.north0, self.east0 = math.radians(lon0), north0, east0
        self.radius = scale * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        self.alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
        self.beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)

    def forward(self, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lon, lat = np.radians(lon) - self.lon0, np.radians(lat)
        t = np.sinh(np.arctanh(np.sin(lat)) - self.e * np.arctanh(self.e * np.sin(lat)))
        xi, eta = np.arctan2(t, np.cos(lon)), np.arcsinh(np.sin(lon) / np.hypot(t, np.cos(lon)))
        x, y = eta.copy(), xi.copy()
        for k, a in enumerate(self.alpha, start=1):
            x += a * np.cos(2 * k * xi) * np.sinh(2 * k * eta)
            y += a * np.sin(2 * k * xi) * np.cosh(2 * k * eta)
        return self.east0 + self.radius * x, self.north0 + self.radius * y

    def inverse(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        xi, eta = (y - self.north0) / self.radius, (x - self.east0) / self.radius
        u, v = xi.copy(), eta.copy()
        for k, b in enumerate(self.beta, start=1):
            u -= b * np.sin(2 * k * xi) * np.cosh(2 * k * eta)
            v -= b * np.cos(2 * k * xi) * np.sinh(2 * k * eta)
        t = np.sin(u) / np.cosh(v)
        lon = self.lon0 + np.arctan2(np.sinh(v), np.cos(u))
        sin_lat = t
        for _ in range(8):  # isometric latitude back to the geographic one
            sin_lat = np.tanh(np.arctanh(t) + self.e * np.arctanh(self.e * sin_lat))
        return np.degrees(lon), np.degrees(np.arcsin(sin_lat))


class EqualArea:
    """Ellipsoidal cylindrical equal-area projection, standard parallel 30 degrees."""

    def __init__(self, parallel: float = 30.0, ellipsoid: tuple[float, float] = WGS84):
        a, f = ellipsoid
        self.e = math.sqrt(f * (2 - f))
        s = math.sin(math.radians(parallel))
        self.k = a * math.cos(math.radians(parallel)) / math.sqrt(1 - (self.e * s) ** 2)
        self.a = a

    def q(self, s: np.ndarray) -> np.ndarray:
        return (1 - self.e**2) * (s / (1 - (self.e * s) ** 2) + np.arctanh(self.e * s) / self.e)

    def forward(self, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.k * np.radians(lon), self.a**2 / (2 * self.k) * self.q(np.sin(np.radians(lat)))

    def inverse(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        want = 2 * self.k * y / self.a**2
        lat = np.arcsin(np.clip(want / self.q(np.array(1.0)), -1, 1))
        for _ in range(20):
            s, c = np.sin(lat), np.cos(lat)
            slope = 2 * (1 - self.e**2) * c / (1 - (self.e * s) ** 2) ** 2
            lat = lat + np.where(np.abs(slope) > 1e-12, (want - self.q(s)) / np.where(slope == 0, 1, slope), 0)
        return np.degrees(x / self.k), np.degrees(lat)


class WebMercator:
    radius = WGS84[0]

    def forward(self, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.radius * np.radians(lon), self.radius * np.arcsinh(np.tan(np.radians(lat)))

    def inverse(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.degrees(x / self.radius), np.degrees(np.arctan(np.sinh(y / self.radius)))


PROJECTIONS = {3857: WebMercator(), 31983: Utm(-45.0, 10_000_000.0), 6933: EqualArea()}


def transform_points(points: np.ndarray, source: int, target: int) -> np.ndarray:
    """``n x 2`` points (longitude or easting first) in another system."""
    if source == target:
        return points
    is_geographic(source), is_geographic(target)
    x, y = points[:, 0].astype(float), points[:, 1].astype(float)
    lon, lat = PROJECTIONS[source].inverse(x, y) if source in PROJECTIONS else (x, y)
    x, y = PROJECTIONS[target].forward(lon, lat) if target in PROJECTIONS else (lon, lat)
    out = np.column_stack([x, y])
    if not np.isfinite(out).all():
        raise DataContractError("points lie outside the projection's domain")
    return out
