"""Shapefile source: polygons or points with their attribute table."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from ..errors import DataContractError

ROWS_A_PART = 10_000


def epsg_of(path: str) -> int | None:
    """EPSG code from the .prj file: an authority tag, or a plain geographic system."""
    prj = path[:-4] + ".prj"
    if not os.path.exists(prj):
        return None
    text = open(prj, encoding="utf-8", errors="replace").read()
    tags = re.findall(r'AUTHORITY\["EPSG",\s*"?(\d+)"?\]', text)
    if tags:
        return int(tags[-1])
    return 4326 if text.startswith("GEOGCS") and "WGS" in text else None


def _fields(path: str) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    with open(path[:-4] + ".dbf", "rb") as f:
        head = f.read(32)
        rows, start, width = struct.unpack("<IHH", head[4:12])
        out = []
        while (raw := f.read(32)) and raw[:1] != b"\r":
            out.append((raw[:11].split(b"\0")[0].decode("latin-1"), chr(raw[11]), raw[16], raw[17]))
    return rows, start, width, out


def _polygons(raw: bytes) -> bytes | None:
    """WKB of a polygon record: clockwise rings are shells, the others holes of the shell around them."""
    from ..operators.geometry import ring_area, write_wkb

    parts, n = struct.unpack_from("<2i", raw, 36)
    starts = [*struct.unpack_from(f"<{parts}i", raw, 44), n]
    points = np.frombuffer(raw, "<f8", 2 * n, 44 + 4 * parts).reshape(n, 2)
    rings = [points[a:b].copy() for a, b in zip(starts, starts[1:], strict=False)]
    shells = [[r] for r in rings if ring_area(r) <= 0]
    for hole in (r for r in rings if ring_area(r) > 0):
        home = next((s for s in shells if _inside(hole[0], s[0])), None)
        if home is None:
            shells.append([hole])
        else:
            home.append(hole)
    return write_wkb(shells) if shells else None


def _inside(point: np.ndarray, ring: np.ndarray) -> bool:
    x, y = point
    a, b = ring[:-1], ring[1:]
    cross = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
    return bool((cross & (x < at)).sum() % 2)


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Rows]:
        n = _fields(self.path)[0]
        return [_Rows(a, min(n, a + ROWS_A_PART)) for a in range(0, max(1, n), ROWS_A_PART)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        _, start, width, fields = _fields(self.path)
        with open(self.path[:-4] + ".shx", "rb") as x, open(self.path, "rb") as shp, open(self.path[:-4] + ".dbf", "rb") as dbf:
            for k in range(partition.low, partition.high):
                x.seek(100 + 8 * k)
                at, length = struct.unpack(">2i", x.read(8))
                shp.seek(2 * at + 8)
                raw = shp.read(2 * length)
                kind = struct.unpack_from("<i", raw)[0]
                geom = _polygons(raw) if kind in (5, 15, 25) else struct.pack("<BI", 1, 1) + raw[4:20] if kind == 1 else None
                dbf.seek(start + width * k)
                row, offset, out = dbf.read(width), 1, []
                for _, type_, size, decimals in fields:
                    text = row[offset : offset + size].decode("utf-8", "replace").strip("\0 ")
                    offset += size
                    if type_ in "NF":
                        out.append(None if not text or "*" in text else int(text) if type_ == "N" and decimals == 0 else float(text))
                    else:
                        out.append(text or None)
                yield (*out, geom)


class Shapefile(DataSource):
    """``spark.read.format("shapefile").load(path)``; the geometry is the column ``geom``."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> StructType:
        path = self.options["path"]
        if not os.path.exists(path):
            raise DataContractError(f"{path} does not exist")
        kinds = {"N": LongType(), "F": DoubleType()}
        fields = [StructField(n, DoubleType() if k == "N" and d else kinds.get(k, StringType())) for n, k, _, d in _fields(path)[3]]
        return StructType([*fields, StructField("geom", BinaryType())])

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"])
