"""GeoPackage source and sink: SQLite tables whose geometry blobs carry a header before the WKB."""

from __future__ import annotations

import os
import sqlite3
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from ..errors import DataContractError

ROWS_A_PART = 50_000
ENVELOPE_BYTES = (0, 32, 48, 48, 64)


@dataclass(frozen=True)
class LayerInfo:
    table: str
    geometry: str
    srid: int | None
    columns: list[tuple[str, str]]


def _connect(path: str) -> sqlite3.Connection:
    if not os.path.exists(path):
        raise DataContractError(f"{path} does not exist")
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def layer_info(path: str, layer: str | None = None) -> LayerInfo:
    with _connect(path) as db:
        found = db.execute("select table_name, column_name, srs_id from gpkg_geometry_columns order by table_name").fetchall()
        chosen = [f for f in found if layer is None or f[0] == layer]
        if not chosen:
            raise DataContractError(f"{path} has no layer {layer!r}")
        table, geometry, srs = chosen[0]
        org = db.execute("select organization_coordsys_id from gpkg_spatial_ref_sys where srs_id = ?", (srs,)).fetchone()
        columns = [(r[1], (r[2] or "").upper()) for r in db.execute(f'pragma table_info("{table}")')]
    return LayerInfo(table, geometry, org[0] if org and org[0] > 0 else None, columns)


def strip_header(blob: bytes | None) -> bytes | None:
    """WKB of a GeoPackage blob."""
    if blob is None:
        return None
    if blob[:2] != b"GP":
        raise DataContractError("a geometry blob has no GeoPackage header")
    return blob[8 + ENVELOPE_BYTES[(blob[3] >> 1) & 7] :]


@dataclass
class _Rows(InputPartition):
    low: int
    high: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, info: LayerInfo):
        self.path, self.info = path, info

    def partitions(self) -> list[_Rows]:
        with _connect(self.path) as db:
            low, high = db.execute(f'select min(rowid), max(rowid) from "{self.info.table}"').fetchone()
        if low is None:
            return [_Rows(0, 0)]
        return [_Rows(a, min(high + 1, a + ROWS_A_PART)) for a in range(low, high + 1, ROWS_A_PART)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        names = [c for c, _ in self.info.columns]
        at = names.index(self.info.geometry)
        with _connect(self.path) as db:
            listed = ", ".join(f'"{c}"' for c in names)
            for row in db.execute(f'select {listed} from "{self.info.table}" where rowid >= ? and rowid < ? order by rowid', (partition.low, partition.high)):
                yield tuple(strip_header(v) if k == at else v for k, v in enumerate(row))


class GeoPackage(DataSource):
    """``spark.read.format("gpkg").option("layer", name).load(path)``; the geometry is ``geom``."""

    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def _info(self) -> LayerInfo:
        return layer_info(self.options["path"], self.options.get("layer"))

    def schema(self) -> StructType:
        info = self._info()

        def field(name: str, kind: str) -> StructField:
            if name == info.geometry:
                return StructField("geom", BinaryType())
            return StructField(name, LongType() if "INT" in kind else DoubleType() if kind.startswith(("REAL", "DOUBLE", "FLOAT")) else BinaryType() if kind == "BLOB" else StringType())

        return StructType([field(*c) for c in info.columns])

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], self._info())


def write_geopackage(df: DataFrame, path: str, layer: str, srid: int, column: str = "geom") -> str:
    """Write rows to one file, replacing it; rows stream through the driver one partition at a time."""
    if os.path.exists(path):
        os.remove(path)
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "boolean": "INTEGER"}
    names = [c for c in df.columns if c != column and c.lower() != "fid"]  # the file numbers its rows itself
    listed = ", ".join(f'"{c}" {kinds.get(dict(df.dtypes)[c], "TEXT")}' for c in names)
    with sqlite3.connect(path) as db:
        db.execute("pragma application_id = 1196444487")
        db.execute("pragma user_version = 10300")
        db.execute("create table gpkg_spatial_ref_sys (srs_name text not null, srs_id integer primary key, organization text not null, organization_coordsys_id integer not null, definition text not null, description text)")
        db.execute("create table gpkg_contents (table_name text primary key, data_type text not null, identifier text unique, description text default '', last_change datetime, min_x double, min_y double, max_x double, max_y double, srs_id integer)")
        db.execute("create table gpkg_geometry_columns (table_name text, column_name text, geometry_type_name text not null, srs_id integer not null, z tinyint not null, m tinyint not null, primary key (table_name, column_name))")
        db.execute("insert into gpkg_spatial_ref_sys values (?, ?, 'EPSG', ?, 'undefined', null)", (f"EPSG:{srid}", srid, srid))
        db.execute("insert into gpkg_contents (table_name, data_type, identifier, srs_id) values (?, 'features', ?, ?)", (layer, layer, srid))
        db.execute("insert into gpkg_geometry_columns values (?, 'geom', 'GEOMETRY', ?, 0, 0)", (layer, srid))
        db.execute(f'create table "{layer}" (fid integer primary key autoincrement, geom blob{", " + listed if listed else ""})')
        header = b"GP\x00\x01" + struct.pack("<i", srid)
        marks = ", ".join("?" * (1 + len(names)))
        quoted = "".join(f', "{c}"' for c in names)

        def plain(v):
            return v if v is None or isinstance(v, int | float | str) else str(v)

        rows = ((None if r[column] is None else header + bytes(r[column]), *(plain(r[c]) for c in names)) for r in df.toLocalIterator())
        db.executemany(f'insert into "{layer}" (geom{quoted}) values ({marks})', rows)
    return path
