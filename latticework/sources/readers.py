"""Tables, edge lists and points from files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, DataContractError

EDGE_SCHEMA = "origin_id string, destination_id string, weight string"


def not_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise DataContractError(f"{what} is empty")
    return df


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV, Parquet or (with openpyxl) Excel, told by the suffix; must hold rows.

    CSV columns stay text, so keys keep leading zeros; contracts parse the numbers."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        df = spark.read.option("header", True).csv(path)
    elif suffix == "parquet":
        df = spark.read.parquet(path)
    elif suffix in ("xlsx", "xls"):
        import pandas as pd

        df = spark.createDataFrame(pd.read_excel(path, dtype=str))
    else:
        raise DataContractError(f"unsupported table format {suffix!r}")
    return not_empty(df, path)


def load_spatial(spark: SparkSession, path: str, layer: str | None = None) -> tuple[DataFrame, int | None]:
    """Rows with a WKB column ``geom``, and the EPSG code: GeoPackage, shapefile, or Parquet whose
    ``geom`` field names ``srid`` in its metadata."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        df = spark.read.parquet(path)
        if "geom" not in df.columns:
            raise DataContractError("the table has no column 'geom'")
        srid = df.schema["geom"].metadata.get("srid")
    elif suffix == "gpkg":
        from .geopackage import GeoPackage, layer_info

        spark.dataSource.register(GeoPackage)
        info = layer_info(path, layer)
        srid = info.srid
        df = spark.read.format("gpkg").option("layer", info.table).load(path)
    elif suffix == "shp":
        from .shapefile import Shapefile, epsg_of

        spark.dataSource.register(Shapefile)
        srid = epsg_of(path)
        df = spark.read.format("shapefile").load(path)
    else:
        raise DataContractError(f"unsupported spatial format {suffix!r}")
    return not_empty(df, path), srid


def load_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edge list with text ids; weights are parsed by the weights contract."""
    df = spark.read.option("header", True).csv(path)
    missing = [c for c in ("origin_id", "destination_id", "weight") if c not in df.columns]
    if missing:
        raise DataContractError(f"the edge list lacks columns {missing}")
    return df.select("origin_id", "destination_id", "weight")


@dataclass(frozen=True)
class SpatialDataset:
    frame: DataFrame  # i and numeric columns only
    target: str
    coordinates: tuple[str, str]


def sampled(df: DataFrame, n: int | None, seed: int) -> DataFrame:
    """The ``n`` rows of least ``md5(seed:i)``: the same ones for any partitioning."""
    if n is None:
        return df
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("i").cast("string"))), "i").limit(n)


def load_points(spark: SparkSession, path: str, target: str, coordinates: tuple[str, str], sample_limit: int | None = None, seed: int = 0) -> SpatialDataset:
    """CSV points: numeric columns only, rows without nulls, optionally sampled."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    missing = [c for c in (target, *coordinates) if c not in df.columns]
    if missing:
        raise DataContractError(f"columns are missing: {missing}")
    numeric = [c for c, kind in df.dtypes if kind in ("int", "bigint", "double", "float", "smallint", "tinyint") or kind.startswith("decimal")]
    wrong = [c for c in (target, *coordinates) if c not in numeric]
    if wrong:
        raise DataContractError(f"columns are not numeric: {wrong}")
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in numeric]).dropna()
    rows = rows.withColumn("i", F.monotonically_increasing_id())
    return SpatialDataset(sampled(rows, sample_limit, seed), target, coordinates)


def load_dataset(spark: SparkSession, name: str, sample_limit: int | None = None, seed: int = 0, **options) -> SpatialDataset:
    """``synthetic`` (600 rows unless limited), ``csv``, or ``california`` from a local file."""
    from .generators import synthetic_points

    if name == "synthetic":
        return synthetic_points(spark, sample_limit or 600, seed)
    if name in ("csv", "california"):
        if "path" not in options:
            raise ConfigError(f"the dataset {name!r} needs the path of a local file")
        target = options.get("target_column", "MedHouseVal" if name == "california" else None)
        coordinates = tuple(options.get("coordinate_columns", ("Longitude", "Latitude")))
        if not target:
            raise ConfigError("the dataset 'csv' needs target_column")
        return load_points(spark, options["path"], target, coordinates, sample_limit, seed)
    raise ConfigError(f"unknown dataset {name!r}")
