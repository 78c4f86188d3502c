"""Shapefiles, digests of input folders, country features, residual layers and streams."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from latticework.operators import geometry as ge
from latticework.plans import pipelines as pl
from latticework.sources import readers as rd
from latticework.sources import writers as wr
from latticework.streaming import missing_counts_by_window


def write_shapefile(path, squares):
    """Unit squares ``(x, y, name, value)`` as .shp, .shx and .dbf by the published layout."""
    records, index, offset = b"", b"", 50
    for k, (x, y, _, _) in enumerate(squares):
        ring = [(x, y), (x, y + 1), (x + 1, y + 1), (x + 1, y), (x, y)]
        content = struct.pack("<i4d2i", 5, x, y, x + 1, y + 1, 1, 5) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in ring)
        records += struct.pack(">2i", k + 1, len(content) // 2) + content
        index += struct.pack(">2i", offset, len(content) // 2)
        offset += 4 + len(content) // 2
    box = struct.pack("<8d", 0, 0, 99, 99, 0, 0, 0, 0)
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + n) // 2) + struct.pack("<2i", 1000, 5) + box
    path.with_suffix(".shp").write_bytes(head(len(records)) + records)
    path.with_suffix(".shx").write_bytes(head(len(index)) + index)
    fields = [("name", "C", 8, 0), ("value", "N", 10, 0)]
    table = b"".join(b" " + n.encode().ljust(8) + (b"" if v is None else str(v).encode()).rjust(10) for _, _, n, v in squares)
    described = b"".join(n.encode().ljust(11, b"\0") + t.encode() + bytes(4) + bytes([size, dec]) + bytes(14) for n, t, size, dec in fields)
    start = 32 + len(described) + 1
    path.with_suffix(".dbf").write_bytes(struct.pack("<4BIHH20x", 3, 126, 1, 1, len(squares), start, 19) + described + b"\r" + table + b"\x1a")
    return str(path.with_suffix(".shp"))


def test_shapefile(spark, tmp_path):
    path = write_shapefile(tmp_path / "s", [(0, 0, "a", 3), (1, 0, "b", None), (5, 5, "c", -7)])
    got, _ = rd.load_spatial(spark, path)
    rows = {r.name: (r.value, r.area, r.xmin) for r in ge.measures(got).collect()}
    assert rows == {"a": (3, 1.0, 0.0), "b": (None, 1.0, 1.0), "c": (-7, 1.0, 5.0)}


def test_digest_of_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    want = {}
    for name in ("a.txt", "b.txt"):
        (tmp_path / "in" / name).write_bytes(name.encode() * 9)
        want[name] = (45, hashlib.sha256(name.encode() * 9).hexdigest())
    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in wr.digest_tree(spark, str(tmp_path / "in")).collect()}
    assert got == want


def test_countries(spark):
    rows = [("A", "AAA", "Europe", 10.0, 5.0, 0), ("B", "BBB", "North America", 20.0, 6.0, 2), ("C", "CCC", "Antarctica", 1.0, 1.0, 4), ("D", "DDD", "Europe", 0.0, 1.0, 6)]
    shapes = spark.createDataFrame(rows, "n string, c string, k string, p double, g double, x int").withColumn("geom", ge.box(F.col("x").cast("double"), F.lit(0.0), F.col("x") + 1.0, F.lit(1.0)))
    got = {r.iso_a3: r for r in pl.prepare_countries(shapes, 4326, {"name": "n", "iso": "c", "continent": "k", "population": "p", "product": "g"}, ["Antarctica"]).collect()}
    assert set(got) == {"AAA", "BBB"} and (got["AAA"].continent_europe, got["BBB"].continent_north_america) == (1.0, 1.0)
    import math

    assert got["AAA"].log_gdp_md_est == pytest.approx(math.log1p(5.0)) and math.expm1(got["AAA"].log_area_km2) == pytest.approx(12_308, rel=0.01)


def test_residual_layers(spark):
    predictions = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, -1.0)], "row_id long, residual double")
    local = spark.createDataFrame([(1, "HH"), (1, "NS"), (2, "NS")], "row_id long, cluster string")
    got = {r.row_id: (r.mean_residual, r.significant_share) for r in pl.residual_layers(predictions, local).collect()}
    assert got == {1: (3.0, 0.5), 2: (-1.0, 0.0)}


def test_counts_over_a_stream(spark, tmp_path):
    frame = spark.createDataFrame([(f"2020-01-01 00:0{k}:00", None if k % 2 else k) for k in range(4)], "t string, v int").select(F.col("t").cast("timestamp").alias("t"), "v")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = missing_counts_by_window(stream, "t", ["v"]).writeStream.format("memory").queryName("told").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r.rows, r.missing_v) for r in spark.table("told").collect()] == [(4, 2)]
