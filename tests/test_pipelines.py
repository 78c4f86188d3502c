"""The pipelines end to end on small lattices."""

import json
from pathlib import Path

import pytest
import yaml
from pyspark.sql import functions as F

from latticework.errors import ConfigError
from latticework.operators.geometry import box
from latticework.plans import config as cf
from latticework.plans import pipelines as pl
from latticework.sources import generators as gn
from latticework.sources import readers as rd
from latticework.sources import writers as wr
from latticework.sources.geopackage import write_geopackage


def saved(path: Path, data: dict) -> str:
    path.write_text(yaml.safe_dump(data), encoding="utf-8")
    return str(path)


def test_geopackage_round_trip(spark, tmp_path):
    shapes = gn.autocorrelation_demo(spark)
    write_geopackage(shapes, str(tmp_path / "a.gpkg"), "units", 31983)
    back, srid = rd.load_spatial(spark, str(tmp_path / "a.gpkg"))
    assert srid == 31983
    a, b = ({r.id: (r.indicador, bytes(r.geom)) for r in df.collect()} for df in (shapes, back))
    assert a == b and len(a) == 17


def test_preparation(spark, tmp_path):
    shapes, table = gn.preparation_demo(spark)
    write_geopackage(shapes, str(tmp_path / "s.gpkg"), "s", 4326)
    wr.write_csv(table, str(tmp_path / "t.csv"))
    config = saved(tmp_path / "c.yml", {"spatial": "s.gpkg", "table": "t.csv", "spatial_key": "id_territorio", "table_key": "id_territorio", "crs": 31983, "output": "out", "numeric_columns": ["indicador"], "map_column": "populacao"})
    files = pl.run_preparation(spark, config)
    quality = json.loads(Path(files["quality"]).read_text())
    assert quality["join"]["matched"] == 9 and all(Path(f).exists() for f in files.values())
    assert "joined.gpkg" in json.loads(Path(files["manifest"]).read_text())["outputs"]


def test_autocorrelation(spark, tmp_path):
    write_geopackage(gn.autocorrelation_demo(spark), str(tmp_path / "u.gpkg"), "u", 31983)
    data = {"data": {"path": "u.gpkg", "id_column": "id", "value_column": "indicador", "crs": 31983}, "output": "out", "primary": "rook", "inference": {"permutations": 19, "seed": 3},
            "weights": [{"name": "rook"}, {"name": "knn", "kind": "knn", "k": 3, "symmetrization": "union"}]}
    report = pl.run_autocorrelation(spark, saved(tmp_path / "c.yml", data))
    values = {(r["weights"], r["statistic"]): r["value"] for r in report["global"]}
    assert values["rook", "moran"] == pytest.approx(0.75731161) and values["rook", "geary"] == pytest.approx(0.18922529)
    assert report["weights"][0]["island_ids"] == "ILHA"
    assert all(Path(p).exists() for p in report["outputs"])


def test_regression(spark, tmp_path):
    units, rook, queen = gn.regression_demo(spark, 5, 5)
    shapes = units.withColumn("geom", box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).select("id", "x2", "z_spatial", "y", "geom")
    write_geopackage(shapes, str(tmp_path / "u.gpkg"), "u", 3857)
    for name, e in (("rook", rook), ("queen", queen)):
        wr.write_csv(e, str(tmp_path / f"{name}.csv"))
    data = {"data": {"path": "u.gpkg", "id_column": "id"}, "output": "out", "inference": {"permutations": 99}, "models": [{"name": "m1", "target": "y", "regressors": ["x2", "z_spatial"]}],
            "weights": [{"name": "rook", "path": "rook.csv"}, {"name": "queen", "path": "queen.csv"}], "maps": False}
    outputs = pl.run_regression(spark, saved(tmp_path / "c.yml", data))
    manifest = json.loads(Path(outputs[-1]).read_text())
    assert len(manifest["outputs"]) == len(outputs) - 1
    assert "m1 with queen" in (tmp_path / "out" / "relatorio.md").read_text()


def test_experiment(spark, tmp_path):
    data = {"dataset": {"name": "synthetic", "sample_limit": 90}, "output": "out", "models": {"M0": {"alpha": [0.1, 10.0]}, "M2U": {"n_estimators": [3], "max_depth": [4]}}, "inner_splits": 2, "permutations": 9, "k": 4,
            "designs": [{"name": "random", "kind": "random", "n_splits": 2}]}
    files = pl.run_experiment(spark, saved(tmp_path / "c.yml", data))
    assert all(Path(f).exists() for f in files.values())
    assert len(Path(files["metrics"]).read_text().splitlines()) == 1 + 2 * 2
    assert len(Path(files["predictions"]).read_text().splitlines()) == 1 + 90 * 2


def test_configuration_errors(tmp_path):
    with pytest.raises(ConfigError):
        cf.read(str(tmp_path / "none.yml"))
    with pytest.raises(ConfigError):
        cf.WeightSpec("w", "knn")
    with pytest.raises(ConfigError):
        cf.WeightSpec("w", "bishop")
    with pytest.raises(ConfigError):
        cf.Autocorrelation("i", "id", "v", 3857, "o", [cf.WeightSpec("w")], "other")
    with pytest.raises(ConfigError):
        cf.Autocorrelation("i", "id", "v", 3857, "o", [cf.WeightSpec("w")], "w", permutations=5)
    with pytest.raises(ConfigError):
        cf.need({"a": {}}, "a.b")
    assert cf.resolve("x.csv", "/some/c.yml") == "/some/x.csv"


def test_csv_points(spark, tmp_path):
    (tmp_path / "p.csv").write_text("longitude,latitude,x,median_house_value,text\n1,2,3,4,a\n1,2,,4,b\n5,6,7,8,c\n")
    data = rd.load_points(spark, str(tmp_path / "p.csv"), "median_house_value", ("longitude", "latitude"))
    assert data.frame.count() == 2 and "text" not in data.frame.columns
