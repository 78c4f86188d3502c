"""Configurations in sections, other names for keys, and unknown keys."""

import pytest
import yaml

from latticework.errors import ConfigError
from latticework.plans import config as cf


def saved(path, data):
    path.write_text(yaml.safe_dump(data), encoding="utf-8")
    return str(path)


DATA = {"path": "u.gpkg", "layer": "units", "id_column": "id", "value_column": "v", "analysis_crs": "EPSG:31983"}


def test_sections_of_an_analysis(tmp_path):
    weights = [{"name": "rook", "type": "rook"}, {"name": "k4", "type": "knn", "k": 4}, {"name": "near", "type": "distance", "threshold": 1500, "boundary_tolerance": 0.1, "symmetrization": "none"}]
    raw = {"data": DATA, "analysis": {"primary_weight": "k4", "permutations": 199, "seed": 5, "weights": weights}, "output": {"directory": "out", "maps": False}}
    got = cf.autocorrelation(saved(tmp_path / "c.yml", raw))
    assert (got.crs, got.layer, got.primary, got.permutations, got.seed, got.maps) == (31983, "units", "k4", 199, 5, False)
    assert [(w.kind, w.symmetrization) for w in got.weights] == [("rook", "union"), ("knn", "union"), ("distance_band", "none")]
    assert got.weights[2].tolerance == 0.1 and got.output == str(tmp_path / "out")


def test_sections_of_a_regression(tmp_path):
    models = [{"name": "m", "target": "y", "predictors": ["a"], "add_constant": True, "robust_covariance": "HC1"}]
    raw = {"data": DATA, "models": models, "weights": [{"name": "w", "path": "w.csv", "transformation": "binary"}], "permutations": 99, "output": {"dir": "out"}}
    got = cf.regression(saved(tmp_path / "c.yml", raw))
    assert got.models[0].robust == "HC1" and got.weights[0].transform == "binary" and got.permutations == 99


def test_sections_of_a_preparation(tmp_path):
    raw = {"paths": {"spatial": "s.gpkg", "table": "t.csv", "output_dir": "out"}, "keys": {"spatial": "a", "table": "b"}, "crs": {"analysis": "EPSG:31983"}, "join": {"minimum_match_rate": 0.5}, "map": {"column": "x", "scheme": "quantiles", "k": 4}}
    got = cf.preparation(saved(tmp_path / "c.yml", raw))
    assert (got.spatial_key, got.table_key, got.crs, got.minimum_match_rate, got.map_classes) == ("a", "b", 31983, 0.5, 4)


@pytest.mark.parametrize("bad", [{"name": "w", "colour": 1}, {"kind": "rook"}, "rook", {"name": "w", "type": "bishop"}])
def test_errors_name_the_key(tmp_path, bad):
    with pytest.raises(ConfigError):
        cf.autocorrelation(saved(tmp_path / "c.yml", {"data": DATA, "analysis": {"weights": [bad]}, "output": "out"}))
