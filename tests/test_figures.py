"""Figures of an experiment."""

import xml.etree.ElementTree as ET

from latticework.plans.pipelines import _figures
from latticework.sources import writers as wr

KEY = "validation string, repetition int, fold int, model string"


def test_every_point_and_bar_is_drawn(spark, tmp_path):
    keys = [("random", 0, 0, "M0"), ("random", 0, 1, "M0"), ("blocks <1>", 0, 0, "M0")]
    table = spark.createDataFrame([(*k, 1.0 + i) for i, k in enumerate(keys)], f"{KEY}, rmse double")
    predictions = spark.createDataFrame([(*k, i, float(i), float(-i), (-1.0) ** i * i) for k in keys for i in range(4)], f"{KEY}, row_id long, longitude double, latitude double, residual double")
    local = spark.createDataFrame([(*k, i, c) for k in keys for i, c in enumerate(("HH", "LL", "NS", "HL"))], f"{KEY}, row_id long, cluster string")
    files = _figures(table, predictions, local, str(tmp_path))
    assert len(files) == 1 + 2 * 2
    count = lambda name, tag: len(ET.parse(files[name]).getroot().findall(f"{{http://www.w3.org/2000/svg}}{tag}"))
    assert count("figure_rmse", "rect") == 2
    assert count("figure_residuals_random_M0", "circle") == count("figure_lisa_random_M0", "circle") == 8
    colours = [r.c for r in spark.createDataFrame([(-2.0,), (0.0,), (2.0,), (None,)], "r double").select(wr.signed_colours("r", 2.0).alias("c")).collect()]
    assert colours == ["#0000e6", "#e6e6e6", "#e60000", wr.MISSING]
