"""Conditional permutations with unequal weights against the law; places at every prefix length."""

import numpy as np
import pytest

from latticework.operators import autocorrelation as ac


@pytest.mark.parametrize("k", [4, 7])
def test_drawn_values_fall_on_weights_at_random(spark, k):
    z = np.array([-3.0, -1.5, -1.0, -0.5, 0.0, 0.5, 1.5, 4.0])
    units = spark.createDataFrame([(i, float(v)) for i, v in enumerate(z)], "i long, z double")
    near = [(i, j, 1.0 / (1 + (j - i) % 8) ** 2) for i in range(8) for j in sorted((i + d) % 8 for d in range(1, k + 1))]
    edges = spark.createDataFrame(near, "i long, j long, weight double")
    rows = ac.conditional_values(units, edges, 600, 3).toPandas()
    assert len(rows) == 8 * 600
    got = rows.groupby("i").slag.agg(["mean", "std"]).sort_index().to_numpy()
    weights = np.array([[w for a, _, w in near if a == i] for i in range(8)])
    others = np.array([np.delete(z, i) for i in range(8)])
    mean, var = others.mean(axis=1), others.var(axis=1, ddof=1)
    law_mean = weights.sum(axis=1) * mean
    law_std = np.sqrt(var * ((weights**2).sum(axis=1) - weights.sum(axis=1) ** 2 / 7))
    assert np.abs(got[:, 0] - law_mean).max() < 5 * (law_std / np.sqrt(600)).max()
    assert got[:, 1] == pytest.approx(law_std, rel=0.2)


def test_places_do_not_depend_on_prefixes(spark, monkeypatch):
    units = spark.range(300).selectExpr("id as i", "cast(id as double) as z")
    want = sorted(map(tuple, ac.placed(units, 3, 5).collect()))
    monkeypatch.setattr(ac, "PREFIX_ROWS", 4)
    assert sorted(map(tuple, ac.placed(units, 3, 5).collect())) == want
    assert all(sorted(r[2] for r in want if r[0] == p) == list(range(300)) for p in (1, 2, 3))


def test_residuals_without_variance(spark):
    units = spark.createDataFrame([(i, 2.0) for i in range(4)], "i long, x double")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "i long, j long, weight double")
    assert ac.residual_moran(units, edges) == (0.0, 1.0)
