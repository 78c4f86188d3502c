"""The spectral basis is that of the kernel over all training rows."""

import numpy as np
import pytest

from latticework.operators import features as ft


def test_basis_of_more_than_2000_rows(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(2_300, 2)) * [3, 1]
    frame = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "i long, x double, y double")
    basis = ft.EigenBasis(5.0, 6).fit(frame.repartition(3))
    u = (points - points.min(axis=0)) / np.ptp(points, axis=0)
    kernel = np.exp(-5.0 * ((u[:, None] - u[None]) ** 2).sum(axis=2))
    centred = kernel - kernel.mean(axis=0) - kernel.mean(axis=1, keepdims=True) + kernel.mean()
    assert basis.values[0] == pytest.approx(np.linalg.norm(centred, 2), rel=1e-9)
    got = basis.project(points)
    for k in range(6):
        assert centred @ got[:, k] == pytest.approx(basis.values[k] * got[:, k], abs=1e-7)
        assert got[:, k] @ got[:, k] == pytest.approx(basis.values[k])
