"""Benjamini-Hochberg over ranges of p-values."""

import numpy as np
import pytest

from latticework.operators import autocorrelation as ac


@pytest.mark.parametrize("parts", [1, 7])
def test_many_distinct_values_in_ranges(spark, parts):
    rng = np.random.default_rng(6)
    p = np.concatenate((rng.random(300), rng.choice([0.01, 0.2, 1.0], 80), rng.random(40) * 1e-3))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.i: r.q_value for r in ac.benjamini_hochberg(spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "i long, p_value double")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = np.argsort(p, kind="stable")
    want = np.empty(len(p))
    want[order] = np.minimum(1, np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1])
    assert [got[i] for i in range(len(p))] == pytest.approx(want.tolist())


def test_no_rows(spark):
    assert ac.benjamini_hochberg(spark.createDataFrame([], "i long, p_value double")).count() == 0
