"""Spatial queries against their SQL at the smallest scale."""

import duckdb
import numpy as np
import pytest

from latticework import queries as q

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def rows(frame):
    def plain(v):
        if v is None or (isinstance(v, float) and np.isnan(v)):
            return None
        return round(float(v), 6) if isinstance(v, (float, np.floating)) else str(v)

    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


FAST = ["join_quality_report", "join_unused", "join_one_to_one", "numeric_contract", "classify_quantiles", "weights_queen", "weights_knn", "weights_inverse_distance", "weights_from_edges", "weights_diagnostics", "components",
        "moran_permutation", "geary_permutation", "local_moran_conditional", "local_moran_unconditional", "getis_ord_gstar", "bh_fdr", "ols_coefficients", "ols_summary", "ols_influence", "durbin_watson", "breusch_pagan_lm",
        "lm_tests", "spatial_grid_groups", "buffer_filter", "random_kfold", "covariate_lag_test", "regression_metrics", "conformal_quantile", "gates", "optimism", "polygon_contiguity"]


@pytest.mark.parametrize("name", FAST)
def test_matches_sql(spark, db, name):
    got = q.QUERIES[name](spark, DATA).toPandas()
    want = db.sql(q.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_is_callable():
    assert len(q.QUERIES) >= 60
    assert set(q.ORACLE_SQL) <= set(q.QUERIES)
