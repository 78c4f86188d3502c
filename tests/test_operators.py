"""Known values, contracts and invariants of the spatial operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.errors import ConfigError, DataContractError, WeightsError
from latticework.functions import special
from latticework.functions.crs import transform_points
from latticework.operators import autocorrelation as ac
from latticework.operators import classify as cl
from latticework.operators import features as ft
from latticework.operators import geometry as ge
from latticework.operators import models as md
from latticework.operators import ols as lm
from latticework.operators import quality as qa
from latticework.operators import validation as va
from latticework.operators import weights as wt


@pytest.fixture(scope="module")
def line(spark):
    units = spark.createDataFrame([(i, "abcd"[i], float(i + 1)) for i in range(4)], "i long, id string, x double")
    pairs = [(i, j) for i in range(4) for j in (i - 1, i + 1) if 0 <= j < 4]
    return units, wt.transform(spark.createDataFrame([(i, j, 1.0) for i, j in pairs], "i long, j long, weight double"))


def test_line_statistics(line):
    units, edges = line
    assert ac.moran(units, edges).first().value == pytest.approx(0.4)
    assert ac.geary(units, edges).first().value == pytest.approx(0.3)
    local = sorted(ac.local_moran(units, edges, 19).collect(), key=lambda r: r.i)
    assert [r.local_moran for r in local] == pytest.approx([0.6, 0.2, 0.2, 0.6])
    g = sorted(ac.getis_ord(units, edges, 19).collect(), key=lambda r: r.i)
    assert [r.g_star for r in g] == pytest.approx([-1.54919334, -1.09544512, 1.09544512, 1.54919334])
    p = ac.permutation_test(units, edges, "moran", 19).first()
    assert 1 / 20 <= p.p_value <= 1
    assert p == ac.permutation_test(units.repartition(7), edges, "moran", 19).first()


def test_conditional_draws(line):
    units, edges = line
    centred = ac.checked(units, edges)
    sims = ac.conditional_values(centred, edges, 50, 1).collect()
    assert len(sims) == 200
    values = {r.i: r.z for r in centred.collect()}
    ends = {round(r.slag, 9) for r in sims if r.i == 0}  # one neighbour: any value but the unit's own
    assert ends == {round(values[k], 9) for k in (1, 2, 3)}
    middle = {round(r.slag, 9) for r in sims if r.i == 1}
    assert middle <= {round((values[a] + values[b]) / 2, 9) for a in (0, 2, 3) for b in (0, 2, 3) if a != b}


def test_degenerate_values(spark, line):
    _, edges = line
    flat = spark.createDataFrame([(i, str(i), 1.0) for i in range(4)], "i long, id string, x double")
    with pytest.raises(DataContractError):
        ac.moran(flat, edges)
    assert {r.cluster for r in ac.local_moran_unconditional(flat, edges).collect()} == {"NS"}
    with pytest.raises(WeightsError):
        ac.moran(line[0], edges.limit(0))


def test_benjamini_hochberg(spark):
    p = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, 0.2)], "i int, p_value double")
    got = {r.i: r.q_value for r in ac.benjamini_hochberg(p).collect()}
    assert [got[k] for k in range(4)] == pytest.approx([0.04, 0.05333333, 0.05333333, 0.2])


def test_weights(spark):
    cells = spark.createDataFrame([(0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 1, 1), (4, 9, 9)], "i long, row long, col long").withColumn("id", F.col("i").cast("string"))
    edges = wt.lattice_contiguity(cells, "rook")
    told = wt.diagnostics(edges, cells).first()
    assert (told.islands, told.components, told.max_neighbors, told.s0) == (1, 2, 2, 8.0)
    sums = {r.i: r.s for r in wt.transform(edges).groupBy("i").agg(F.sum("weight").alias("s")).collect()}
    assert all(s == pytest.approx(1) for s in sums.values())
    points = cells.withColumns({"x": F.col("col").cast("double"), "y": F.col("row").cast("double")})
    union = wt.knn(points, 1, "union")
    assert wt.islands(union, cells).count() == 0
    with pytest.raises(WeightsError):
        wt.knn(points, 5)
    with pytest.raises(WeightsError):
        wt.lattice_contiguity(cells, "bishop")


def test_grid_search_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    p = np.vstack([rng.normal(size=(60, 2)), rng.normal(size=(20, 2)) * 0.01, [[0.5, 0.5]] * 4])
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "i long, x double, y double")
    got = {(r.i, r["rank"]): r.j for r in wt.nearest(points, points, 6, same=True).collect()}
    d = ((p[:, None] - p[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    for i in range(len(p)):
        order = np.lexsort((np.arange(len(p)), d[i]))[:6]
        assert [got[i, k + 1] for k in range(6)] == order.tolist()
    band = {(r.i, r.j) for r in wt.distance_band(points, 0.3).collect()}
    assert band == {(int(i), int(j)) for i, j in np.argwhere(d <= 0.3 * 0.3)}


def test_edges_contract(spark):
    units = spark.createDataFrame([(0, "00"), (1, "b"), (2, "c")], "i long, id string")
    schema = "origin_id string, destination_id string, weight string"
    ok = spark.createDataFrame([("00 ", "b", "1"), ("00", "b", "2"), ("00", "00", "5"), ("b", "c", "0")], schema)
    assert [tuple(r) for r in wt.from_edges(ok, units, "binary").collect()] == [(0, 1, 1.0)]
    for bad in (("x", "b", "1"), ("b", "c", "-1"), ("b", "c", "abc"), ("b", "c", "inf")):
        with pytest.raises(WeightsError):
            wt.from_edges(spark.createDataFrame([bad], schema), units)


def test_join_contract(spark):
    left = spark.createDataFrame([(" A", 1), ("B", 2), ("C", 3)], "id string, v int")
    right = spark.createDataFrame([("A", 1.0, 7), ("B ", 2.0, 8), ("Z", 3.0, 9)], "codigo string, valor double, v int")
    with pytest.raises(DataContractError):
        qa.join_one_to_one(left, right, "id", "codigo")
    joined, report, lost, unused = qa.join_one_to_one(left, right, "id", "codigo", 0.5)
    assert (report.matched, report.unmatched_spatial, report.unused_table) == (2, 1, 1)
    assert [r.id for r in lost.collect()] == ["C"] and [r.codigo for r in unused.collect()] == ["Z"]
    assert {"v_x", "v_y"} <= set(joined.columns) and joined.count() == 3
    with pytest.raises(DataContractError):
        qa.check_unique_key(left.union(left), "id", "left")
    with pytest.raises(DataContractError):
        qa.as_numbers(spark.createDataFrame([("1",), ("x",)], "n string"), ["n"])


def test_ols_golden(spark, line):
    data = spark.createDataFrame([(i, "abcd"[i], float(i), float(y)) for i, y in enumerate((1, 2.5, 4.2, 8.0))], "i long, id string, x double, y double")
    f = lm.fit(data, "y", ["x"])
    c = lm.coefficients(f).collect()
    assert [r.coefficient for r in c] == pytest.approx([0.52, 2.27])
    assert [r.std_error for r in c] == pytest.approx([0.72529304, 0.38768544])
    assert [r.robust_std_error for r in c] == pytest.approx([1.22330136, 0.83433219])
    assert lm.durbin_watson(f, "i") == pytest.approx(2.16813041)
    told = sorted(lm.influence(f).collect(), key=lambda r: r.id)
    assert [r.leverage for r in told] == pytest.approx([0.7, 0.3, 0.3, 0.7])
    assert [r.cooks_distance for r in told] == pytest.approx([1.1922821, 0.03425801, 0.301275, 2.32298366])
    tests = lm.lm_tests(f, line[1])
    assert [tests[k] for k in ("lm_error", "lm_lag", "robust_lm_error", "robust_lm_lag")] == pytest.approx([0.87373044, 1.35337612, 0.00072690, 0.48037259], rel=1e-4)


def test_ols_exact_and_collinear(spark):
    rows = [(i, float(i % 5), float(i % 3), 3 + 2.0 * (i % 5) - 1.5 * (i % 3)) for i in range(30)]
    data = spark.createDataFrame(rows, "i long, x1 double, x2 double, y double")
    assert [r.coefficient for r in lm.coefficients(lm.fit(data, "y", ["x1", "x2"])).collect()] == pytest.approx([3, 2, -1.5])
    near = data.withColumn("x3", F.col("x1") + F.col("i") * 1e-4)
    assert max(r.vif for r in lm.vif(lm.fit(near, "y", ["x1", "x3"])).collect()) > 1000
    with pytest.raises(DataContractError):
        lm.fit(data, "y", ["nothing"])
    with pytest.raises(ConfigError):
        lm.fit(data, "y", ["x1"], robust="HC9")


def test_special_functions():
    assert special.t_two_sided(2.228138852, 10) == pytest.approx(0.05, rel=1e-6)
    assert special.t_quantile(0.975, 10) == pytest.approx(2.228138852, rel=1e-8)
    assert special.f_sf(4.964602744, 1, 10) == pytest.approx(0.05, rel=1e-6)
    assert special.chi2_sf(7.814727903, 3) == pytest.approx(0.05, rel=1e-6)
    assert special.chi2_sf(3.841458821, 1) == pytest.approx(0.05, rel=1e-6)
    assert math.isnan(special.chi2_sf(math.nan, 1))


def test_validation(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.05, 0.0), (2, 1.0, 1.0), (3, 2.0, 2.0), (4, 3.0, 3.0)], "i long, x double, y double")
    assert sorted(r.i for r in va.buffered(points.where("i > 0"), points.where("i = 0"), 0.1).collect()) == [2, 3, 4]
    with pytest.raises(DataContractError):
        va.buffered(points.where("i > 0"), points.where("i = 0"), 3.0)
    errors = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (0.4,)], "e double")
    assert va.conformal_quantile(errors, "e", 0.75) == 0.4
    told = spark.createDataFrame([(1.0, 0.0, 2.0), (2.0, 1.0, 3.0), (3.0, 3.1, 4.0)], "y_true double, lower double, upper double")
    assert va.interval_metrics(told).first().interval_coverage == pytest.approx(2 / 3)
    many = spark.range(100).select(F.col("id").alias("i"), F.rand(3).alias("x"), F.rand(4).alias("y"))
    sizes = [r["count"] for r in va.random_folds(many, 7, 1).groupBy("fold").count().collect()]
    assert sorted(sizes) == [14] * 5 + [15] * 2
    design = va.Design("grid", "spatial", 3, 3, 3)
    seen = [r.i for _, _, test in va.splits(many.cache(), design, 1) for r in test.collect()]
    assert sorted(seen) == list(range(100))


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 3)) * [1, 5, 0.1] + [10, 0, 3]
    y = x @ [1, -0.3, 4] + rng.normal(size=50)
    data = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, y double")
    fit = md.ridge_paths(data, ["a", "b", "c"], "y", [2.0])[0]
    s = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(s.T @ s + 2 * np.eye(3), s.T @ (y - y.mean()))
    assert fit.weights * x.std(0) == pytest.approx(w)
    assert fit.intercept + fit.weights @ x.mean(0) == pytest.approx(y.mean())


def test_basis_and_lags(spark):
    pts = spark.createDataFrame([(i, float(i % 5), float(i // 5), float(i)) for i in range(20)], "i long, x double, y double, c double")
    basis = ft.EigenBasis(1.0, 4).fit(pts)
    frame = basis.transform(pts).toPandas().drop(columns="i").to_numpy()
    assert frame.shape == (20, 4) and np.isfinite(frame).all()
    square = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, 1.0, 0.0, 2.0), (2, 0.0, 1.0, 3.0), (3, 1.0, 1.0, 4.0)], "i long, x double, y double, c double")
    far = spark.createDataFrame([(9, 10.0, 10.0)], "i long, x double, y double")
    assert ft.covariate_lags(square, far, ["c"], 4).first().lag_c == pytest.approx(2.5)
    own = {r.i: r.lag_c for r in ft.covariate_lags(square, None, ["c"], 3).collect()}
    assert own[0] == pytest.approx(3.0)


def test_classify(spark):
    v = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "v double")
    got = [r["class"] for r in cl.classify(v, "v", "quantiles", 2).collect()]
    assert got == ["(0.999, 2.500]", "(0.999, 2.500]", "(2.500, 4.000]", "(2.500, 4.000]", None]
    assert [r["class"] for r in cl.classify(v, "v", "equal_interval", 2).collect()][0] == "(0.997, 2.500]"
    one = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert {r["class"] for r in cl.classify(one, "v").collect()} == {cl.SINGLE}
    with pytest.raises(DataContractError):
        cl.classify(v, "v", "jenks", 3)


def ring(*p):
    return np.array([*p, p[0]], float)


def test_geometry():
    square = [[ring((0, 0), (2, 0), (2, 2), (0, 2)), ring((0.5, 0.5), (0.5, 1), (1, 1), (1, 0.5))]]
    again = ge.read_wkb(ge.write_wkb(square))
    assert ge.area(again) == pytest.approx(3.75) and ge.perimeter(again) == pytest.approx(10)
    assert ge.centroid(again) == pytest.approx(((4 - 0.25 * 0.75) / 3.75, (4 - 0.25 * 0.75) / 3.75))
    bow = [[ring((0, 0), (1, 1), (1, 0), (0, 1))]]
    assert not ge.is_valid(bow)
    fixed = ge.make_valid(bow)
    assert len(fixed) == 2 and ge.area(fixed) == pytest.approx(0.5)
    right, corner = [[ring((2, 1), (3, 1), (3, 5), (2, 5))]], [[ring((2, 2), (3, 2), (3, 3), (2, 3))]]
    assert ge.shared_length(square, right) == pytest.approx(1) and ge.shared_length(square, corner) == 0 and ge.touches(square, corner)


def test_geometry_contract(spark):
    shapes = spark.createDataFrame([(1, bytearray(ge.write_wkb([[ring((0, 0), (1, 1), (1, 0), (0, 1))]])))], "i long, geom binary")
    with pytest.raises(DataContractError):
        ge.prepare(shapes, None, 3857)
    with pytest.raises(DataContractError):
        ge.prepare(shapes, 4326, 3857, repair=False)
    rows, report = ge.prepare(shapes, 4326, 3857)
    assert report["repaired"] == 1 and ge.spatial_metrics(rows).first().area_max > 1e9


@pytest.mark.parametrize("srid", [3857, 31983, 6933])
def test_projections_round_trip(srid):
    lonlat = np.array([[-45.0, -22.0], [-43.2, -22.9], [-47.5, -15.5]])
    assert transform_points(transform_points(lonlat, 4326, srid), srid, 4326) == pytest.approx(lonlat, abs=1e-9)
    if srid == 31983:
        assert transform_points(np.array([[-45.0, 0.0]]), 4326, srid)[0] == pytest.approx([500000, 10000000])
