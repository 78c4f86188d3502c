"""The four pipelines: preparation, autocorrelation, regression, experiment."""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataContractError
from ..functions.crs import is_geographic
from ..operators import autocorrelation as ac
from ..operators import classify as cl
from ..operators import geometry as ge
from ..operators import models as md
from ..operators import ols as lm
from ..operators import quality as qa
from ..operators import validation as va
from ..operators import weights as wt
from ..operators.lineage import cut
from ..sources import readers as rd
from ..sources import writers as wr
from ..sources.geopackage import write_geopackage
from . import config as cf


def _folder(path: str) -> str:
    os.makedirs(path, exist_ok=True)
    return path


def run_preparation(spark: SparkSession, config_path: str) -> dict[str, str]:
    """Prepared geometries joined one to one with a table, with reports, a map and a manifest."""
    cfg = cf.preparation(config_path)
    out = _folder(cfg.output)
    spatial, srid = rd.load_spatial(spark, cfg.spatial)
    table = rd.load_table(spark, cfg.table)
    numeric = list(dict.fromkeys([*cfg.numeric_columns, *([cfg.map_column] if cfg.map_column else [])]))
    table = qa.as_numbers(table, numeric) if numeric else table
    shapes, geometry = ge.prepare(spatial, srid, cfg.crs, cfg.repair, cfg.allow_empty)
    joined, report, lost, unused = qa.join_one_to_one(shapes, table, cfg.spatial_key, cfg.table_key, cfg.minimum_match_rate)
    joined = joined.cache()
    files = {
        "spatial": write_geopackage(joined, f"{out}/joined.gpkg", "joined", cfg.crs),
        "unmatched": wr.write_csv(lost.drop("geom"), f"{out}/unmatched.csv"),
        "unused": wr.write_csv(unused, f"{out}/unused.csv"),
    }
    if cfg.map_column:
        classed = cl.classify(joined, cfg.map_column, cfg.map_method, cfg.map_classes)
        order = [r["class"] for r in classed.where("class_index is not null").select("class_index", "class").distinct().orderBy("class_index").collect()]
        layer = wr.class_colours(wr.map_layer(classed, cfg.spatial_key, "class"), order)
        files["map"] = wr.write_svg_map(layer, f"{out}/map.svg", cfg.map_column)
    quality = {
        "geometry": geometry,
        "join": report.asDict(),
        "spatial_metrics": ge.spatial_metrics(joined).first().asDict() | {"types": {r.type: r.geometries for r in ge.type_counts(joined).collect()}},
        "missing_values": {r["column"]: r.missing for r in qa.missing_counts(joined.drop("geom"), [c for c in joined.columns if c != "geom"]).collect()},
    }
    files["quality"] = wr.write_json(quality, f"{out}/quality.json")
    files["manifest"] = wr.write_json(wr.manifest(config_path, [cfg.spatial, cfg.table], list(files.values())), f"{out}/manifest.json")
    return files


def build_weights(units: DataFrame, spec: cf.WeightSpec) -> DataFrame:
    """Edges of units ``(i, geom, x, y)`` by a specification: kind, symmetry, transform."""
    if units.limit(3).count() < 3:
        raise DataContractError("weights need at least three units")
    points = units.select("i", F.col("cx").alias("x"), F.col("cy").alias("y"))
    if spec.kind in ("rook", "queen"):
        edges = ge.polygon_contiguity(units, spec.kind, spec.tolerance)
    elif spec.kind == "knn":
        edges = wt.knn(points, spec.k, spec.symmetrization)
    else:
        edges = wt.symmetrize(wt.distance_band(points, spec.threshold, spec.distance_power), spec.symmetrization)
    return wt.transform(edges, spec.transform)


def run_autocorrelation(spark: SparkSession, config_path: str) -> dict:
    """Global and local autocorrelation under several weights, with sensitivity and products."""
    cfg = cf.autocorrelation(config_path)
    out = _folder(cfg.output)
    loaded, srid = rd.load_spatial(spark, cfg.input, cfg.layer)
    if is_geographic(cfg.crs):
        raise DataContractError("distances need a projected reference system")
    shapes, _ = ge.prepare(loaded, srid, cfg.crs, repair=False)
    units = qa.prepare_units(shapes, cfg.id_column, cfg.value_column)
    units = ge.measures(units.select("i", "id", F.col(cfg.value_column).alias("x"), "geom")).select("i", "id", "x", "geom", "cx", "cy").cache()
    names = units.select("i", "id")
    outputs, diagnostics, tests, sensitivity, primary = [], [], [], [], None
    for k, spec in enumerate(cfg.weights):
        edges = build_weights(units, spec).cache()
        told = wt.diagnostics(edges, units).first().asDict()
        told = {"name": spec.name, "type": spec.kind, "transform": spec.transform, **told, "island_ids": ";".join(wt.island_ids(edges, units)), "k": spec.k, "threshold": spec.threshold, "distance_power": spec.distance_power, "symmetrization": spec.symmetrization}
        diagnostics.append(told)
        outputs.append(wr.write_csv(wt.edge_list(edges, names).orderBy("origin_index", "destination_index"), f"{out}/pesos_{spec.name}.csv"))
        seed = cfg.seed + 10 * k
        row = dict(told)
        for n, statistic in enumerate(("moran", "geary")):
            test = ac.permutation_test(units, edges, statistic, cfg.permutations, seed + n, cfg.alternative).first().asDict()
            tests.append({"weights": spec.name, "statistic": statistic, **test})
            row |= {f"{statistic}_{'i' if n == 0 else 'c'}": test["value"], f"{statistic}_p": test["p_value"]}
        local = ac.local_moran(units, edges, cfg.permutations, seed + 2, cfg.alpha, cfg.fdr).join(names, "i").cache()
        hot = ac.getis_ord(units, edges, cfg.permutations, seed + 3, cfg.alpha, cfg.fdr).join(names, "i").cache()
        outputs += [wr.write_csv(local.drop("i").orderBy("id"), f"{out}/moran_local_{spec.name}.csv"), wr.write_csv(hot.drop("i").orderBy("id"), f"{out}/getis_ord_gstar_{spec.name}.csv")]
        row |= {"local_moran_significant": local.where("significant").count(), "gstar_significant": hot.where("significant").count()}
        sensitivity.append(row)
        if cfg.maps:
            for frame, column, label in ((local, "cluster", "moran_local"), (hot, "classification", "getis_ord")):
                layer = wr.map_layer(frame.join(units.select("i", "geom"), "i"), "id", column)
                outputs.append(wr.write_svg_map(layer, f"{out}/{label}_{spec.name}.svg", f"{label} {spec.name}"))
        if spec.name == cfg.primary:
            a = local.drop("id").withColumnsRenamed({c: f"moran_{c}" for c in local.columns if c not in ("i", "id")})
            b = hot.drop("id").withColumnsRenamed({c: f"gstar_{c}" for c in hot.columns if c not in ("i", "id")})
            primary = units.drop("cx", "cy").join(a, "i").join(b, "i")
    outputs.append(write_geopackage(primary, f"{out}/resultado.gpkg", "resultado", cfg.crs))
    for name, rows in (("diagnostico_matrizes", diagnostics), ("estatisticas_globais", tests), ("sensibilidade_matrizes", sensitivity)):
        outputs.append(_rows_csv(rows, f"{out}/{name}.csv"))
    report = {"weights": diagnostics, "global": tests, "sensitivity": sensitivity}
    outputs.append(wr.write_json(report, f"{out}/relatorio.json"))
    told = wr.manifest(config_path, [cfg.input], outputs, seed=cfg.seed, permutations=cfg.permutations)
    return report | {"outputs": [*outputs, wr.write_json(told, f"{out}/manifesto.json")]}


def _rows_csv(rows: list[dict], path: str) -> str:
    import csv

    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.DictWriter(f, list(rows[0]))
        writer.writeheader()
        writer.writerows(rows)
    return path


def run_regression(spark: SparkSession, config_path: str) -> list[str]:
    """OLS with robust errors, classical, influence and spatial diagnostics per model and weights."""
    cfg = cf.regression(config_path)
    out = _folder(cfg.output)
    loaded, srid = rd.load_spatial(spark, cfg.input, cfg.layer)
    if srid is None:
        raise DataContractError("the table has no coordinate reference system")
    needed = sorted({c for m in cfg.models for c in (m.target, *m.regressors)})
    rows = qa.as_numbers(loaded, needed).withColumn("id", qa.normal_key(cfg.id_column))
    qa.check_unique_key(rows, "id", "units")
    rows = qa.dense_index(rows, "id").cache()
    names = rows.select("i", "id")
    weights = {w.name: wt.from_edges(rd.load_edges(spark, w.path), names, w.transform).cache() for w in cfg.weights}
    tables: dict[str, list[dict]] = {t: [] for t in ("coeficientes", "vif", "resumo_modelos", "diagnosticos_classicos", "diagnosticos_espaciais", "influencia", "diagnostico_pesos")}
    add = lambda name, df: tables[name].extend(r.asDict() for r in df.collect())
    for name, edges in weights.items():
        add("diagnostico_pesos", wt.diagnostics(edges, names).withColumn("weights", F.lit(name)))
    spatial, outputs, influence = rows, [], None
    for k, spec in enumerate(cfg.models):
        fit = lm.fit(rows, spec.target, spec.regressors, spec.name, spec.robust)
        add("coeficientes", lm.coefficients(fit))
        add("vif", lm.vif(fit))
        add("resumo_modelos", lm.summary(fit))
        add("diagnosticos_classicos", lm.classical(fit, "i"))
        told = lm.influence(fit)
        influence = told if influence is None else influence.unionByName(told)
        columns = [F.col(c).alias(f"{n}_{spec.name}") for c, n in (("fitted", "fitted"), ("residual", "residual"), ("cooks_distance", "cook"), ("leverage", "leverage"))]
        spatial = spatial.join(told.select("id", *columns), "id")
        for n, (name, edges) in enumerate(weights.items()):
            add("diagnosticos_espaciais", lm.spatial(fit, edges, name, cfg.permutations, cfg.seed + 1000 * k + n))
    del tables["influencia"]
    outputs += [_rows_csv(t, f"{out}/{name}.csv") for name, t in tables.items() if t]
    outputs.append(wr.write_csv(influence, f"{out}/influencia.csv"))
    outputs.append(write_geopackage(spatial.drop("i"), f"{out}/diagnostico.gpkg", "diagnostico", srid))
    if cfg.maps:
        for spec in cfg.models:
            classed = cl.classify(spatial, f"residual_{spec.name}", "equal_interval", 5)
            order = [r["class"] for r in classed.select("class_index", "class").distinct().orderBy("class_index").collect()]
            outputs.append(wr.write_svg_map(wr.class_colours(wr.map_layer(classed, "id", "class"), order), f"{out}/residuos_{spec.name}.svg", f"residuals {spec.name}"))
    report = wr.regression_report(tables["resumo_modelos"], tables["coeficientes"], tables["diagnosticos_classicos"], tables["diagnosticos_espaciais"], tables["vif"], cfg.alpha)
    path = f"{out}/relatorio.md"
    with open(path, "w", encoding="utf-8") as f:
        f.write(report)
    outputs.append(path)
    told = wr.manifest(config_path, [cfg.input, *(w.path for w in cfg.weights)], outputs, seed=cfg.seed, permutations=cfg.permutations)
    return [*outputs, wr.write_json(told, f"{out}/manifesto.json")]


def run_experiment(spark: SparkSession, config_path: str) -> dict[str, str]:
    """Nested spatial validation of the models with conformal intervals and residual autocorrelation."""
    cfg = cf.experiment(config_path)
    out = _folder(cfg.output)
    data = rd.load_dataset(spark, cfg.dataset["name"], cfg.dataset.get("sample_limit"), cfg.seed, **{k: v for k, v in cfg.dataset.items() if k not in ("name", "sample_limit")})
    lon, lat = data.coordinates
    covariates = [c for c in data.frame.columns if c not in (data.target, lon, lat, "i")]
    points = data.frame.select("i", F.col(lon).alias("x"), F.col(lat).alias("y"), *covariates, F.col(data.target).alias("_y")).cache()
    cfg_features = {"k": cfg.k, **cfg.features}
    metrics, search, predictions, local = [], [], None, None
    for repetition in range(cfg.repetitions):
        seed = cfg.seed + repetition
        for design in cfg.designs:
            for fold, train, test in va.splits(points, design, seed):
                train, test = cut(train), cut(test)
                for model, options in cfg.models.items():
                    key = {"validation": design.name, "repetition": repetition, "fold": fold, "model": model}
                    best, scores, inner = md.tune(model, train, design, options, covariates, "_y", cfg_features, seed, cfg.inner_splits)
                    search += [{**key, "selected": p == best, "params_json": json.dumps(p, sort_keys=True), "mean_inner_rmse": sum(s) / len(s), "median_inner_rmse": sorted(s)[len(s) // 2]} for p, s in scores]
                    q = va.conformal_quantile(md.calibration(model, best, inner, covariates, "_y", cfg_features, seed), "absolute_error", cfg.coverage)
                    told = md.fit_predict(model, best, train, test, covariates, "_y", cfg_features, seed)
                    told = told.select("i", "x", "y", F.col("_y").alias("y_true"), "y_pred", (F.col("y_pred") - q).alias("lower"), (F.col("y_pred") + q).alias("upper"))
                    told = told.withColumns({"residual": F.col("y_true") - F.col("y_pred"), "covered": F.col("y_true").between(F.col("lower"), F.col("upper"))})
                    told = cut(told)
                    row = {**key, "validation_kind": design.kind, "n_train": train.count(), "n_test": test.count(), "buffer_distance": design.buffer_distance, "best_params_json": json.dumps(best, sort_keys=True), "conformal_q": q}
                    row |= va.regression_metrics(told).first().asDict() | va.interval_metrics(told).first().asDict()
                    units = qa.dense_index(told.withColumnRenamed("i", "row_id"), "row_id").withColumnRenamed("residual", "r")
                    units = cut(units)
                    near = cut(wt.nearest(units, units, cfg.k, same=True))
                    for weighting in ("uniform", "inverse_distance"):
                        edges = wt.weighted_nearest(near, weighting)
                        value, p = ac.residual_moran(units, edges, cfg.permutations, seed, "r")
                        row |= {f"moran_i_{weighting}": value, f"moran_p_{weighting}": p}
                    metrics.append(row)
                    lisa = ac.local_moran_unconditional(units, wt.weighted_nearest(near), cfg.permutations, seed, cfg.alpha, "r").join(units.select("i", "row_id", "r"), "i")
                    tag = [F.lit(v).alias(n) for n, v in key.items()]
                    lisa = cut(lisa.select(*tag, "row_id", F.col("r").alias("residual"), "local_i", "local_p", "spatial_lag", "cluster"))
                    told = told.select(*tag, F.col("i").alias("row_id"), F.col("x").alias("longitude"), F.col("y").alias("latitude"), "y_true", "y_pred", "lower", "upper", "covered", "residual", F.abs("residual").alias("absolute_error"))
                    predictions = told if predictions is None else predictions.unionByName(told)
                    local = lisa if local is None else local.unionByName(lisa)
    local = local.cache()
    table = spark.createDataFrame(metrics).cache()
    files = {"metrics": _rows_csv(metrics, f"{out}/metrics.csv"), "search": _rows_csv(search, f"{out}/hyperparameter_search.csv")}
    files["predictions"] = wr.write_csv(predictions, f"{out}/predictions.csv")
    files["local_moran"] = wr.write_csv(local, f"{out}/local_moran.csv")
    columns = ["rmse", "mae", "r2", "interval_coverage", "interval_width", "moran_i_uniform", "moran_i_inverse_distance"]
    files["optimism"] = wr.write_csv(va.optimism(table), f"{out}/optimism.csv")
    files["summary"] = wr.write_csv(va.summary(table, columns), f"{out}/summary.csv")
    files |= _figures(table, predictions, local, out)
    told = {r.model: r.asDict() for r in va.gates(table, local, cfg.coverage, next(iter(cfg.models))).collect()}
    files["gates"] = wr.write_json(told, f"{out}/gates.json")
    shutil.copy(config_path, f"{out}/config.yml")
    files["manifest"] = wr.write_json(wr.manifest(config_path, [cfg.dataset["path"]] if "path" in cfg.dataset else [], list(files.values()), seed=cfg.seed), f"{out}/manifest.json")
    return files


def _figures(table: DataFrame, predictions: DataFrame, local: DataFrame, out: str) -> dict[str, str]:
    """Bars of the median errors; maps of residuals and their clusters by design and model."""
    medians = table.groupBy("validation", "model").agg(F.percentile("rmse", 0.5).alias("rmse")).orderBy("validation", "model").collect()
    files = {"figure_rmse": wr.write_svg_bars([(r.validation, r.model, r.rmse) for r in medians], f"{out}/rmse.svg", "Median RMSE")}
    for r in medians:
        mine = (F.col("validation") == r.validation) & (F.col("model") == r.model)
        rows = predictions.where(mine).select("repetition", "fold", "row_id", F.col("longitude").alias("x"), F.col("latitude").alias("y"), "residual")
        most = rows.agg(F.max(F.abs("residual"))).first()[0] or 0.0
        maps = {"residuals": rows.select("x", "y", F.col("residual").alias("class"), wr.signed_colours("residual", most).alias("colour"))}
        clusters = local.where(mine).select("repetition", "fold", "row_id", "cluster").join(rows.drop("residual"), ["repetition", "fold", "row_id"])
        known = F.create_map(*[F.lit(x) for pair in wr.COLOURS.items() for x in pair])
        maps["lisa"] = clusters.select("x", "y", F.col("cluster").alias("class"), F.coalesce(F.element_at(known, F.col("cluster")), F.lit(wr.MISSING)).alias("colour"))
        for kind, points in maps.items():
            files[f"figure_{kind}_{r.validation}_{r.model}"] = wr.write_svg_points(points, f"{out}/{kind}_{r.validation}_{r.model}.svg", f"{kind} {r.validation} {r.model}")
    return files


def merge_runs(spark: SparkSession, folders: list[str], output: str) -> dict[str, str]:
    """Rows of several experiment folders put together, with optimism and summary made anew."""
    out = _folder(output)
    read = lambda name: spark.read.option("header", True).option("inferSchema", True).csv([f"{f}/{name}.csv" for f in folders])
    metrics = read("metrics").cache()
    files = {name: wr.write_csv(read(name), f"{out}/{name}.csv") for name in ("metrics", "predictions", "local_moran", "hyperparameter_search")}
    files["optimism"] = wr.write_csv(va.optimism(metrics), f"{out}/optimism.csv")
    files["summary"] = wr.write_csv(va.summary(metrics, ["rmse", "mae", "r2", "interval_coverage", "interval_width"]), f"{out}/summary.csv")
    return files


def residual_layers(predictions: DataFrame, local: DataFrame) -> DataFrame:
    """Per unit: mean residual, share of significant clusters, and the residual scale's limit."""
    mean = predictions.groupBy("row_id").agg(F.avg("residual").alias("mean_residual"))
    share = local.groupBy("row_id").agg(F.avg((F.col("cluster") != "NS").cast("double")).alias("significant_share"))
    limit = mean.agg(F.percentile(F.abs("mean_residual"), F.lit(0.98)).alias("residual_limit"))
    return mean.join(share, "row_id", "left").join(F.broadcast(limit))  # one row


def prepare_countries(shapes: DataFrame, srid: int, columns: dict[str, str], excluded: list[str]) -> DataFrame:
    """Country features: filters, equal-area measures, compactness, logs and one-hot continents."""
    name, iso, continent, people, product = (columns[c] for c in ("name", "iso", "continent", "population", "product"))
    rows = shapes.where(~F.col(continent).isin(excluded) & (F.col(people) > 0) & (F.col(product) > 0))
    rows, _ = ge.prepare(rows, srid, 6933)
    rows = qa.dense_index(ge.measures(rows), iso).withColumnRenamed("i", "row_id")
    km2, km = F.col("area") / 1e6, F.col("perimeter") / 1e3
    kinds = sorted(r[0] for r in rows.select(continent).distinct().collect())
    return rows.select(
        "row_id", F.col(name).alias("name"), F.col(iso).alias("iso_a3"), F.log1p(people).alias("log_pop_est"), F.log1p(km2).alias("log_area_km2"), F.log1p(km).alias("log_perimeter_km"), ge.compactness(km2, km).alias("compactness"),
        (F.col("cx") / 1e3).alias("x_km"), (F.col("cy") / 1e3).alias("y_km"), F.log1p(product).alias("log_gdp_md_est"), *[(F.col(continent) == k).cast("double").alias("continent_" + k.lower().replace(" ", "_")) for k in kinds],
    )
