"""Models M0 (ridge on standardised columns) and M1 to M3 (random forests), tuning, calibration."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from .features import EigenBasis, covariate_lags
from .ols import _dot, gram
from .validation import Design, splits

MODELS = ("M0", "M1", "M2U", "M2D", "M3")


@dataclass
class Ridge:
    columns: list[str]
    weights: np.ndarray
    intercept: float

    def predict(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("y_pred", F.lit(self.intercept) + _dot(self.weights, [F.col(c) for c in self.columns]))


def ridge_paths(rows: DataFrame, columns: list[str], target: str, alphas: list[float]) -> list[Ridge]:
    """Ridge fits of all penalties from one Gram pass; columns are standardised by population
    deviation, the intercept is free."""
    # Sums about a rough centre keep the Gram matrix well conditioned.
    centre = rows.agg(*[F.avg(c).alias(c) for c in [*columns, target]]).first()
    shifted = [F.col(c) - F.lit(float(centre[c])) for c in [*columns, target]]
    g = gram(rows, [*shifted, F.lit(1.0)])
    k, n = len(columns), g[-1, -1]
    mean = g[:-1, -1] / n
    cov = g[:-1, :-1] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[:k], 0))
    scale[scale <= 1e-15] = 1.0
    corr, xy = cov[:k, :k] / np.outer(scale, scale), cov[:k, k] / scale
    out = []
    for alpha in alphas:
        w = np.linalg.lstsq(corr + np.eye(k) * alpha / n, xy, rcond=None)[0] / scale
        mid = np.array([float(centre[c]) for c in [*columns, target]]) + mean
        out.append(Ridge(columns, w, float(mid[k] - w @ mid[:k])))
    return out


def parameter_grid(options: dict[str, list]) -> list[dict]:
    """All combinations, the last name changing fastest."""
    return [dict(zip(options, values, strict=True)) for values in itertools.product(*options.values())]


def feature_tables(model: str, train: DataFrame, test: DataFrame, covariates: list[str], cfg: dict) -> tuple[DataFrame, DataFrame, list[str]]:
    """Train and test rows with the model's own features, fitted on train only."""
    if model in ("M0", "M1"):
        return train, test, covariates
    if model in ("M2U", "M2D"):
        kind = "uniform" if model == "M2U" else "inverse_distance"
        args = (covariates, cfg.get("k", 8), kind, cfg.get("distance_power", 1.0))
        names = [f"lag_{c}" for c in covariates]
        return train.join(covariate_lags(train, None, *args), "i"), test.join(covariate_lags(train, test, *args), "i"), [*covariates, *names]
    if model == "M3":
        basis = EigenBasis(cfg.get("gamma", 5.0), cfg.get("n_components", 8)).fit(train)
        names = [f"basis_{c + 1}" for c in range(len(basis.values))]
        return train.join(basis.transform(train), "i"), test.join(basis.transform(test), "i"), [*covariates, *names]
    raise ConfigError(f"unknown model {model!r}")


def fit_predict(model: str, params: dict, train: DataFrame, test: DataFrame, covariates: list[str], target: str, cfg: dict, seed: int) -> DataFrame:
    """Test rows with ``y_pred``."""
    train, test, columns = feature_tables(model, train, test, covariates, cfg)
    if model == "M0":
        return ridge_paths(train, columns, target, [params["alpha"]])[0].predict(test)
    forest = RandomForestRegressor(
        featuresCol="_f",
        labelCol=target,
        predictionCol="y_pred",
        numTrees=params.get("n_estimators", 50),
        maxDepth=min(30, params.get("max_depth") or 30),
        minInstancesPerNode=params.get("min_samples_leaf", 1),
        featureSubsetStrategy=str(params.get("max_features", "all")),
        maxBins=params.get("max_bins", 128),
        seed=seed,
    )
    assemble = VectorAssembler(inputCols=columns, outputCol="_f")
    return forest.fit(assemble.transform(train)).transform(assemble.transform(test)).drop("_f")


def inner_design(outer: Design, n_splits: int) -> Design:
    return Design(f"{outer.name}-inner", outer.kind, n_splits, outer.n_rows, outer.n_cols, outer.buffer_distance)


def tune(model: str, train: DataFrame, outer: Design, options: dict[str, list], covariates: list[str], target: str, cfg: dict, seed: int, inner_splits: int = 3):
    """The parameters of least mean inner rmse (the first of equals), all results, inner folds."""
    grid = parameter_grid(options)
    inner = list(splits(train, inner_design(outer, inner_splits), seed))
    scores = [[] for _ in grid]
    for _, a, b in inner:
        if model == "M0":
            rows = b
            fits = ridge_paths(a, covariates, target, [p["alpha"] for p in grid])
            errors = [F.sqrt(F.avg(F.pow(F.col(target) - (F.lit(f.intercept) + _dot(f.weights, [F.col(c) for c in covariates])), F.lit(2.0)))).alias(f"e{k}") for k, f in enumerate(fits)]
            for k, value in enumerate(rows.agg(*errors).first()):
                scores[k].append(value)
        else:
            for k, params in enumerate(grid):
                error = F.col(target) - F.col("y_pred")
                scores[k].append(fit_predict(model, params, a, b, covariates, target, cfg, seed).agg(F.sqrt(F.avg(error * error))).first()[0])
    means = [float(np.mean(s)) for s in scores]
    best = min(range(len(grid)), key=lambda k: (means[k], k))
    return grid[best], list(zip(grid, scores, strict=True)), inner


def calibration(model: str, params: dict, inner, covariates: list[str], target: str, cfg: dict, seed: int) -> DataFrame:
    """Absolute residuals of the inner test folds, pooled."""
    out = None
    for _, a, b in inner:
        part = fit_predict(model, params, a, b, covariates, target, cfg, seed).select(F.abs(F.col(target) - F.col("y_pred")).alias("absolute_error"))
        out = part if out is None else out.unionByName(part)
    return out
