"""Spatial features fitted on training rows only: covariate lags and a spectral basis."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DataContractError
from .weights import nearest, weighted_nearest

TAIL = 1e-15


def covariate_lags(train: DataFrame, query: DataFrame | None, covariates: list[str], k: int = 8, weighting: str = "uniform", power: float = 1.0) -> DataFrame:
    """Weighted means of the covariates of the nearest training rows: ``(i, lag_<name>..)``.

    ``query`` None: of the training rows themselves, without their own values."""
    near = nearest(train if query is None else query, train, k, same=query is None)
    weights = weighted_nearest(near, weighting, power)
    values = train.select(F.col("i").alias("j"), *covariates)
    return weights.join(values, "j").groupBy("i").agg(*[F.sum(F.col("weight") * F.col(c)).alias(f"lag_{c}") for c in covariates])


class EigenBasis:
    """Leading eigenvectors of the doubly centred Gaussian kernel over all training coordinates.

    On the unit square the kernel is a sum of products of features ``phi`` (its Taylor series in
    ``x x'``, cut below ``TAIL``), so its spectrum is that of the features' centred Gram matrix,
    one aggregate over all rows.  Other rows are projected by the Nystroem formula."""

    def __init__(self, gamma: float = 5.0, n_components: int = 8):
        self.gamma, self.n_components = gamma, n_components

    def fit(self, train: DataFrame) -> EigenBasis:
        told = train.agg(*[f(c) for c in ("x", "y") for f in (F.min, F.max)]).first()
        self.low = np.array([told[0], told[2]], dtype=float)
        span = np.array([told[1], told[3]], dtype=float) - self.low
        self.span = np.where(span == 0, 1.0, span)
        terms = [1.0]
        while terms[-1] > TAIL or len(terms) <= self.gamma / 2:
            terms.append(terms[-1] * self.gamma / 2 / len(terms))
        self.terms = len(terms)
        size = self.terms**2

        def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            gram, total, n = np.zeros((size, size)), np.zeros(size), 0
            for frame in frames:
                for at in range(0, len(frame), 2_000):
                    phi = self._features(frame.iloc[at : at + 2_000][["x", "y"]].to_numpy(float))
                    gram, total, n = gram + phi.T @ phi, total + phi.sum(axis=0), n + len(phi)
            if n:
                yield pd.DataFrame({"k": np.arange(size + 1), "row": [*gram, np.append(total, n)]})

        rows = train.select("x", "y").mapInPandas(sums, "k int, row array<double>")
        whole = np.zeros((size + 1, size + 1))
        for r in rows.select("k", F.posexplode("row").alias("l", "v")).groupBy("k", "l").agg(F.sum("v").alias("v")).toLocalIterator():
            whole[r.k, r.l] = r.v
        n = whole[size, size]
        self.mean = whole[size, :size] / n
        values, vectors = np.linalg.eigh(whole[:size, :size] - n * np.outer(self.mean, self.mean))
        order = [k for k in np.argsort(values)[::-1] if values[k] > 1e-8][: self.n_components]
        if not order:
            raise DataContractError("the coordinates span no basis")
        self.values, self.vectors = values[order], vectors[:, order]
        return self

    def _features(self, points: np.ndarray) -> np.ndarray:
        u = (points - self.low) / self.span - 0.5
        k = np.arange(1, self.terms)
        steps = np.sqrt(2 * self.gamma / k) * u[:, :, None]
        first = np.exp(-self.gamma * u**2)[:, :, None]
        f = np.concatenate((first, first * np.cumprod(steps, axis=2)), axis=2)
        return (f[:, 0, :, None] * f[:, 1, None, :]).reshape(len(u), -1)

    def project(self, points: np.ndarray) -> np.ndarray:
        return (self._features(points) - self.mean) @ self.vectors

    def transform(self, rows: DataFrame) -> DataFrame:
        """``(i, basis_1 ..)`` of ``rows(i, x, y)``."""
        n = len(self.values)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), 1_000):
                    part = frame.iloc[at : at + 1_000]
                    out = pd.DataFrame(self.project(part[["x", "y"]].to_numpy(float)), columns=[f"basis_{c + 1}" for c in range(n)])
                    out.insert(0, "i", part["i"].to_numpy())
                    yield out

        kind = dict(rows.dtypes)["i"]
        return rows.select("i", "x", "y").mapInPandas(run, f"i {kind}, " + ", ".join(f"basis_{c + 1} double" for c in range(n)))
