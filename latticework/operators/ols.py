"""Ordinary least squares from one-pass Gram matrices, with diagnostics.

A fit is one aggregate over the rows (sums of products), a k x k solve on the driver, and, for
robust covariances, a second aggregate.  Row-wise results are expressions over the rows with
the k x k inverse as constants.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, DataContractError
from ..functions.special import chi2_sf, f_sf, t_quantile, t_two_sided

ROBUST = ("HC0", "HC1", "HC2", "HC3")


def gram(rows: DataFrame, columns: list[Column], weight: Column | None = None) -> np.ndarray:
    """Sums of products of all pairs of columns, in one aggregate."""
    k = len(columns)
    w = F.lit(1.0) if weight is None else weight
    sums = [F.sum(columns[a] * columns[b] * w).alias(f"g{a}_{b}") for a in range(k) for b in range(a, k)]
    row = rows.agg(*sums).first()
    out = np.empty((k, k))
    at = iter(row)
    for a in range(k):
        for b in range(a, k):
            value = next(at)
            out[a, b] = out[b, a] = math.nan if value is None else value
    return out


@dataclass
class Fit:
    name: str
    target: str
    terms: list[str]
    n: int
    beta: np.ndarray
    inverse: np.ndarray
    cross: np.ndarray
    sse: float
    tss: float
    robust: str
    robust_cov: np.ndarray
    rows: DataFrame  # the input with fitted, residual, leverage

    @property
    def k(self) -> int:
        return len(self.terms)

    @property
    def df(self) -> int:
        return self.n - self.k

    @property
    def s2(self) -> float:
        return self.sse / self.df


def design(terms: list[str]) -> list[Column]:
    return [F.lit(1.0) if t == "const" else F.col(t) for t in terms]


def _dot(values: np.ndarray, columns: list[Column]) -> Column:
    out = F.lit(0.0)
    for v, c in zip(values, columns, strict=True):
        out = out + F.lit(float(v)) * c
    return out


def _quadratic(m: np.ndarray, columns: list[Column]) -> Column:
    return sum((_dot(m[a], columns) * columns[a] for a in range(1, len(columns))), _dot(m[0], columns) * columns[0])


def fit(rows: DataFrame, target: str, regressors: list[str], name: str = "model", robust: str = "HC3", constant: bool = True) -> Fit:
    """OLS of ``target`` on the regressors, a constant first."""
    if robust not in ROBUST:
        raise ConfigError(f"robust covariance must be one of {ROBUST}")
    columns = [target, *regressors]
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise DataContractError(f"model columns are missing: {missing}")
    rows = rows.withColumns({c: F.col(c).cast("double") for c in columns})
    bad = rows.agg(F.count_if(sum((F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).cast("int") for c in columns) > 0)).first()[0]
    if bad:
        raise DataContractError(f"{bad} rows hold model values that are not finite")
    terms = (["const"] if constant else []) + regressors
    x = design(terms)
    g = gram(rows, [*x, F.col(target), F.lit(1.0)])
    k = len(terms)
    cross, xy, n = g[:k, :k], g[:k, k], round(g[k + 1, k + 1])
    inverse = np.linalg.pinv(cross)
    beta = inverse @ xy
    rows = rows.withColumn("fitted", _dot(beta, x)).withColumn("residual", F.col(target) - F.col("fitted")).withColumn("leverage", _quadratic(inverse, x))
    mean = g[k, k + 1] / n
    e2 = F.col("residual") * F.col("residual")
    h = F.col("leverage")
    weight = {"HC0": e2, "HC1": e2 * (n / max(1, n - k)), "HC2": F.try_divide(e2, 1 - h), "HC3": F.try_divide(e2, (1 - h) * (1 - h))}[robust]
    centred = F.col(target) - F.lit(mean) if constant else F.col(target)
    second = rows.agg(F.sum(e2).alias("sse"), F.sum(centred * centred).alias("tss"), *[F.sum(x[a] * x[b] * weight).alias(f"m{a}_{b}") for a in range(k) for b in range(a, k)]).first()
    meat = np.empty((k, k))
    for a in range(k):
        for b in range(a, k):
            value = second[f"m{a}_{b}"]
            meat[a, b] = meat[b, a] = math.nan if value is None else value
    return Fit(name, target, terms, n, beta, inverse, cross, float(second.sse), float(second.tss), robust, inverse @ meat @ inverse, rows)


def _frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    plain = lambda v: v.item() if isinstance(v, np.generic) else v
    return spark.createDataFrame([tuple(plain(r[n]) for n in names) for r in rows], schema)


def coefficients(f: Fit, level: float = 0.95) -> DataFrame:
    """One row per term, with conventional and robust inference by the t distribution."""
    t = t_quantile(0.5 + level / 2, f.df)
    rows = []
    for j, term in enumerate(f.terms):
        b, se, rse = float(f.beta[j]), math.sqrt(max(0.0, f.s2 * f.inverse[j, j])), math.sqrt(max(0.0, f.robust_cov[j, j]))
        rows.append(
            {"model": f.name, "term": term, "coefficient": b, "std_error": se, "p_value": t_two_sided(b / se, f.df) if se else math.nan, "robust_covariance": f.robust, "robust_std_error": rse,
             "robust_p_value": t_two_sided(b / rse, f.df) if rse else math.nan, "ci_low": b - t * se, "ci_high": b + t * se, "robust_ci_low": b - t * rse, "robust_ci_high": b + t * rse}
        )
    return _frame(f.rows.sparkSession, rows, "model string, term string, coefficient double, std_error double, p_value double, robust_covariance string, robust_std_error double, robust_p_value double, ci_low double, ci_high double, robust_ci_low double, robust_ci_high double")


def vif(f: Fit) -> DataFrame:
    """Variance inflation of each regressor but the constant."""
    rows = []
    for j, term in enumerate(f.terms):
        if term == "const":
            continue
        rest = [a for a in range(f.k) if a != j]
        # Residual sum of squares of the auxiliary fit, by the Schur complement of the Gram matrix.
        ssr = f.cross[j, j] - f.cross[j, rest] @ np.linalg.pinv(f.cross[np.ix_(rest, rest)]) @ f.cross[rest, j]
        tss = f.cross[j, j] - (f.cross[j, f.terms.index("const")] ** 2 / f.n if "const" in f.terms else 0)
        rows.append({"model": f.name, "term": term, "vif": float(tss / ssr) if ssr > 1e-14 * max(tss, 1e-300) else math.inf})
    return _frame(f.rows.sparkSession, rows, "model string, term string, vif double")


def summary(f: Fit) -> DataFrame:
    """One row: fit statistics; the condition number is that of the design."""
    lik = -f.n / 2 * (math.log(2 * math.pi) + math.log(f.sse / f.n) + 1) if f.sse > 0 else math.inf
    r2 = 1 - f.sse / f.tss if f.tss > 0 else math.nan
    const = "const" in f.terms
    eig = np.linalg.eigvalsh(f.cross)
    row = {
        "model": f.name, "n": f.n, "parameters": f.k if const else f.k + 1, "r_squared": r2, "adjusted_r_squared": 1 - (f.n - const) / f.df * (1 - r2), "aic": -2 * lik + 2 * f.k, "bic": -2 * lik + f.k * math.log(f.n),
        "rmse": math.sqrt(f.sse / f.n), "condition_number": math.sqrt(eig[-1] / eig[0]) if eig[0] > 0 else math.inf,
    }
    return _frame(f.rows.sparkSession, [row], "model string, n long, parameters int, r_squared double, adjusted_r_squared double, aic double, bic double, rmse double, condition_number double")


def influence(f: Fit, id_column: str = "id") -> DataFrame:
    """Leverage, studentised residuals, Cook's distance and DFFITS of every row."""
    h, e, k = F.col("leverage"), F.col("residual"), f.k
    r = F.try_divide(e, F.sqrt(F.lit(f.s2) * F.greatest(1 - h, F.lit(0.0))))
    t = F.col("standardized_residual") * F.sqrt(F.try_divide(F.lit(float(f.n - k - 1)), f.n - k - F.col("standardized_residual") * F.col("standardized_residual")))
    rows = f.rows.withColumn("standardized_residual", r)
    return rows.select(
        F.lit(f.name).alias("model"),
        F.col(id_column).alias("id"),
        "fitted",
        "residual",
        "standardized_residual",
        t.alias("studentized_residual"),
        "leverage",
        F.try_divide(F.col("standardized_residual") * F.col("standardized_residual") * h, k * (1 - h)).alias("cooks_distance"),
        (F.col("standardized_residual") * F.sqrt(F.try_divide(h, 1 - h))).alias("dffits"),
    )


def durbin_watson(f: Fit, order: str, salt: int = 1) -> float:
    """Sum of squared steps between residuals in ``order`` over their sum of squares.

    The order is a range partitioning: steps inside a partition use its own window; the steps
    between partitions use one boundary row of each."""
    rows = f.rows.select(F.col(order).alias("o"), F.col("residual").alias("e")).repartitionByRange("o").sortWithinPartitions("o").withColumn("p", F.spark_partition_id())
    step = F.col("e") - F.lag("e").over(Window.partitionBy("p").orderBy("o"))
    inner = rows.withColumn("d", step).groupBy("p").agg(F.sum(F.col("d") * F.col("d")).alias("dd"), F.sum(F.col("e") * F.col("e")).alias("ee"), F.min_by("e", "o").alias("first"), F.max_by("e", "o").alias("last"))
    ends = inner.orderBy("p").collect()  # one row per partition
    between = sum((b["first"] - a["last"]) ** 2 for a, b in zip(ends, ends[1:], strict=False))
    total = sum(r.ee for r in ends)
    return (sum(r.dd or 0.0 for r in ends) + between) / total if total else math.nan


def jarque_bera(f: Fit) -> dict[str, float]:
    row = f.rows.agg(F.skewness("residual").alias("s"), F.kurtosis("residual").alias("k")).first()
    if row.s is None or math.isnan(row.s):
        return {"jarque_bera": math.nan, "jarque_bera_p": math.nan, "residual_skew": math.nan, "residual_kurtosis": math.nan}
    jb = f.n / 6 * (row.s**2 + row.k**2 / 4)
    return {"jarque_bera": jb, "jarque_bera_p": chi2_sf(jb, 2), "residual_skew": row.s, "residual_kurtosis": row.k + 3}


def _auxiliary(rows: DataFrame, columns: list[Column], n: int, rank: int, prefix: str) -> dict[str, float]:
    """LM and F tests of squared residuals on a design whose first column is the constant."""
    g = gram(rows, [*columns, F.col("residual") * F.col("residual"), F.lit(1.0)])
    k = len(columns)
    beta = np.linalg.pinv(g[:k, :k], hermitian=True) @ g[:k, k]
    mean = g[k, k + 1] / n
    tss = g[k, k] - n * mean**2
    sse = g[k, k] - beta @ g[:k, k]
    r2 = 1 - sse / tss if tss > 0 else math.nan
    free = n - rank
    lm = n * r2
    stat = r2 / (rank - 1) / ((1 - r2) / free) if free > 0 and r2 < 1 else math.nan
    return {f"{prefix}_lm": lm, f"{prefix}_lm_p": chi2_sf(lm, rank - 1), f"{prefix}_f": stat, f"{prefix}_f_p": f_sf(stat, rank - 1, free)}


def breusch_pagan(f: Fit) -> dict[str, float]:
    return _auxiliary(f.rows, design(f.terms), f.n, f.k, "breusch_pagan")


def white(f: Fit) -> dict[str, float]:
    """White's test on squares and cross products; NaN where their rank does not allow it."""
    empty = {f"white_{s}": math.nan for s in ("lm", "lm_p", "f", "f_p")}
    if "const" not in f.terms:
        return empty
    x = design(f.terms)
    names = [(a, b) for a in range(f.k) for b in range(a, f.k)]
    columns = [x[a] * x[b] for a, b in names]
    g = gram(f.rows, columns)
    scale = np.sqrt(np.diag(g))
    rank = int(np.linalg.matrix_rank(g / np.outer(scale, scale), hermitian=True, tol=1e-10)) if (scale > 0).all() else 0
    if rank < len(columns) or f.n <= rank:
        return empty
    return _auxiliary(f.rows, columns, f.n, rank, "white")


def classical(f: Fit, order: str) -> DataFrame:
    """One row of classical diagnostics."""
    row = {"model": f.name, "durbin_watson": durbin_watson(f, order), **breusch_pagan(f), **white(f), **jarque_bera(f)}
    return _frame(f.rows.sparkSession, [row], "model string, " + ", ".join(f"{c} double" for c in row if c != "model"))


def lm_tests(f: Fit, edges: DataFrame, index: str = "i") -> dict[str, float]:
    """Lagrange-multiplier tests from sparse edges: no dense n x n matrix is formed.

    ``T = sum(w * w) + sum(w_ij * w_ji)``; the quadratic form with the residual maker of
    ``v = W fitted`` is ``v'v - (X'v)' (X'X)^-1 (X'v)``."""
    names = ("lm_error", "lm_lag", "robust_lm_error", "robust_lm_lag", "lm_sarma")
    s2 = f.sse / f.n
    if s2 <= 0:
        return {n + s: math.nan for n in names for s in ("", "_p")}
    x = design(f.terms)
    rows = f.rows.withColumn("_i", F.col(index))
    values = rows.select(F.col("_i").alias("j"), F.col("residual").alias("uj"), F.col(f.target).alias("yj"), F.col("fitted").alias("fj"))
    lags = edges.join(values, "j").groupBy(F.col("i").alias("_li")).agg(*[F.sum(F.col("weight") * F.col(c)).alias(f"l{c}") for c in ("uj", "yj", "fj")])
    both = rows.join(lags, F.col("_i") == F.col("_li"), "left").select(*[c.alias(f"x{a}") for a, c in enumerate(x)], "residual", *[F.coalesce(f"l{c}", F.lit(0.0)).alias(f"l{c}") for c in ("uj", "yj", "fj")])
    sums = both.agg(
        F.sum(F.col("residual") * F.col("luj")).alias("uwu"), F.sum(F.col("residual") * F.col("lyj")).alias("uwy"), F.sum(F.col("lfj") * F.col("lfj")).alias("vv"), *[F.sum(F.col(f"x{a}") * F.col("lfj")).alias(f"xv{a}") for a in range(f.k)]
    ).first()
    back = edges.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("weight").alias("w2"))
    t1 = edges.agg(F.sum(F.col("weight") * F.col("weight"))).first()[0] or 0.0
    t2 = edges.join(back, ["i", "j"]).agg(F.sum(F.col("weight") * F.col("w2"))).first()[0] or 0.0
    t = t1 + t2
    xv = np.array([sums[f"xv{a}"] for a in range(f.k)])
    j = (sums.vv - xv @ f.inverse @ xv) / s2 + t
    a, b = sums.uwu / s2, sums.uwy / s2
    out = {"lm_error": a * a / t if t > 0 else math.nan, "lm_lag": b * b / j if j > 0 else math.nan}
    out["robust_lm_error"] = (a - t / j * b) ** 2 / (t * (1 - t / j)) if j > 0 and t * (1 - t / j) > 0 else math.nan
    out["robust_lm_lag"] = (b - a) ** 2 / (j - t) if j - t > 0 else math.nan
    out["lm_sarma"] = out["lm_error"] + out["robust_lm_lag"]
    for name in names:
        out[f"{name}_p"] = chi2_sf(out[name], 2 if name == "lm_sarma" else 1)
    return out


def spatial(f: Fit, edges: DataFrame, weights_name: str, permutations: int = 99, seed: int = 7, index: str = "i") -> DataFrame:
    """One row of spatial diagnostics of the residuals; Moran's p is about the simulated mean."""
    from . import autocorrelation as ac

    units = f.rows.select(F.col(index).alias("i"), F.col("residual").alias("x"))
    told = units.agg(F.var_pop("x"), F.count("*")).first()
    s0 = edges.agg(F.sum("weight")).first()[0] or 0.0
    value = p = math.nan
    if told[0] and told[0] > 0 and s0 > 0 and f.sse > 1e-20 * max(1.0, f.tss):
        row = ac.permutation_test(units, edges, "moran", permutations, seed, center="simulated").first()
        value, p = row.value, row.p_value
    connected = edges.select("i").distinct().count()
    row = {"model": f.name, "weights": weights_name, "moran_residual": value, "moran_residual_p": p, "islands": told[1] - connected, **lm_tests(f, edges, index)}
    return _frame(f.rows.sparkSession, [row], "model string, weights string, moran_residual double, moran_residual_p double, islands long, " + ", ".join(f"{c} double" for c in row if c.startswith(("lm_", "robust_"))))
