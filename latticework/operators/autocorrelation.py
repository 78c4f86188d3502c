"""Global and local spatial autocorrelation with permutation inference.

Permutations need no generator state: permutation ``p`` orders the units by
``md5(seed:p:id)``, so results are the same for any partitioning and after any retry.  The
statistics of all permutations come from one aggregate over edges and permutations.
Comparisons with the observed value are made on values rounded to ten decimals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DataContractError, WeightsError
from .lineage import cut
from .weights import cardinalities, lag

DIGITS = 10
PREFIX_ROWS = 100_000


def checked(units: DataFrame, edges: DataFrame, column: str = "x") -> DataFrame:
    """Units with ``z``, the centred value; error on non-finite or constant values or S0 of zero."""
    x = F.col(column)
    told = units.agg(F.count("*").alias("n"), F.count_if(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).alias("bad"), F.avg(x).alias("mean"), F.var_pop(x).alias("var")).first()
    if told.bad:
        raise DataContractError(f"{told.bad} values are not finite")
    if not told.n or told.var is None or told.var <= 1e-12 * max(1.0, told.mean**2):
        raise DataContractError("values have no variance")
    if not (edges.agg(F.sum("weight")).first()[0] or 0) > 0:
        raise WeightsError("weights sum to zero")
    return units.withColumn("z", x - F.lit(told.mean))


def placed(units: DataFrame, permutations: int, seed: int, column: str = "z") -> DataFrame:
    """``(p, o, pos, v)``: the place of unit ``o`` in permutation ``p``, from zero, and its value.

    A place is the rank inside a prefix of the hash and the rows of the prefixes before it;
    prefixes get longer with the units, so a task sorts ``PREFIX_ROWS`` of them or so."""
    n = units.count()
    digits = max(0, math.ceil(math.log(max(1, n / PREFIX_ROWS), 16)))
    rows = units.select(F.col("i").alias("o"), F.col(column).alias("v"), F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("p"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("p").cast("string"), F.lit(":"), F.col("o").cast("string")))
    rows = rows.withColumn("key", key).withColumn("prefix", F.substring("key", 1, digits))
    rank = F.row_number().over(Window.partitionBy("p", "prefix").orderBy("key")) - 1
    rows = rows.withColumn("rank", rank)
    if digits:
        counts = rows.groupBy("p", "prefix").agg(F.count("*").alias("n"))
        offsets = counts.select("p", "prefix", (F.sum("n").over(Window.partitionBy("p").orderBy("prefix")) - F.col("n")).alias("before"))
        rows = rows.join(offsets, ["p", "prefix"])
    else:
        rows = rows.withColumn("before", F.lit(0))
    return rows.select("p", "o", (F.col("before") + F.col("rank")).cast("long").alias("pos"), "v")


def permuted(units: DataFrame, permutations: int, seed: int, column: str = "z") -> DataFrame:
    """``(p, i, v)``: the value that unit ``i`` (dense index) gets in permutation ``p``."""
    return placed(units, permutations, seed, column).select("p", F.col("pos").alias("i"), "v")


def _moran_sum(edges: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    a = values.select(*by, "i", F.col("v").alias("vi"))
    b = values.select(*by, F.col("i").alias("j"), F.col("v").alias("vj"))
    return edges.join(a, "i").join(b, [*by, "j"])


def _constants(units: DataFrame, edges: DataFrame) -> dict[str, float]:
    u = units.agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("z")).alias("ss")).first()
    return {"n": u.n, "ss": u.ss, "s0": edges.agg(F.sum("weight")).first()[0]}


def global_values(edges: DataFrame, values: DataFrame, constants: dict[str, float], statistic: str, by: list[str]) -> DataFrame:
    """Moran's I or Geary's C of ``values(by, i, v)`` as column ``value``."""
    joined = _moran_sum(edges, values, by)
    n, ss, s0 = constants["n"], constants["ss"], constants["s0"]
    if statistic == "moran":
        term, factor = F.col("weight") * F.col("vi") * F.col("vj"), n / s0 / ss
    elif statistic == "geary":
        term, factor = F.col("weight") * F.pow(F.col("vi") - F.col("vj"), F.lit(2.0)), (n - 1) / (2 * s0) / ss
    else:
        raise WeightsError(f"unknown statistic {statistic!r}")
    return joined.groupBy(*by).agg((F.sum(term) * F.lit(factor)).alias("value"))


def moran(units: DataFrame, edges: DataFrame, column: str = "x") -> DataFrame:
    """One row: value of Moran's I."""
    units = checked(units, edges, column)
    return global_values(edges, units.select("i", F.col("z").alias("v")), _constants(units, edges), "moran", [])


def geary(units: DataFrame, edges: DataFrame, column: str = "x") -> DataFrame:
    """One row: value of Geary's C."""
    units = checked(units, edges, column)
    return global_values(edges, units.select("i", F.col("z").alias("v")), _constants(units, edges), "geary", [])


def permutation_test(units: DataFrame, edges: DataFrame, statistic: str = "moran", permutations: int = 99, seed: int = 7, alternative: str = "two-sided", center: str = "expected", column: str = "x") -> DataFrame:
    """One row: value, expected, p_value, permutations, alternative, simulated_mean, simulated_std.

    ``center`` of the two-sided test: the analytic ``expected`` value, the mean of the
    ``simulated`` ones, or ``zero``."""
    if alternative not in ("two-sided", "greater", "less"):
        raise WeightsError(f"unknown alternative {alternative!r}")
    units = checked(units, edges, column)
    constants = _constants(units, edges)
    observed = global_values(edges, units.select("i", F.col("z").alias("v")), constants, statistic, []).select(F.round("value", DIGITS).alias("value"))
    simulated = global_values(edges, permuted(units, permutations, seed), constants, statistic, ["p"]).select(F.round("value", DIGITS).alias("sim"))
    expected = -1 / (constants["n"] - 1) if statistic == "moran" else 1.0
    both = simulated.join(F.broadcast(observed))  # one row
    mean = F.round(F.avg("sim").over(Window.partitionBy()), DIGITS)  # one row per permutation
    middle = {"expected": F.lit(expected), "simulated": mean, "zero": F.lit(0.0)}[center]
    extreme = {
        "greater": F.col("sim") >= F.col("value"),
        "less": F.col("sim") <= F.col("value"),
        "two-sided": F.round(F.abs(F.col("sim") - F.col("mid")), DIGITS) >= F.round(F.abs(F.col("value") - F.col("mid")), DIGITS),
    }[alternative]
    return both.withColumn("mid", middle).agg(
        F.first("value").alias("value"),
        F.lit(expected).alias("expected"),
        ((F.count_if(extreme) + 1) / F.lit(permutations + 1)).alias("p_value"),
        F.count("*").alias("permutations"),
        F.lit(alternative).alias("alternative"),
        F.avg("sim").alias("simulated_mean"),
        F.coalesce(F.stddev_samp("sim"), F.lit(0.0)).alias("simulated_std"),
    )


def residual_moran(units: DataFrame, edges: DataFrame, permutations: int = 99, seed: int = 7, column: str = "x") -> tuple[float, float]:
    """Moran's I about zero and its p-value; (0.0, 1.0) for values without variance."""
    var = units.agg(F.var_pop(column)).first()[0]
    if not var:
        return 0.0, 1.0
    row = permutation_test(units, edges, "moran", permutations, seed, center="zero", column=column).first()
    return row.value, row.p_value


def benjamini_hochberg(df: DataFrame, p: str = "p_value", order: str = "i", out: str = "q_value") -> DataFrame:
    """Adds q-values: the reverse running minimum of ``p * n / rank``, clipped to [0, 1].

    Ranks and minima run over the distinct p-values, inside ranges of them; what the ranges
    before and after one contribute is a row for each range."""
    counts = df.groupBy(p).agg(F.count("*").alias("_c")).repartitionByRange(p)
    ranges = cut(counts.withColumn("_b", F.spark_partition_id()))
    sums = ranges.groupBy("_b").agg(F.sum("_c").alias("_s"))
    upto = F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")
    sums = sums.select("_b", upto.alias("_before"), F.sum("_s").over(Window.partitionBy()).alias("_n"))
    rank = F.col("_before") + F.sum("_c").over(Window.partitionBy("_b").orderBy(p))
    ranked = ranges.join(F.broadcast(sums), "_b").withColumn("_a", F.col(p) * F.col("_n") / rank)
    # Of equal p-values the last rank has the least adjusted value, so one value serves them all.
    low = F.min("_a").over(Window.partitionBy("_b").orderBy(F.desc(p)))
    later = F.min("_m").over(Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1))
    after = ranked.groupBy("_b").agg(F.min("_a").alias("_m")).select("_b", later.alias("_later"))
    told = ranked.withColumn("_low", low).join(F.broadcast(after), "_b")
    q = told.select(p, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_low", "_later")).alias(out))
    return df.join(q, p)


def _label(z: Column, lagged: Column, significant: Column, island: Column | None) -> Column:
    kind = F.when((z >= 0) & (lagged >= 0), "HH").when((z < 0) & (lagged < 0), "LL").when((z >= 0) & (lagged < 0), "HL").otherwise("LH")
    out = F.when(significant, kind).otherwise("NS")
    return out if island is None else F.when(island, "Island").otherwise(out)


def conditional_values(units: DataFrame, edges: DataFrame, permutations: int, seed: int) -> DataFrame:
    """``(i, p, slag)``: simulated lag of unit ``i`` when its neighbours' values are drawn without
    replacement from all other units.

    A permutation puts the units in a ring; unit ``i`` takes the values of the units that follow
    it there, as many as it has neighbours.  They are a uniform ordered draw from the others, and
    the work is in proportion to edges and permutations at any number of units."""
    n = units.count()
    slots = edges.select("i", "weight", F.row_number().over(Window.partitionBy("i").orderBy("j")).alias("slot"))
    ring = cut(placed(units, permutations, seed))  # read twice
    asked = slots.join(ring.select("p", F.col("o").alias("i"), F.col("pos").alias("own")), "i")
    asked = asked.select("i", "p", "weight", ((F.col("own") + F.col("slot")) % F.lit(n)).alias("pos"))
    return asked.join(ring.select("p", "pos", "v"), ["p", "pos"]).groupBy("i", "p").agg(F.sum(F.col("weight") * F.col("v")).alias("slag"))


def local_moran(units: DataFrame, edges: DataFrame, permutations: int = 99, seed: int = 7, alpha: float = 0.05, fdr: bool = True, column: str = "x") -> DataFrame:
    """Local Moran with conditional permutations, two-sided about each unit's simulated mean.

    Columns: i, value, z, spatial_lag_z, local_moran, p_value, q_value, significant, cluster, neighbors."""
    units = checked(units, edges, column)
    m2 = units.agg(F.avg(F.col("z") * F.col("z"))).first()[0]
    base = units.join(lag(edges, units, "z"), "i").join(cardinalities(edges, units), "i")
    base = base.select("i", F.col(column).alias("value"), "z", F.col("lag").alias("spatial_lag_z"), F.round(F.col("z") * F.col("lag") / m2, DIGITS).alias("local_moran"), "neighbors")
    sims = conditional_values(units, edges, permutations, seed).join(units.select("i", "z"), "i").select("i", F.round(F.col("z") * F.col("slag") / m2, DIGITS).alias("sim"))
    tested = _two_sided(sims, base.select("i", F.col("local_moran").alias("obs")), permutations)
    told = base.join(tested, "i", "left").withColumn("p_value", F.when(F.col("neighbors") == 0, 1.0).otherwise(F.col("p_value")))
    told = benjamini_hochberg(cut(told))  # read twice there
    told = told.withColumn("significant", (F.col("q_value" if fdr else "p_value") <= alpha) & (F.col("neighbors") > 0))
    return told.withColumn("cluster", _label(F.col("z"), F.col("spatial_lag_z"), F.col("significant"), F.col("neighbors") == 0)).select(
        "i", "value", "z", "spatial_lag_z", "local_moran", "p_value", "q_value", "significant", "cluster", "neighbors"
    )


def _two_sided(sims: DataFrame, observed: DataFrame, permutations: int) -> DataFrame:
    """``(i, p_value)`` about the mean of each unit's simulated values."""
    mid = F.round(F.avg("sim").over(Window.partitionBy("i")), DIGITS)
    joined = sims.withColumn("mid", mid).join(observed, "i")
    extreme = F.round(F.abs(F.col("sim") - F.col("mid")), DIGITS) >= F.round(F.abs(F.col("obs") - F.col("mid")), DIGITS)
    return joined.groupBy("i").agg(((F.count_if(extreme) + 1) / F.lit(permutations + 1)).alias("p_value"))


def local_moran_unconditional(units: DataFrame, edges: DataFrame, permutations: int = 99, seed: int = 7, alpha: float = 0.05, column: str = "x") -> DataFrame:
    """Local Moran against permutations of all values: i, local_i, local_p, spatial_lag, cluster.

    Without variance: zeros, p of one, NS."""
    mean, var = units.agg(F.avg(column), F.var_pop(column)).first()
    if not var:
        return units.select("i", F.lit(0.0).alias("local_i"), F.lit(1.0).alias("local_p"), F.lit(0.0).alias("spatial_lag"), F.lit("NS").alias("cluster"))
    units = units.withColumn("z", F.col(column) - F.lit(mean))
    m2 = units.agg(F.avg(F.col("z") * F.col("z"))).first()[0]
    observed = units.join(lag(edges, units, "z"), "i").select("i", "z", F.col("lag").alias("spatial_lag"), F.round(F.col("z") * F.col("lag") / m2, DIGITS).alias("local_i"))
    values = permuted(units, permutations, seed)
    lags = edges.join(values.select("p", F.col("i").alias("j"), F.col("v").alias("vj")), "j").groupBy("p", "i").agg(F.sum(F.col("weight") * F.col("vj")).alias("l"))
    sims = values.join(lags, ["p", "i"], "left").select("i", F.round(F.col("v") * F.coalesce("l", F.lit(0.0)) / m2, DIGITS).alias("sim"))
    counted = sims.join(observed.select("i", "local_i"), "i").groupBy("i").agg(((F.count_if(F.abs("sim") >= F.abs("local_i")) + 1) / F.lit(permutations + 1)).alias("local_p"))
    told = observed.join(counted, "i")
    return told.select("i", "local_i", "local_p", "spatial_lag", _label(F.col("z"), F.col("spatial_lag"), F.col("local_p") <= alpha, None).alias("cluster"))


def getis_ord(units: DataFrame, edges: DataFrame, permutations: int = 99, seed: int = 7, alpha: float = 0.05, fdr: bool = True, column: str = "x") -> DataFrame:
    """G* with unconditional permutations: i, value, g_star, p_value, q_value, significant,
    classification, neighbors_with_self.  The diagonal of the weights is set to one."""
    units = checked(units, edges, column)
    mean, square, n = units.agg(F.avg(column), F.avg(F.col(column) * F.col(column)), F.count("*")).first()
    s = max(0.0, square - mean * mean) ** 0.5
    if s <= 1e-12 * max(1.0, abs(mean)):
        raise DataContractError("values have no variance")
    full = edges.where("i <> j").unionByName(units.select("i", F.col("i").alias("j"), F.lit(1.0).alias("weight")))
    sums = full.groupBy("i").agg(F.sum("weight").alias("sw"), F.sum(F.col("weight") * F.col("weight")).alias("sw2"), F.count_if(F.col("weight") != 0).alias("neighbors_with_self"))
    spread = sums.withColumn("den", F.lit(s) * F.sqrt(F.greatest(F.lit(0.0), (n * F.col("sw2") - F.col("sw") * F.col("sw")) / (n - 1))))
    if spread.where(F.col("den") <= 1e-12).limit(1).count():
        raise WeightsError("G* is not defined: a unit's weights leave no variance")
    values = units.select("i", F.col(column).alias("v"))

    def g(values: DataFrame, by: list[str]) -> DataFrame:
        sums_x = full.join(values.select(*by, F.col("i").alias("j"), F.col("v").alias("vj")), "j").groupBy(*by, "i").agg(F.sum(F.col("weight") * F.col("vj")).alias("wx"))
        return sums_x.join(spread, "i").withColumn("g", F.round((F.col("wx") - F.lit(mean) * F.col("sw")) / F.col("den"), DIGITS))

    observed = g(values, []).select("i", F.col("g").alias("g_star"), "neighbors_with_self").join(units.select("i", F.col(column).alias("value")), "i")
    sims = g(permuted(units, permutations, seed, column), ["p"]).select("i", F.col("g").alias("sim"))
    observed = cut(observed)
    told = benjamini_hochberg(cut(observed.join(_two_sided(sims, observed.select("i", F.col("g_star").alias("obs")), permutations), "i")))
    told = told.withColumn("significant", F.col("q_value" if fdr else "p_value") <= alpha)
    kind = F.when(~F.col("significant"), "NS").when(F.col("g_star") > 0, "Hot").otherwise("Cold")
    return told.withColumn("classification", kind).select("i", "value", "g_star", "p_value", "q_value", "significant", "classification", "neighbors_with_self")
