"""Contracts, quality reports and validated one-to-one joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DataContractError
from .lineage import cut


def normal_key(column: str | Column) -> Column:
    """Keys compare as trimmed strings."""
    column = F.col(column) if isinstance(column, str) else column
    return F.trim(column.cast("string"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """``(key, rows)`` of keys that occur more than once."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def check_unique_key(df: DataFrame, key: str, label: str) -> None:
    """Error unless ``key`` exists, has no nulls and no duplicates (five offenders are named)."""
    if key not in df.columns:
        raise DataContractError(f"{label}: key column {key!r} is missing")
    if df.where(F.col(key).isNull()).limit(1).count():
        raise DataContractError(f"{label}: key column {key!r} holds nulls")
    offenders = [r[key] for r in duplicate_keys(df, key).orderBy(key).limit(5).collect()]
    if offenders:
        raise DataContractError(f"{label}: key column {key!r} holds duplicates, such as {offenders}")


def parsed_number(column: str) -> Column:
    return F.trim(F.col(column).cast("string")).try_cast("double")


def numeric_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: values present that are not numbers."""
    bad = [F.count_if(F.col(c).isNotNull() & parsed_number(c).isNull()).alias(c) for c in columns]
    return df.agg(*bad).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*columns))).alias("column", "violations"))


def as_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the columns as doubles; error if a present value is not a number."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise DataContractError(f"columns are missing: {missing}")
    bad = {r["column"]: r.violations for r in numeric_violations(df, columns).collect() if r.violations}
    if bad:
        raise DataContractError(f"values that are not numbers: {bad}")
    return df.withColumns({c: parsed_number(c) for c in columns})


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: its nulls; one pass over the table."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*columns))).alias("column", "missing"))


def prepare_units(df: DataFrame, id_column: str, value_column: str) -> DataFrame:
    """The unit contract of autocorrelation: ids present, not blank and unique after trimming;
    values numeric without nulls and not constant.  Returns ``df`` with ``id`` and ``i``."""
    for c in (id_column, value_column):
        if c not in df.columns:
            raise DataContractError(f"column {c!r} is missing")
    number = parsed_number(value_column)
    told = df.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col(id_column).isNull() | (normal_key(id_column) == "")).alias("blank"),
        F.count_if(number.isNull() | F.isnan(number)).alias("not_numbers"),
        F.count_distinct(number).alias("distinct"),
    ).first()
    if not told.rows:
        raise DataContractError("the table is empty")
    if told.blank:
        raise DataContractError(f"{told.blank} ids are null or blank")
    if told.not_numbers:
        raise DataContractError(f"{told.not_numbers} values of {value_column!r} are missing or not numbers")
    if told.distinct < 2:
        raise DataContractError(f"{value_column!r} has fewer than two distinct values")
    keyed = df.withColumn("id", normal_key(id_column)).withColumn(value_column, number)
    check_unique_key(keyed, "id", "units")
    return dense_index(keyed, "id")


def dense_index(df: DataFrame, order: str) -> DataFrame:
    """Adds ``i``: the rank of ``order`` from zero, without a single-task window.

    A range exchange sorts the rows; partition counts (one small row each) give the offsets."""
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_m", F.monotonically_increasing_id())
    split = ranged.withColumn("_p", F.shiftright("_m", 33)).withColumn("_r", F.col("_m").bitwiseAND((1 << 33) - 1))
    split = cut(split)  # read twice below; adaptive plans could number its partitions differently
    counts = split.groupBy("_p").agg(F.count("*").alias("_n"))
    # One row per partition.
    starts = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_s"))
    return split.join(F.broadcast(starts), "_p").withColumn("i", F.col("_s") + F.col("_r")).drop("_m", "_p", "_r", "_s")


def join_report(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """One row: n_spatial, n_table, matched, unmatched_spatial, unused_table, match_rate."""
    a = left.select(normal_key(left_key).alias("k"), F.lit(1).alias("a"))
    b = right.select(normal_key(right_key).alias("k"), F.lit(1).alias("b"))
    both = a.join(b, "k", "full_outer")
    told = both.agg(
        F.count("a").alias("n_spatial"),
        F.count("b").alias("n_table"),
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"),
        F.count_if(F.col("b").isNull()).alias("unmatched_spatial"),
        F.count_if(F.col("a").isNull()).alias("unused_table"),
    )
    return told.withColumn("match_rate", F.when(F.col("n_spatial") > 0, F.col("matched") / F.col("n_spatial")).otherwise(0.0))


def unmatched(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of ``left`` without a partner."""
    keys = right.select(normal_key(right_key).alias("_k"))
    return left.join(keys, normal_key(left_key) == F.col("_k"), "left_anti")


def matched(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of ``left`` with a partner."""
    keys = right.select(normal_key(right_key).alias("_k"))
    return left.join(keys, normal_key(left_key) == F.col("_k"), "left_semi")


def join_one_to_one(left: DataFrame, right: DataFrame, left_key: str, right_key: str, minimum_match_rate: float = 1.0):
    """Validated left join of one row to at most one; ``(joined, report row, unmatched, unused)``.

    Columns other than the key that both sides have get the suffixes ``_x`` and ``_y``."""
    if not 0 <= minimum_match_rate <= 1:
        raise DataContractError("minimum_match_rate must lie between 0 and 1")
    for df, key, label in ((left, left_key, "spatial"), (right, right_key, "table")):
        if key not in df.columns:
            raise DataContractError(f"{label}: key column {key!r} is missing")
        check_unique_key(df.withColumn(key, normal_key(key)), key, label)
    report = join_report(left, right, left_key, right_key).first()
    if report.match_rate < minimum_match_rate:
        raise DataContractError(f"match rate {report.match_rate:.4f} is below {minimum_match_rate:.4f}")
    shared = (set(left.columns) & set(right.columns)) - ({left_key} if left_key == right_key else set())
    a = left.withColumn("_k", normal_key(left_key)).withColumnsRenamed({c: f"{c}_x" for c in shared})
    b = right.withColumn("_k", normal_key(right_key)).withColumnsRenamed({c: f"{c}_y" for c in shared})
    if left_key == right_key:
        b = b.drop(right_key)
    joined = a.join(b, "_k", "left").drop("_k")
    return joined, report, unmatched(left, right, left_key, right_key), unmatched(right, left, right_key, left_key)
