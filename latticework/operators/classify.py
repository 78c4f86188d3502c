"""Class breaks for maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DataContractError
from .quality import parsed_number

SINGLE = "valor único"


def breaks(df: DataFrame, column: str, method: str, k: int) -> list[float]:
    """Edges of at most ``k`` right-closed classes; fewer if values or quantiles coincide."""
    value = parsed_number(column)
    told = df.select(value.alias("v")).agg(F.count_distinct("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    if not told.n:
        raise DataContractError(f"{column!r} holds no numbers")
    bins = min(max(1, k), told.n)
    if bins == 1:
        return [told.low, told.high]
    if method == "quantiles":
        got = df.select(value.alias("v")).agg(F.percentile("v", F.array(*[F.lit(j / bins) for j in range(bins + 1)]))).first()[0]
        return sorted(set(got))
    if method == "equal_interval":
        step = (told.high - told.low) / bins
        return [told.low + step * j for j in range(bins)] + [told.high]
    raise DataContractError(f"unknown method {method!r}")


def label(low: float, high: float, first: bool, span: float) -> str:
    """Right-closed interval; the lowest one reaches a little below the least value."""
    return f"({low - (0.001 if span is None else span):.3f}, {high:.3f}]" if first else f"({low:.3f}, {high:.3f}]"


def classify(df: DataFrame, column: str, method: str = "quantiles", k: int = 5, out: str = "class") -> DataFrame:
    """Adds ``class_index`` (from 0), ``class_low``, ``class_high``, and the label; nulls stay null."""
    edges = breaks(df, column, method, k)
    value = parsed_number(column)
    if len(edges) == 2 and edges[0] == edges[1]:
        one = F.when(value.isNotNull(), F.lit(0))
        return df.withColumns({"class_index": one, "class_low": F.when(one.isNotNull(), edges[0]), "class_high": F.when(one.isNotNull(), edges[1]), out: F.when(one.isNotNull(), SINGLE)})
    index = F.when(value.isNotNull(), sum(((value > e).cast("int") for e in edges[1:-1]), F.lit(0)))
    span = None if method == "quantiles" else 0.001 * (edges[-1] - edges[0])
    pick = lambda values: F.when(value.isNotNull(), F.element_at(F.array(*map(F.lit, values)), index + 1))
    labels = [label(a, b, j == 0, span) for j, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return df.withColumns({"class_index": index, "class_low": pick(edges[:-1]), "class_high": pick(edges[1:]), out: pick(labels)})
