"""Per-state reductions over the elements of parts, and state tables.

Frames hold one row for a (state, element): ``keys`` name the series (part, state), and a quantity
is any Column over the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def part_max(df: DataFrame, quantity: Column, keys: Sequence[str], out: str = "value") -> DataFrame:
    """The largest quantity, 0 at least."""
    return df.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.max(quantity)).alias(out))


def part_percentile(df: DataFrame, quantity: Column, percent: float, keys: Sequence[str], out: str = "value") -> DataFrame:
    """The exact percentile with linear interpolation, percent in 0 to 100."""
    p = min(1.0, max(0.0, percent / 100.0))
    return df.groupBy(*keys).agg(F.coalesce(F.percentile(quantity, F.lit(p)), F.lit(0.0)).alias(out))


def part_fraction(df: DataFrame, quantity: Column, threshold: float, keys: Sequence[str], out: str = "value") -> DataFrame:
    """The share of elements whose quantity exceeds the threshold."""
    return df.groupBy(*keys).agg(F.avg(F.when(quantity > threshold, 1.0).otherwise(0.0)).alias(out))


def part_argmax(df: DataFrame, quantity: Column, element: str, keys: Sequence[str], out: str = "value") -> DataFrame:
    """The largest quantity and the first element that has it."""
    best = F.max(F.struct(quantity.alias("q"), (-F.col(element)).alias("e")))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.e")).alias(element), F.col("b.q").alias(out))


def with_states(states: DataFrame, reduced: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Every state, with 0 where the part has no element."""
    return states.join(reduced, list(keys), "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def state_matrix(df: DataFrame, state: str, column: str, value: Column, columns: Sequence[object]) -> DataFrame:
    """Long to wide: a row a state, a column for each of ``columns``, 0.0 where there is none."""
    wide = df.withColumn("_v", value).groupBy(state).pivot(column, list(columns)).agg(F.sum("_v"))
    return wide.na.fill(0.0, [str(c) for c in columns])
