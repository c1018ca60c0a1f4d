"""Ordered-sequence operators over many series at once.

A frame holds one row a sample: key columns that name the series, an order column (the sample's
index from 0, gapless) and channels. Every function adds a column, or resamples, with windows over
(keys, order): one shuffle and sort serve a whole chain of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def ordered(keys: Sequence[str], order: str = "i") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def indexed(df: DataFrame, keys: Sequence[str], *order: str | Column, out: str = "i") -> DataFrame:
    """Numbers the samples of each series from 0."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)


def integrate(df: DataFrame, x: str, dt: float, keys: Sequence[str], order: str = "i", out: str = "integral") -> DataFrame:
    """Cumulative trapezoid with a constant step, 0 at the first sample.

    The running trapezoid is the running sum less half of the first and the last value, so one window does.
    """
    w = ordered(keys, order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.lit(dt) * (F.sum(x).over(run) - (F.first(x).over(run) + F.col(x)) / 2.0))


def integrate_over(df: DataFrame, t: str, x: str, keys: Sequence[str], order: str = "i", out: str = "integral") -> DataFrame:
    """Cumulative trapezoid over the times ``t``, 0 at the first sample."""
    w = ordered(keys, order)
    area = (F.col(t) - F.lag(t).over(w)) * (F.col(x) + F.lag(x).over(w)) / 2.0
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_area", F.coalesce(area, F.lit(0.0))).withColumn(out, F.sum("_area").over(run)).drop("_area")


def differentiate(df: DataFrame, x: str, dt: float, keys: Sequence[str], order: str = "i", out: str = "derivative") -> DataFrame:
    """Central differences, one-sided at the ends; 0 for a series of one sample."""
    w = ordered(keys, order)
    before, after, own = F.lag(x).over(w), F.lead(x).over(w), F.col(x)
    slope = F.coalesce((after - before) / (2.0 * dt), (after - own) / dt, (own - before) / dt, F.lit(0.0))
    return df.withColumn(out, slope)


def five_point(df: DataFrame, x: str, dt: float, keys: Sequence[str], order: str = "i", out: str = "derivative") -> DataFrame:
    """Five-point derivative; null for the two samples at either end."""
    w = ordered(keys, order)
    at = lambda k: F.lead(x, k).over(w) if k > 0 else F.lag(x, -k).over(w)
    return df.withColumn(out, (8.0 * (at(1) - at(-1)) - (at(2) - at(-2))) / (12.0 * dt))


def decimate(df: DataFrame, factor: int, order: str = "i") -> DataFrame:
    """Every ``factor``-th sample, renumbered; a filter, without a shuffle."""
    if factor <= 1:
        return df
    return df.where(F.col(order) % factor == 0).withColumn(order, (F.col(order) / factor).cast("long"))


def resample_linear(df: DataFrame, x: str, dt_in: float, dt_out: float, keys: Sequence[str], order: str = "i") -> DataFrame:
    """keys, order, x at step ``dt_out`` by linear interpolation over the same time.

    Every sample writes those new samples that lie between it and the next one, so a series is
    never gathered: the work is the window's, row by row.
    """
    w = ordered(keys, order)
    step = dt_out / dt_in
    nxt, i = F.lead(x).over(w), F.col(order)
    own = df.withColumn("_next", nxt)
    # new sample k lies at k * step, in [i, i + 1); the last sample holds only those that fall on it
    first = F.ceil(i / F.lit(step) - F.lit(1e-9)).cast("long")
    last = F.when(F.col("_next").isNull(), F.floor(i / F.lit(step) + F.lit(1e-9)).cast("long")).otherwise(F.ceil((i + 1) / F.lit(step) - F.lit(1e-9)).cast("long") - 1)
    new = own.withColumn("_first", first).withColumn("_last", last).where(F.col("_last") >= F.col("_first"))
    new = new.withColumn("_k", F.explode(F.sequence("_first", "_last")))
    part = F.greatest(F.lit(0.0), F.col("_k") * F.lit(step) - i)
    value = F.when(F.col("_next").isNull(), F.col(x)).otherwise(F.col(x) * (1.0 - part) + F.col("_next") * part)
    return new.select(*keys, F.col("_k").alias("_o"), value.alias("_x")).select(*keys, F.col("_o").alias(order), F.col("_x").alias(x))


def extract(df: DataFrame, t: str, x: str, keys: Sequence[str], order: str = "i") -> DataFrame:
    """One row a series: last, first, max, min, abs_max, mean and the integral over ``t`` (0.0 where null)."""
    whole = integrate_over(df, t, x, keys, order, "_sum")
    nil = lambda c: F.coalesce(c, F.lit(0.0))
    return whole.groupBy(*keys).agg(
        nil(F.max_by(x, order)).alias("last"), nil(F.min_by(x, order)).alias("first"), nil(F.max(x)).alias("max"), nil(F.min(x)).alias("min"),
        nil(F.max(F.abs(x))).alias("abs_max"), nil(F.avg(x)).alias("mean"), nil(F.max_by("_sum", order)).alias("integral"),
    )
