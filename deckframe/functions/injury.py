"""Occupant injury criteria over many series at once; see ``series`` for the frame they read.

Accelerations are in g for HIC, clip and severity index; the others take SI units. Every function
gives one row a series. Channels of one series share its rows, so unequal lengths end at the
shortest (an inner join on the sample index).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deckframe.functions.series import five_point, integrate, ordered
from deckframe.functions.tensor import resultant


def hic_kernel(a: np.ndarray, dt: float, window: float) -> float:
    """max over t1 < t2 <= t1 + window of (t2 - t1) * (mean of a)^2.5, one pass a window width.

    Squared, that is dv^5 / (t2 - t1)^3 with dv the gain of velocity, so powers need no root until the end.
    """
    n = len(a)
    if n < 2 or dt <= 0:
        return 0.0
    v = np.concatenate([[0.0], np.cumsum((a[1:] + a[:-1]) * (dt / 2))])
    width = min(max(1, int(np.floor(window / dt + 0.5))), n - 1)
    best = 0.0
    for d in range(1, width + 1):
        gain = float((v[d:] - v[:-d]).max())
        if gain > 0:
            best = max(best, gain**5 / (d * dt) ** 3)
    return float(np.sqrt(best))


def hic(df: DataFrame, a: str, dt: float, window: float = 0.036, keys: Sequence[str] = (), order: str = "i", out: str = "hic") -> DataFrame:
    """Head Injury Criterion. A grouped map over Arrow: a series must fit in one task."""
    fields = [f for f in df.schema.fields if f.name in keys]
    schema = T.StructType([*fields, T.StructField(out, T.DoubleType())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x = table.sort_by(order)[a].to_numpy()
        return pa.table([pa.array([k.as_py()], k.type) for k in key] + [pa.array([hic_kernel(x, dt, window)])], names=[*keys, out])

    return df.select(*keys, order, a).groupBy(*keys).applyInArrow(run, schema)


def hic15(df: DataFrame, a: str, dt: float, keys: Sequence[str], order: str = "i") -> DataFrame:
    return hic(df, a, dt, 0.015, keys, order, "hic15")


def hic36(df: DataFrame, a: str, dt: float, keys: Sequence[str], order: str = "i") -> DataFrame:
    return hic(df, a, dt, 0.036, keys, order, "hic36")


def clip(df: DataFrame, a: str, dt: float, keys: Sequence[str], window: float = 0.003, order: str = "i", out: str = "clip") -> DataFrame:
    """The level held for ``window`` seconds: the largest of all full windows' minima; of a shorter series its minimum."""
    width = max(1, int(window / dt + 0.5))
    w = ordered(keys, order)
    low = F.min(a).over(w.rowsBetween(-(width - 1), 0))
    filled = F.count(F.lit(1)).over(w.rowsBetween(-(width - 1), 0))
    rows = df.select(*keys, a, low.alias("_low"), filled.alias("_n"))
    return rows.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_n") == width, F.col("_low"))), F.min(a)).alias(out))


def severity_index(df: DataFrame, a: str, dt: float, keys: Sequence[str], order: str = "i", out: str = "severity_index") -> DataFrame:
    """The integral of a^2.5 (negative values count as 0). A sum less half the ends: no window over samples."""
    p = F.pow(F.greatest(F.col(a), F.lit(0.0)), F.lit(2.5))
    ends = F.min_by(p, order) + F.max_by(p, order)
    return df.groupBy(*keys).agg(F.when(F.count(F.lit(1)) < 2, 0.0).otherwise((F.sum(p) - ends / 2.0) * dt).alias(out))


def peak(x: str | Column) -> Column:
    """Aggregate: the largest absolute value, 0 for none."""
    return F.coalesce(F.max(F.abs(x)), F.lit(0.0))


def bric(df: DataFrame, rates: Sequence[str], critical: Sequence[float], keys: Sequence[str], out: str = "bric") -> DataFrame:
    return df.groupBy(*keys).agg(resultant(*(peak(x) / c for x, c in zip(rates, critical, strict=True))).alias(out))


def ubric(df: DataFrame, rates: Sequence[str], accelerations: Sequence[str], critical_rates: Sequence[float], critical_accelerations: Sequence[float], keys: Sequence[str], out: str = "ubric") -> DataFrame:
    def axis(w: Column, a: Column) -> Column:
        return F.when(w == 0, a).otherwise(w + (a - w) * F.exp(-a / w))

    terms = [axis(peak(w) / cw, peak(a) / ca) for w, a, cw, ca in zip(rates, accelerations, critical_rates, critical_accelerations, strict=True)]
    return df.groupBy(*keys).agg(resultant(*terms).alias(out))


def vc(df: DataFrame, y: str, dt: float, keys: Sequence[str], scaling: float = 1.0, depth: float = 0.229, order: str = "i", out: str = "vc") -> DataFrame:
    """Viscous Criterion over the interior samples; 0 for fewer than five. May be negative."""
    if dt <= 0 or depth == 0:
        return df.groupBy(*keys).agg(F.lit(0.0).alias(out))
    rows = five_point(df.select(*keys, order, y), y, dt, keys, order, "_rate")
    return rows.groupBy(*keys).agg(F.coalesce(F.max(scaling * (F.col(y) / depth) * F.col("_rate")), F.lit(0.0)).alias(out))


def nij(df: DataFrame, fx: str, fz: str, my: str, keys: Sequence[str], distance: float, tension: float, compression: float, flexion: float, extension: float, out: str = "nij") -> DataFrame:
    """Neck injury; compression and extension are given with the sign of their direction. 0 at least."""
    moment = F.col(my) - distance * F.col(fx)
    axial = F.col(fz) / F.when(F.col(fz) <= 0, F.lit(compression)).otherwise(F.lit(tension))
    bending = moment / F.when(moment > 0, F.lit(flexion)).otherwise(F.lit(extension))
    return df.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.max(axial + bending)).alias(out))


def nic(df: DataFrame, a_t1: str, a_head: str, dt: float, keys: Sequence[str], order: str = "i", out: str = "nic") -> DataFrame:
    """Rear-impact neck injury: the largest 0.2 * a_rel + v_rel^2."""
    rows = df.select(*keys, order, (F.col(a_t1) - F.col(a_head)).alias("_a"))
    rows = integrate(rows, "_a", dt, keys, order, "_v")
    return rows.groupBy(*keys).agg(F.max(0.2 * F.col("_a") + F.col("_v") * F.col("_v")).alias(out))


def tibia_index(df: DataFrame, mx: str, my: str, fz: str, keys: Sequence[str], critical_moment: float, critical_force: float, out: str = "tibia_index") -> DataFrame:
    value = F.abs(resultant(F.col(mx), F.col(my)) / critical_moment) + F.abs(F.col(fz) / critical_force)
    return df.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.max(value)).alias(out))


