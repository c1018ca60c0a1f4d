"""Invariants of a symmetric tensor as Column expressions: components xx, yy, zz, xy, yz, zx."""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resultant(*parts: Column) -> Column:
    """The Euclidean norm of the given components."""
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def mean_stress(xx: Column, yy: Column, zz: Column) -> Column:
    return (xx + yy + zz) / 3.0


def pressure(xx: Column, yy: Column, zz: Column) -> Column:
    """Compression positive."""
    return -mean_stress(xx, yy, zz)


def second_invariant(xx: Column, yy: Column, zz: Column, xy: Column, yz: Column, zx: Column) -> Column:
    """J2 of the deviator."""
    d = [xx - yy, yy - zz, zz - xx]
    return (d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) / 6.0 + (xy * xy + yz * yz + zx * zx)


def von_mises(xx: Column, yy: Column, zz: Column, xy: Column, yz: Column, zx: Column) -> Column:
    return F.sqrt(3.0 * second_invariant(xx, yy, zz, xy, yz, zx))


def principal(xx: Column, yy: Column, zz: Column, xy: Column, yz: Column, zx: Column) -> Column:
    """array<double> of the three principal values, descending.

    The deviator's invariants give the Lode angle; a diagonal tensor is only sorted.
    """
    q = mean_stress(xx, yy, zz)
    a, b, c = xx - q, yy - q, zz - q
    j2 = second_invariant(xx, yy, zz, xy, yz, zx)
    j3 = a * b * c + 2.0 * xy * yz * zx - a * yz * yz - b * zx * zx - c * xy * xy
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1.5 * math.sqrt(3.0) * j3 / (j2 * F.sqrt(j2))))
    angle, size = F.acos(cosine) / 3.0, 2.0 * F.sqrt(j2 / 3.0)
    first = q + size * F.cos(angle)
    last = q + size * F.cos(angle + 2.0 * math.pi / 3.0)
    shear = (xy != 0) | (yz != 0) | (zx != 0)
    return F.when(shear, F.array(first, 3.0 * q - first - last, last)).otherwise(F.sort_array(F.array(xx, yy, zz), asc=False))


def max_shear(xx: Column, yy: Column, zz: Column, xy: Column, yz: Column, zx: Column) -> Column:
    """Half the range of the principal values."""
    p = principal(xx, yy, zz, xy, yz, zx)
    return (F.get(p, F.lit(0)) - F.get(p, F.lit(2))) / 2.0


def with_principal(df: DataFrame, six: Sequence[Column], names: Sequence[str] = ("s1", "s2", "s3")) -> DataFrame:
    """``df`` with the three principal values as columns, descending.

    The same values as ``principal``, in steps: what a step names is evaluated once for each row,
    however many columns need it, and each step stays small enough to be compiled.
    """
    pre = "_p"
    while any(c.lower().startswith(pre) for c in df.columns):
        pre = f"_{pre}"
    at = lambda c: F.col(f"{pre}{c}")
    step = df.withColumns({f"{pre}{c}": v for c, v in zip(("xx", "yy", "zz", "xy", "yz", "zx"), six, strict=True)})
    own = [at(c) for c in ("xx", "yy", "zz", "xy", "yz", "zx")]
    xx, yy, zz, xy, yz, zx = own
    step = step.withColumns({f"{pre}q": mean_stress(xx, yy, zz), f"{pre}j2": second_invariant(*own), f"{pre}shear": (xy != 0) | (yz != 0) | (zx != 0)})
    a, b, c = xx - at("q"), yy - at("q"), zz - at("q")
    step = step.withColumn(f"{pre}j3", a * b * c + 2.0 * xy * yz * zx - a * yz * yz - b * zx * zx - c * xy * xy)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1.5 * math.sqrt(3.0) * at("j3") / (at("j2") * F.sqrt(at("j2")))))
    step = step.withColumns({f"{pre}angle": F.acos(cosine) / 3.0, f"{pre}size": 2.0 * F.sqrt(at("j2") / 3.0)})
    first = F.when(at("shear"), at("q") + at("size") * F.cos(at("angle"))).otherwise(F.greatest(xx, yy, zz))
    last = F.when(at("shear"), at("q") + at("size") * F.cos(at("angle") + 2.0 * math.pi / 3.0)).otherwise(F.least(xx, yy, zz))
    step = step.withColumns({f"{pre}first": first, f"{pre}last": last})
    return step.select(*df.columns, at("first").alias(names[0]), (3.0 * at("q") - at("first") - at("last")).alias(names[1]), at("last").alias(names[2]))


def half_range(first: str, last: str) -> Column:
    """Largest shear from columns of principal values."""
    return (F.col(first) - F.col(last)) / 2.0


def triaxiality(xx: Column, yy: Column, zz: Column, xy: Column, yz: Column, zx: Column) -> Column:
    """Mean over equivalent stress; 0 where that is 0."""
    vm = von_mises(xx, yy, zz, xy, yz, zx)
    return F.when(vm == 0, 0.0).otherwise(mean_stress(xx, yy, zz) / vm)


def six(vars_: Column, offset: int | Column = 0) -> tuple[Column, ...]:
    """The six components that start at ``offset`` (from 0) of an array."""
    return tuple(F.get(vars_, F.lit(offset) + k) if isinstance(offset, int) else F.get(vars_, offset + k) for k in range(6))


def stress_von_mises(vars_: Column) -> Column:
    """Of an element record that leads with six stresses; 0 for a shorter one."""
    return F.when(F.size(vars_) >= 6, von_mises(*six(vars_))).otherwise(0.0)


def effective_plastic_strain(vars_: Column) -> Column:
    """The word after the six stresses, else 0."""
    return F.coalesce(F.get(vars_, F.lit(6)), F.lit(0.0))


def beam_resultants(vars_: Column) -> Column:
    """struct of a beam record's six cross-section resultants; null for a shorter record."""
    at = lambda k: F.get(vars_, F.lit(k))
    return F.when(F.size(vars_) >= 6, F.struct(
        at(0).alias("axial_force"), F.array(at(1), at(2)).alias("shear_force"),
        F.array(at(3), at(4)).alias("bending_moment"), at(5).alias("torsion_moment"),
    ))


def beam_axial_force(vars_: Column) -> Column:
    return F.coalesce(F.get(vars_, F.lit(0)), F.lit(0.0))
