"""Through-thickness layers of shell records, as expressions over their array of words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from deckframe.functions.tensor import six, von_mises

TOP, BOTTOM, MID, MAX = "top", "bottom", "mid", "max"


@dataclass(frozen=True)
class ShellLayout:
    """Where layers and resultants lie in a shell record."""

    n_layers: int
    stride: int
    has_stress: bool = True
    has_pstrain: bool = True
    has_forces: bool = False
    has_extra: bool = False

    def layer(self, select: str | int) -> int | None:
        """The layer number, or None for all layers (``max``) and for records without layers."""
        if self.n_layers == 0 or select == MAX:
            return None
        if isinstance(select, int):
            return min(select, self.n_layers - 1)
        return {BOTTOM: 0, TOP: self.n_layers - 1, MID: self.n_layers // 2}[select]

    def stress(self, vars_: Column, layer: int) -> Column:
        """array of six stresses at a layer; null where there are none."""
        if not self.has_stress or layer >= self.n_layers:
            return F.lit(None).cast("array<double>")
        at = layer * self.stride
        return F.when(F.size(vars_) >= at + 6, F.slice(vars_, at + 1, 6))

    def plastic_strain(self, vars_: Column, layer: int) -> Column:
        if not self.has_pstrain or layer >= self.n_layers:
            return F.lit(None).cast("double")
        return F.get(vars_, F.lit(layer * self.stride + 6 * self.has_stress))

    def resultants(self, vars_: Column) -> Column:
        """struct of moments, shears, normal forces and thickness behind the layers; null where absent."""
        at = self.n_layers * self.stride
        if not self.has_forces:
            return F.lit(None).cast("struct<bending_moment:array<double>,shear_force:array<double>,normal_force:array<double>,thickness:double>")
        thickness = F.get(vars_, F.lit(at + 8)) if self.has_extra else F.lit(None).cast("double")
        return F.when(F.size(vars_) >= at + 8, F.struct(
            F.slice(vars_, at + 1, 3).alias("bending_moment"), F.slice(vars_, at + 4, 2).alias("shear_force"),
            F.slice(vars_, at + 6, 3).alias("normal_force"), thickness.alias("thickness"),
        ))


def _over_layers(layout: ShellLayout, vars_: Column, width: int, at: int, value) -> Column:  # noqa: ANN001
    """The largest ``value`` of all layers that the record holds in full, 0 at least."""
    if layout.n_layers == 0:
        return F.lit(0.0)
    starts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(layout.n_layers - 1)), lambda k: k * layout.stride + at), lambda s: s + width <= F.size(vars_))
    return F.aggregate(starts, F.lit(0.0), lambda best, s: F.greatest(best, value(s)))


def shell_von_mises(vars_: Column, layout: ShellLayout, select: str | int = MAX) -> Column:
    """Equivalent stress at a layer, or of the worst layer; 0 where there is none."""
    layer = layout.layer(select)
    if layer is None:
        return _over_layers(layout, vars_, 6, 0, lambda s: von_mises(*six(vars_, s))) if layout.has_stress else F.lit(0.0)
    return F.coalesce(von_mises(*six(layout.stress(vars_, layer))), F.lit(0.0))


def shell_plastic_strain(vars_: Column, layout: ShellLayout, select: str | int = MAX) -> Column:
    layer = layout.layer(select)
    if layer is None:
        return _over_layers(layout, vars_, 1, 6 * layout.has_stress, lambda s: F.get(vars_, s)) if layout.has_pstrain else F.lit(0.0)
    return F.coalesce(layout.plastic_strain(vars_, layer), F.lit(0.0))
