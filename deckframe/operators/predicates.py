"""Predicates on fields, compiled to Columns in two-valued logic.

A comparison is numeric if both sides are numbers; else equality compares the text and ordering is
false. A missing field makes its comparison false, so ``not_`` of it is true.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = {"==": "eq", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}


def number_text(value: object) -> str:
    """A number as messages show it: whole numbers without a point, no exponent."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, int):
        return str(value)
    if value != value or value in (float("inf"), float("-inf")):
        return {True: "NaN"}.get(value != value, "inf" if value > 0 else "-inf")
    if value == int(value):
        return str(int(value))
    return f"{value:.17f}".rstrip("0") if "e" in repr(value) else repr(value)


@dataclass(frozen=True)
class Predicate:
    """A leaf (field, op, value), or a combination of others."""

    kind: str
    field: str = ""
    op: str = ""
    value: object = None
    parts: tuple[Predicate, ...] = ()

    @staticmethod
    def of(field: str, op: str, value: object) -> Predicate:
        if op not in OPERATORS:
            raise ValueError(f"unknown comparison {op!r}")
        return Predicate("field", field, op, value)

    def __and__(self, other: Predicate) -> Predicate:
        return all_(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return any_(self, other)

    def __invert__(self) -> Predicate:
        return not_(self)

    def column(self, number: Callable[[str], Column], text: Callable[[str], Column]) -> Column:
        """``number`` and ``text`` give a field as double (null if it is none) and as trimmed string (null if missing)."""
        if self.kind == "field":
            return F.coalesce(_compare(number(self.field), text(self.field), self.op, self.value), F.lit(False))
        cells = [p.column(number, text) for p in self.parts]
        if self.kind == "not":
            return ~cells[0]
        out = F.lit(self.kind == "all")
        for c in cells:
            out = (out & c) if self.kind == "all" else (out | c)
        return out

    def describe(self) -> str:
        if self.kind == "field":
            return f"{self.field} {self.op} {number_text(self.value)}"
        return f"{self.kind}({', '.join(p.describe() for p in self.parts)})"

    def fields(self) -> list[str]:
        return [self.field] if self.kind == "field" else [f for p in self.parts for f in p.fields()]


def all_(*parts: Predicate) -> Predicate:
    return Predicate("all", parts=parts)


def any_(*parts: Predicate) -> Predicate:
    return Predicate("any", parts=parts)


def not_(part: Predicate) -> Predicate:
    return Predicate("not", parts=(part,))


def field(name: str, op: str, value: object) -> Predicate:
    return Predicate.of(name, op, value)


def _compare(number: Column, text: Column, op: str, value: object) -> Column:
    compare = {"==": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}[op]
    as_text = getattr(text, compare)(F.lit(number_text(value))) if op in ("==", "!=") else F.when(text.isNotNull(), F.lit(False))
    try:
        limit = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return as_text
    return F.when(number.isNotNull(), getattr(number, compare)(F.lit(limit))).otherwise(as_text)


def over_columns(predicate: Predicate, frame_types: dict[str, str]) -> Column:
    """The predicate over a frame's own columns (name -> type); a column that is missing is a missing field."""
    def text(name: str) -> Column:
        return F.trim(F.col(name).cast("string")) if name in frame_types else F.lit(None).cast("string")

    def number(name: str) -> Column:
        return F.col(name).try_cast("double") if name in frame_types else F.lit(None).cast("double")

    return predicate.column(number, text)
