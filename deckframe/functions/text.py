"""Text of decks: numbers, names and ids, as plain functions for readers and as Columns for frames."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_INT = re.compile(r"[+-]?[0-9]+\Z")
_FLOAT = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\Z")
#: A mantissa with its exponent's letter left out, as in 1.234-5.
_BARE = re.compile(r"([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))([+-][0-9]+)\Z")
_WORDS = re.compile(r"[+-]?(?:inf|infinity|nan)\Z", re.I)


def parse_int(text: str) -> int | None:
    """A whole number with an optional sign; 7.0 is none."""
    text = text.strip(" \t\r\n")
    if not _INT.match(text):
        return None
    value = int(text)
    return value if -(2**63) <= value < 2**63 else None


def parse_plain(text: str) -> float | None:
    """A float as navigation reads it: without D exponents or bare ones."""
    text = text.strip(" \t\r\n")
    return float(text) if _FLOAT.match(text) or _WORDS.match(text) else None


def parse_float(text: str) -> float | None:
    """A float, also with D for E, or with the exponent's letter left out."""
    plain = parse_plain(text)
    if plain is not None:
        return plain
    text = re.sub("[dD]", "E", text.strip(" \t\r\n"), count=1)
    if _FLOAT.match(text):
        return float(text)
    if m := _BARE.match(text):
        return float(f"{m[1]}E{m[2]}")
    return None


def parse_id(text: str) -> int | None:
    """An id, which may be written as a float; cut towards zero."""
    whole = parse_int(text)
    if whole is not None:
        return whole
    value = parse_plain(text)
    return int(value) if value is not None and abs(value) < 2.0**63 else None


def canonical_base(name: str) -> str:
    """Upper case, without one _TITLE and then one _ID at the end."""
    return name.upper().removesuffix("_TITLE").removesuffix("_ID")


def has_title(name: str) -> bool:
    """Whether a title line comes before the first card."""
    return name.upper().endswith("_TITLE")


# The same for frames ------------------------------------------------------------------------


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def int_of(text: Column) -> Column:
    """bigint, null where the text is no whole number."""
    t = trimmed(text)
    return F.when(F.rlike(t, F.lit(r"^[+-]?[0-9]+$")), t.try_cast("bigint"))


_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)"


def plain_of(text: Column) -> Column:
    """double, without D exponents or bare ones; null where the text is no number.

    The guard is needed: Spark's own cast takes a trailing d or f for a type suffix.
    """
    t = trimmed(text)
    return F.when(F.rlike(t, F.lit(rf"^{_NUMBER}(?:[eE][+-]?[0-9]+)?$")), t.try_cast("double"))


def float_of(text: Column) -> Column:
    """double, with D exponents and bare exponents; null where the text is no number."""
    t = F.regexp_replace(trimmed(text), "[dD]", "E")
    bare = F.rlike(t, F.lit(rf"^{_NUMBER}[+-][0-9]+$"))
    return F.coalesce(plain_of(t), F.when(bare, F.regexp_replace(t, rf"^({_NUMBER})([+-][0-9]+)$", "$1E$2").try_cast("double")))


def id_of(text: Column) -> Column:
    """bigint, also from a float, cut towards zero."""
    return F.coalesce(int_of(text), plain_of(text).try_cast("bigint"))


def base_of(name: Column) -> Column:
    """``canonical_base`` of a name."""
    return F.regexp_replace(F.regexp_replace(F.upper(name), "_TITLE$", ""), "_ID$", "")
