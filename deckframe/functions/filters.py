"""Zero-phase recursive filters.

A recursive filter is a sequential recurrence, which no window expresses, so these run as grouped
maps over Arrow: one series is one group. The recurrence runs over time, vectorised over channels.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def cfc_coefficients(cfc: float, dt: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of the two-pole low-pass of SAE J211 class ``cfc``.

    The bilinear transform of a Butterworth section whose corner is 2.0775 times the class, which
    holds both the class's corner and the loss of running it twice.
    """
    return _section(math.tan(math.pi * cfc * 2.0775 * dt))


def _section(k: float) -> tuple[np.ndarray, np.ndarray]:
    """A second-order low-pass for the prewarped corner ``k``."""
    scale = 1.0 / (k * k + math.sqrt(2.0) * k + 1.0)
    b = k * k * scale * np.array([1.0, 2.0, 1.0])
    a = np.array([1.0, 2.0 * (k * k - 1.0) * scale, (k * k - math.sqrt(2.0) * k + 1.0) * scale])
    return b, a


def butterworth_coefficients(order: int, cutoff: float, fs: float, band: str = "low") -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a digital Butterworth filter, ``band`` low or high."""
    if order < 1 or band not in ("low", "high"):
        raise ValueError("order must be 1 or more, band low or high")
    if not 0 < cutoff < fs / 2:
        raise ValueError(f"cutoff {cutoff} must lie between 0 and half the sample rate {fs}")
    corner = 2.0 * fs * math.tan(math.pi * cutoff / fs)
    poles = np.exp(1j * math.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    poles = corner * poles if band == "low" else corner / poles
    digital = (2 * fs + poles) / (2 * fs - poles)
    zeros = np.full(order, -1.0 if band == "low" else 1.0)
    a = np.real(np.poly(digital))
    b = np.poly(zeros)
    at = 1.0 if band == "low" else -1.0  # where the gain is one
    return b * (np.polyval(a, at) / np.polyval(b, at)), a


def _settled(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The filter's state in which a constant input of one gives its final value at once."""
    m = len(a) - 1
    step = np.zeros((m, m))
    step[:, 0] = -a[1:]
    step[:-1, 1:] = np.eye(m - 1)
    return np.linalg.solve(np.eye(m) - step, b[1:] - a[1:] * b[0])


def _run(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Filter along axis 0; state: taps - 1 by channels."""
    y, z = np.empty_like(x), np.vstack([state, np.zeros((1, x.shape[1]))])
    bs, as_ = b[1:, None], a[1:, None]
    for i in range(len(x)):
        y[i] = b[0] * x[i] + z[0]
        z[:-1] = z[1:] + bs * x[i] - as_ * y[i]
    return y


def filtfilt(b: Sequence[float], a: Sequence[float], x: np.ndarray) -> np.ndarray:
    """Forward and backward along axis 0, with the signal reflected oddly about both ends."""
    x = np.asarray(x, float)
    taps = max(len(b), len(a))
    if len(x) <= 1 or taps < 2:
        return x.copy()
    nb, na = np.zeros(taps), np.zeros(taps)
    nb[: len(b)], na[: len(a)] = np.asarray(b, float) / a[0], np.asarray(a, float) / a[0]
    y = x.reshape(len(x), -1)
    pad = min(3 * taps, len(y) - 1)
    y = np.concatenate([2 * y[0] - y[pad:0:-1], y, 2 * y[-1] - y[-2 : -pad - 2 : -1]])
    rest = _settled(nb, na)[:, None]
    for _ in range(2):
        y = _run(nb, na, y, rest * y[0])[::-1]
    return y[pad : len(y) - pad].reshape(x.shape)


def filtered(df: DataFrame, channels: Sequence[str], keys: Sequence[str], b: Sequence[float], a: Sequence[float], order: str = "i") -> DataFrame:
    """``df`` with the channels filtered, series by series. A series must fit in one task."""
    schema = T.StructType([T.StructField(f.name, T.DoubleType() if f.name in channels else f.dataType) for f in df.schema.fields])
    b, a = list(map(float, b)), list(map(float, a))
    names = list(channels)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        y = filtfilt(b, a, np.column_stack([table[c].to_numpy() for c in names]))
        for k, c in enumerate(names):
            table = table.set_column(table.schema.get_field_index(c), c, pa.array(np.ascontiguousarray(y[:, k])))
        return table

    return df.groupBy(*keys).applyInArrow(run, schema)


def cfc(df: DataFrame, channels: Sequence[str], keys: Sequence[str], cfc_class: float, dt: float, order: str = "i") -> DataFrame:
    """SAE J211 channel-frequency-class filter, zero phase."""
    return filtered(df, channels, keys, *cfc_coefficients(cfc_class, dt), order)


def butterworth(df: DataFrame, channels: Sequence[str], keys: Sequence[str], order_: int, cutoff: float, fs: float, band: str = "low", order: str = "i") -> DataFrame:
    return filtered(df, channels, keys, *butterworth_coefficients(order_, cutoff, fs, band), order)
