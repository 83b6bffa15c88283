"""A smooth radial selection function from a few bins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Samples of the smoothed curve, and the width and degree of its local polynomials.
SAMPLES, WINDOW, DEGREE = 1000, 101, 3


def linear(x: np.ndarray, knots: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Linear interpolation that goes on straight beyond the ends."""
    i = np.clip(np.searchsorted(knots, x, "right") - 1, 0, len(knots) - 2)
    slope = (values[i + 1] - values[i]) / (knots[i + 1] - knots[i])
    return values[i] + slope * (x - knots[i])


def local_polynomials(y: np.ndarray, window: int = WINDOW, degree: int = DEGREE) -> np.ndarray:
    """Each value by a least-squares polynomial of the window around it; the ends by those of the end windows."""
    half = window // 2
    at = np.arange(-half, half + 1)
    basis = np.vander(at, degree + 1, increasing=True).astype(float)
    fit = np.linalg.pinv(basis)
    out = np.convolve(y, fit[0][::-1], mode="valid")
    head, tail = basis @ (fit @ y[:window]), basis @ (fit @ y[-window:])
    return np.concatenate([head[:half], out, tail[-half:]])


class Selection:
    """Bins of ``(z, f)`` interpolated, smoothed over ``[low, high]`` and interpolated again."""

    def __init__(self, z: list[float], f: list[float], low: float, high: float):
        self.low, self.high = low, high
        x = np.linspace(low, high, SAMPLES)
        self.curve = local_polynomials(linear(x, np.array(z), np.array(f)))

    def __call__(self, z: Column) -> Column:
        """The curve is an array literal of fixed length, on even knots: no join."""
        step = (self.high - self.low) / (SAMPLES - 1)
        table = F.array(*(F.lit(float(v)) for v in self.curve))
        i = F.greatest(F.lit(0), F.least(F.floor((z - self.low) / step), F.lit(SAMPLES - 2))).cast("int")
        start = F.element_at(table, i + 1)
        return F.when(z.isNotNull(), start + (F.element_at(table, i + 2) - start) * (z - self.low - i * step) / step)
