"""Comoving distances of a Lambda-CDM cosmology, both ways, and the Hubble rate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Knots of the distance table and the speed of light over 100, in km/s.
KNOTS, Z_MAX, LIGHT = 1000, 4.0, 2997.92458


class Cosmology:
    """Distances in Mpc/h by linear interpolation in a table of ``KNOTS`` redshifts from 0 to ``Z_MAX``.

    Beyond the table both directions clamp to its ends.
    """

    def __init__(self, omega_m: float = 0.31, flat: bool = True, omega_l: float = 0.69, h: float = 0.676):
        self.omega_m, self.h = omega_m, h
        self.omega_l = 1.0 - omega_m if flat else omega_l
        self.omega_k = 1.0 - self.omega_m - self.omega_l
        self.z = np.linspace(0.0, Z_MAX, KNOTS)
        nodes, weights = np.polynomial.legendre.leggauss(8)
        step = Z_MAX / (KNOTS - 1)
        at = self.z[:-1, None] + step * (nodes + 1) / 2
        self.r = np.concatenate([[0.0], np.cumsum((LIGHT / self._e(at) * weights).sum(1) * step / 2)])

    def _e(self, z):
        return np.sqrt(self.omega_m * (1 + z) ** 3 + self.omega_k * (1 + z) ** 2 + self.omega_l)

    def e(self, z: Column) -> Column:
        u = 1 + z
        return F.sqrt(self.omega_m * F.pow(u, 3) + self.omega_k * F.pow(u, 2) + self.omega_l)

    def hubble(self, z: Column) -> Column:
        return self.h * 100 * self.e(z)

    def distance(self, z: Column) -> Column:
        """The uniform table is an array literal: its size is fixed, the lookup needs no join."""
        step = Z_MAX / (KNOTS - 1)
        table = F.array(*(F.lit(float(v)) for v in self.r))
        clamped = F.greatest(F.lit(0.0), F.least(F.lit(Z_MAX), z))
        i = F.least(F.floor(clamped / step), F.lit(KNOTS - 2)).cast("int")
        low = F.element_at(table, i + 1)
        return F.when(z.isNotNull(), low + (F.element_at(table, i + 2) - low) * (clamped - i * step) / step)

    def redshift(self, r: Column) -> Column:
        """Inverse lookup: a binary search on the uneven knots, an array literal of fixed size, in the JVM."""
        knots, z = F.array(*(F.lit(float(v)) for v in self.r)), F.array(*(F.lit(float(v)) for v in self.z))
        clamped = F.greatest(F.lit(0.0), F.least(F.lit(float(self.r[-1])), r))
        halves = F.array(*(F.lit(1 << k) for k in range((KNOTS - 1).bit_length() - 1, -1, -1)))

        def closer(at: Column, step: Column) -> Column:
            return F.when((at + step <= KNOTS - 1) & (F.element_at(knots, F.least(at + step, F.lit(KNOTS - 1))) <= clamped), at + step).otherwise(at)

        i = F.aggregate(halves, F.lit(0), closer)  # how many knots lie at or below, but for the last
        i = F.greatest(i, F.lit(1))
        low, high, z_low = F.element_at(knots, i), F.element_at(knots, i + 1), F.element_at(z, i)
        return F.when(r.isNotNull(), z_low + (F.element_at(z, i + 1) - z_low) * (clamped - low) / (high - low))
