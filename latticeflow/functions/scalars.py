"""Coordinates, weights and derived quantities of catalogues, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The density that marks an edge or masked cell, and powers of the size in the structure parameter.
EDGE_DENSITY = 0.9e30
VOID_POWER, CLUSTER_POWER = 1.2, 1.6


def cartesian(ra: Column, dec: Column, r: Column) -> tuple[Column, Column, Column]:
    """Degrees and a distance to x, y, z."""
    a, d = F.radians(ra), F.radians(dec)
    return r * F.cos(d) * F.cos(a), r * F.cos(d) * F.sin(a), r * F.sin(d)


def sky(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """x, y, z to right ascension in [0, 360), declination and distance; degrees."""
    r = F.sqrt(x * x + y * y + z * z)
    ra = F.degrees(F.atan2(y, x))
    return F.when(ra < 0, ra + 360).otherwise(ra), 90 - F.degrees(F.acos(z / r)), r


def systematic_weight(model: int) -> Column:
    """Redshift-failure, close-pair and systematic weights as one factor, by weights model."""
    if model == 1:
        return F.col("weight_systot") * (F.col("weight_noz") + F.col("weight_cp") - 1)
    if model == 2:
        return F.col("weight_systot") * F.col("weight_cp") * F.col("weight_noz")
    if model == 3:
        return F.col("weight_all_nofkp")
    raise ValueError(f"no weights model {model}")


def tracer_weight(model: int, fkp: bool = True, systematics: bool = True) -> Column:
    out = F.lit(1.0)
    if fkp:
        out = out * F.col("weight_fkp")
    return out * systematic_weight(model) if systematics else out


def wrapped(x: Column, length: float, closed: bool = False) -> Column:
    """One correction by ``length`` into the box; ``closed`` also moves ``x = length`` to 0."""
    beyond = x >= length if closed else x > length
    return F.when(beyond, x - length).when(x < 0, x + length).otherwise(x)


def periodic(x: Column, length: float) -> Column:
    return F.pmod(x, F.lit(length))


def box_shifted(x: Column, length: float, middle: float, back: bool = False) -> Column:
    """A coordinate of a box of ``length`` moved so that its middle lies at ``middle``, or back again."""
    by = F.lit(middle - length / 2)
    return x - by if back else x + by


def voxel_corner(vox: Column, n: int, length: float) -> tuple[Column, Column, Column]:
    """Lower corner of a flat row-major voxel id."""
    width = length / n
    return F.floor(vox / (n * n)) * width, F.floor((vox % (n * n)) / n) * width, (vox % n) * width


def effective_radius(volume: Column) -> Column:
    return F.pow(3 * volume / (4 * math.pi), F.lit(1.0 / 3.0))


def structure_parameter(mean_contrast: Column, radius: Column, clusters: bool = False) -> Column:
    return mean_contrast * F.pow(radius, F.lit(CLUSTER_POWER if clusters else VOID_POWER))


def effective_angle(radius: Column, distance: Column) -> Column:
    return F.degrees(radius / distance)


def significance(contrast: Column, clusters: bool = False) -> Column:
    """Chance that a structure of this density contrast is a Poisson fluctuation."""
    c = contrast - 1
    if clusters:
        return 1.077 / (F.pow(c, F.lit(1.82)) + 0.077 * F.pow(contrast, F.lit(4.41)))
    return F.exp(-5.12 * c - 0.8 * F.pow(c, F.lit(2.8)))


def halo_order(particles: Column, prob: Column, most: Column) -> Column:
    """Sort key of halos: joined particles, then probability."""
    return particles + F.log(((math.e - 1) * prob + most) / most)


def inverted(density: Column) -> Column:
    """One over the density; the edge density, which takes no part in a watershed, for an empty cell."""
    return F.when(density == 0, F.lit(EDGE_DENSITY)).otherwise(1 / density)


def mesh_sizing(mean_density: float, length: float) -> tuple[int, float]:
    """Cells per side (half the mean separation radius each) and the smoothing length."""
    return int(math.floor(length / (0.5 * (4 * math.pi * mean_density / 3) ** (-1.0 / 3)))), mean_density ** (-1.0 / 3)
