"""Mock particles that close a survey's tessellation: radial caps, edges and guards."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeflow.functions import healpix as H
from latticeflow.functions.scalars import cartesian
from latticeflow.operators.hulls import uniform
from latticeflow.operators.spatial import far_from


@dataclass(frozen=True)
class Layer:
    """A shell of buffer particles: its radii and how many it holds."""

    low: float
    high: float
    count: int


def shell_volume(low: float, high: float, f_sky: float) -> float:
    return f_sky * 4 * math.pi * (high**3 - low**3) / 3


def high_cap(r_high: float, tracer_density: float, ratio: float, f_sky: float) -> Layer:
    """From half a mean separation beyond the farthest tracer, one and a half thick."""
    gap = tracer_density ** (-1.0 / 3)
    low = r_high + 0.5 * gap
    high = low + 1.5 * gap
    return Layer(low, high, math.ceil(ratio * tracer_density * shell_volume(low, high, f_sky)))


def low_cap(r_low: float, tracer_density: float, ratio: float, f_sky: float) -> Layer:
    """The mirror image in front of the nearest tracer, cut off at the observer."""
    gap = tracer_density ** (-1.0 / 3)
    high = r_low - 0.5 * gap
    low = high - 1.5 * gap
    high = r_low if high < 0 else high
    low = max(low, 0.0)
    return Layer(low, high, math.ceil(ratio * tracer_density * shell_volume(low, high, f_sky)))


def edge_layer(near: float, far: float, tracer_density: float, ratio: float, f_boundary: float) -> Layer:
    return Layer(near, far, math.ceil(ratio * tracer_density * shell_volume(near, far, f_boundary)))


def refined(pixels: DataFrame, nside: int, count: int) -> tuple[DataFrame, int]:
    """The filled pixels at a resolution fine enough to give each particle a pixel of its own."""
    filled = pixels.select("pix", F.lit(1.0).alias("val"))
    n = filled.count()
    fine = nside
    while 0 < n < count:
        fine, n = fine * 2, n * 4
    return (H.regraded(filled, nside, fine) if fine != nside else filled).select("pix"), fine


def scattered(pixels: DataFrame, nside: int, layer: Layer, seed: int) -> DataFrame:
    """``(pix, ra, dec, r, x, y, z)``: particles at centres of distinct pixels, uniform in volume.

    Pixels are drawn by the order of their hashes, so the draw is reproducible and needs no
    shuffling on one machine; the limit is the layer's size itself.
    """
    fine, side = refined(pixels, nside, layer.count)
    drawn = fine.orderBy(F.xxhash64("pix", F.lit(seed)), "pix").limit(layer.count)
    ra, dec = H.centre_of(F.col("pix"), side)
    r = F.pow(layer.low**3 + (layer.high**3 - layer.low**3) * uniform(F.col("pix"), seed + 1), F.lit(1.0 / 3))
    placed = drawn.select("pix", ra.alias("ra"), dec.alias("dec"), r.alias("r"))
    x, y, z = cartesian(F.col("ra"), F.col("dec"), F.col("r"))
    return placed.select("pix", "ra", "dec", "r", x.alias("x"), y.alias("y"), z.alias("z"))


def guards(spark, per_side: int, length: float) -> DataFrame:
    """A lattice of guard points just inside the box."""
    step = (length - 0.2) / (per_side - 1)
    n = spark.range(per_side**3)
    place = [F.floor(F.col("id") / per_side**2), F.floor(F.col("id") / per_side) % per_side, F.col("id") % per_side]
    return n.select("id", *((0.1 + p * step).alias(a) for p, a in zip(place, "xyz")))


def outer_guards(spark, points: DataFrame, per_side: int, length: float) -> DataFrame:
    """Guards farther from every point than a lattice step."""
    return far_from(guards(spark, per_side, length), points, length, (length - 0.2) / per_side)


def standard(tracers: DataFrame, buffers: DataFrame, guard_points: DataFrame) -> DataFrame:
    """One table ``(kind, x, y, z, ra, dec, redshift, weight, comp)``; what has no value is null."""
    null = F.lit(None).cast("double")
    t = tracers.select(F.lit("galaxy").alias("kind"), "x", "y", "z", "ra", "dec", "redshift", "weight", "comp")
    b = buffers.select(F.lit("buffer").alias("kind"), "x", "y", "z", "ra", "dec", null.alias("redshift"), null.alias("weight"), null.alias("comp"))
    g = guard_points.select(F.lit("guard").alias("kind"), "x", "y", "z", null.alias("ra"), null.alias("dec"), null.alias("redshift"), null.alias("weight"), null.alias("comp"))
    return t.unionByName(b).unionByName(g)


def sentinels(rows: DataFrame) -> DataFrame:
    """The same as numbers, for files: redshift -1 and weights 0 for mocks, and sky position -60 for guards."""
    mock, guard = F.col("kind") != "galaxy", F.col("kind") == "guard"
    return rows.select(
        "x", "y", "z", F.when(guard, -60.0).otherwise(F.col("ra")).alias("ra"), F.when(guard, -60.0).otherwise(F.col("dec")).alias("dec"),
        F.when(mock, -1.0).otherwise(F.col("redshift")).alias("redshift"), F.when(mock, 0.0).otherwise(F.col("weight")).alias("weight"), F.when(mock, 0.0).otherwise(F.col("comp")).alias("comp"),
    )


def of_sentinels(rows: DataFrame) -> DataFrame:
    """``rows`` of a file of :func:`sentinels` with their ``kind``: a guard by its sky position, a buffer by its redshift."""
    return rows.withColumn("kind", F.when(F.col("dec") == -60.0, "guard").when(F.col("redshift") == -1.0, "buffer").otherwise("galaxy"))


def without_guards(rows: DataFrame) -> DataFrame:
    """Tracers and buffers only: what the box around a loaded file is sized by."""
    return rows.where(F.col("kind") != "guard")


def occupied(catalogue: DataFrame, nside: int) -> DataFrame:
    """``(pix)``: pixels with a tracer; their share of all pixels is the sky fraction."""
    return catalogue.select(H.pixel_of(F.col("ra"), F.col("dec"), nside).alias("pix")).distinct()


def sky_fraction(mask: DataFrame, nside: int) -> DataFrame:
    return mask.agg((F.count("*") / H.pixels(nside)).alias("f_sky"))


def unmasked(catalogue: DataFrame, mask: DataFrame, nside: int) -> DataFrame:
    """Tracers in pixels of the mask; the anti-join gives those the mask warns about."""
    return catalogue.withColumn("__pix", H.pixel_of(F.col("ra"), F.col("dec"), nside)).join(mask.select(F.col("pix").alias("__pix")), "__pix", "left_semi").drop("__pix")


def completeness(catalogue: DataFrame, skymap: DataFrame, nside: int) -> DataFrame:
    """``comp`` from a map; 0 where it has no pixel."""
    out = catalogue.drop("comp").withColumn("__pix", H.pixel_of(F.col("ra"), F.col("dec"), nside))
    return out.join(skymap.select(F.col("pix").alias("__pix"), F.col("val").alias("comp")), "__pix", "left").withColumn("comp", F.coalesce("comp", F.lit(0.0))).drop("__pix")


