"""Periodic meshes in long form ``(vox, value)``: deposit, gather, contrast, smoothing and spectra."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeflow.functions.scalars import EDGE_DENSITY

OFFSETS = [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]


def corner_weights(points: DataFrame, n: int, length: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), wrap: bool = True) -> DataFrame:
    """Each point's eight cells ``vox`` with trilinear ``share``.

    Generated row by row from a fixed array of offsets, so no join is needed.  Without
    ``wrap`` the share beyond the last cell is dropped.
    """
    width = length / n
    out = points
    for axis, low in zip("xyz", origin):
        u = (F.col(axis) - low) / width
        out = out.withColumn(f"__i{axis}", F.floor(u)).withColumn(f"__d{axis}", u - F.floor(u))
    cells = []
    for offset in OFFSETS:
        index, share, inside = [], None, F.lit(True)
        for axis, o in zip("xyz", offset):
            i = F.col(f"__i{axis}") + o
            index.append(F.pmod(i, F.lit(n)).cast("long"))
            part = F.col(f"__d{axis}") if o else 1 - F.col(f"__d{axis}")
            share = part if share is None else share * part
            inside = inside & (i < n)
        cells.append(F.struct((index[0] * n * n + index[1] * n + index[2]).alias("vox"), (share if wrap else F.when(inside, share).otherwise(F.lit(0.0))).alias("share")))
    keep = [c for c in points.columns if c not in ("vox", "share")]
    return out.withColumn("__c", F.explode(F.array(*cells))).select(*keep, "__c.vox", "__c.share")


def deposit(points: DataFrame, n: int, length: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), weight: str | None = "w", wrap: bool = True) -> DataFrame:
    """``(vox, rho)``: weights dealt to cells by cloud-in-cell; partial sums form before the shuffle."""
    shares = corner_weights(points, n, length, origin, wrap)
    value = F.col("share") * F.col(weight) if weight else F.col("share")
    return shares.groupBy("vox").agg(F.sum(value).alias("rho"))


def all_voxels(spark, n: int) -> DataFrame:
    return spark.range(n**3).withColumnRenamed("id", "vox")


def dense(grid: DataFrame, n: int, value: str = "rho") -> DataFrame:
    """``grid`` with a zero in every cell that had no row."""
    return all_voxels(grid.sparkSession, n).join(grid, "vox", "left").select("vox", F.coalesce(value, F.lit(0.0)).alias(value))


def gather(points: DataFrame, fields: DataFrame, values: list[str], n: int, length: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), id_col: str = "id") -> DataFrame:
    """Fields interpolated to the points: ``(id, *values)``."""
    shares = corner_weights(points.select(id_col, "x", "y", "z"), n, length, origin)
    return shares.join(fields, "vox").groupBy(id_col).agg(*(F.sum(F.col("share") * F.col(v)).alias(v) for v in values))


def contrast_box(rho: Column, n: int, total: Column | float) -> Column:
    return rho * n**3 / total - 1


def density_box(rho: Column, n: int, total: Column | float) -> Column:
    return rho * n**3 / total


def contrast_survey(rho_g: Column, rho_r: Column, alpha: Column | float, ran_min: Column | float) -> Column:
    return F.when(rho_r > ran_min, rho_g / (alpha * rho_r) - 1).otherwise(F.lit(0.0))


def density_survey(rho_g: Column, rho_r: Column, alpha: Column | float, ran_min: Column | float) -> Column:
    return F.when(rho_r > ran_min, rho_g / (alpha * rho_r)).otherwise(F.lit(EDGE_DENSITY))


def filled_cells(grid: DataFrame, value: str = "rho") -> DataFrame:
    return grid.agg(F.count_if(F.col(value) > 0).alias("filled"))


def gaussian_kernel(sigma: float) -> list[tuple[int, float]]:
    """Offsets and normalised weights up to four sigma."""
    reach = int(4.0 * sigma + 0.5)
    raw = [(d, math.exp(-0.5 * d * d / (sigma * sigma))) for d in range(-reach, reach + 1)]
    total = sum(w for _, w in raw)
    return [(d, w / total) for d, w in raw]


def smoothed(grid: DataFrame, n: int, sigma: float, value: str = "rho", periodic: bool = True) -> DataFrame:
    """Separable Gaussian smoothing of a dense grid; outside values wrap or repeat the border.

    A pencil (a line of cells along one axis) is a group of ``n`` cells, convolved at once:
    one shuffle an axis whatever the kernel's width.
    """
    kernel = gaussian_kernel(sigma)
    reach = kernel[-1][0]
    taps = np.array([w for _, w in kernel])

    def along(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vox")
        v = np.pad(pdf[value].to_numpy(), reach, mode="wrap" if periodic else "edge")
        pdf[value] = np.convolve(v, taps, mode="valid")
        return pdf[["vox", value]]

    out = grid.select("vox", value)
    for stride in (n * n, n, 1):
        line = F.col("vox") - F.pmod(F.floor(F.col("vox") / stride), F.lit(n)) * stride
        out = out.groupBy(line.alias("__line")).applyInPandas(lambda pdf: along(pdf), f"vox long, {value} double")
    return out


def transformed(grid: DataFrame, n: int, inverse: bool = False) -> DataFrame:
    """Discrete Fourier transform of ``(vox, re, im)``, by pencils along each axis; the inverse is over n**3."""
    turn = np.fft.ifft if inverse else np.fft.fft

    def along(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vox")
        f = turn(pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy())
        return pd.DataFrame({"vox": pdf["vox"].to_numpy(), "re": f.real, "im": f.imag})

    out = grid.select("vox", "re", "im")
    for stride in (n * n, n, 1):
        line = F.col("vox") - F.pmod(F.floor(F.col("vox") / stride), F.lit(n)) * stride
        out = out.groupBy(line.alias("__line")).applyInPandas(along, "vox long, re double, im double")
    return out


def wavenumbers(vox: Column, n: int, length: float) -> tuple[Column, Column, Column]:
    """Angular wave numbers along the axes of a flat id."""

    def k(i: Column) -> Column:
        return F.when(i < (n + 1) // 2, i).otherwise(i - n) * (2 * math.pi / length)

    return k(F.floor(vox / (n * n))), k(F.floor(vox / n) % n), k(vox % n)


def spectral_smoothing(vox: Column, n: int, length: float, radius: float) -> Column:
    kx, ky, kz = wavenumbers(vox, n, length)
    return F.exp(-0.5 * (kx * kx + ky * ky + kz * kz) * radius * radius)


def displacement_spectrum(spectrum: DataFrame, n: int, length: float, bias: float) -> DataFrame:
    """``(vox, re_x, im_x, ...)``: the field over k squared (none at k = 0), times -i k over bias, by axis."""
    kx, ky, kz = wavenumbers(F.col("vox"), n, length)
    k2 = kx * kx + ky * ky + kz * kz
    out = spectrum.withColumn("__s", F.when(k2 == 0, F.lit(0.0)).otherwise(1 / k2))
    cols = []
    for axis, k in zip("xyz", (kx, ky, kz)):
        cols += [(F.col("im") * F.col("__s") * k / bias).alias(f"re_{axis}"), (-F.col("re") * F.col("__s") * k / bias).alias(f"im_{axis}")]
    return out.select("vox", *cols)


def displacement(delta: DataFrame, n: int, length: float, bias: float, value: str = "delta") -> DataFrame:
    """``(vox, psi_x, psi_y, psi_z)`` of a dense contrast."""
    spectrum = displacement_spectrum(transformed(delta.select("vox", F.col(value).alias("re"), F.lit(0.0).alias("im")), n), n, length, bias)
    parts = [transformed(spectrum.select("vox", F.col(f"re_{a}").alias("re"), F.col(f"im_{a}").alias("im")), n, inverse=True).select("vox", F.col("re").alias(f"psi_{a}")) for a in "xyz"]
    return parts[0].join(parts[1], "vox").join(parts[2], "vox")
