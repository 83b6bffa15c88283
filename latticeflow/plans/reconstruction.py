"""Removing line-of-sight distortions with a displacement field solved on a mesh."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeflow.functions import scalars as S
from latticeflow.operators import mesh as M
from latticeflow.operators.stage import kept


@dataclass(frozen=True)
class Mesh:
    """A cube of ``n`` cells a side."""

    n: int
    length: float
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)


def survey_mesh(extents: dict[str, float], n: int, padding: float = 200.0) -> Mesh:
    """The cube around a survey: its largest extent and the padding on both sides, centred."""
    spans = [extents[f"max_{a}"] - extents[f"min_{a}"] for a in "xyz"]
    length = max(spans) + 2 * padding
    origin = tuple((extents[f"max_{a}"] + extents[f"min_{a}"]) / 2 - length / 2 for a in "xyz")
    return Mesh(n, length, origin)


def padded_survey_mesh(extents: dict[str, float], mean_density: float, padding: float = 5.0) -> Mesh:
    """A cube sized by density: the padding doubles until it spans a cell."""
    spans = [extents[f"max_{a}"] - extents[f"min_{a}"] for a in "xyz"]
    while True:
        length = max(spans) + 2 * padding
        n, _ = S.mesh_sizing(mean_density, length)
        if n == 0 or padding >= length / n:
            break
        padding *= 2
    return Mesh(max(n, 1), length, tuple(extents[f"min_{a}"] - padding for a in "xyz"))


def _spectrum_of(grid: DataFrame, n: int, value: str = "rho") -> DataFrame:
    return M.transformed(grid.select("vox", F.col(value).alias("re"), F.lit(0.0).alias("im")), n)


def smoothed_spectrum(grid: DataFrame, mesh: Mesh, radius: float, value: str = "rho") -> DataFrame:
    kernel = M.spectral_smoothing(F.col("vox"), mesh.n, mesh.length, radius)
    return _spectrum_of(grid, mesh.n, value).select("vox", (F.col("re") * kernel).alias("re"), (F.col("im") * kernel).alias("im"))


def fourier_smoothed(grid: DataFrame, mesh: Mesh, radius: float, value: str = "rho") -> DataFrame:
    return M.transformed(smoothed_spectrum(grid, mesh, radius, value), mesh.n, inverse=True).select("vox", F.col("re").alias(value))


def _psi(delta_k: DataFrame, mesh: Mesh, bias: float) -> DataFrame:
    """``(vox, psi_x, psi_y, psi_z)``: an inverse transform for each component."""
    spectrum = M.displacement_spectrum(delta_k, mesh.n, mesh.length, bias)
    parts = [M.transformed(spectrum.select("vox", F.col(f"re_{a}").alias("re"), F.col(f"im_{a}").alias("im")), mesh.n, inverse=True).select("vox", F.col("re").alias(f"psi_{a}")) for a in "xyz"]
    return kept(parts[0].join(parts[1], "vox").join(parts[2], "vox"))


def box_psi(points: DataFrame, mesh: Mesh, radius: float, bias: float, total: float) -> DataFrame:
    """Displacements of a periodic box.  Smoothing and normalisation are linear, so they stay in Fourier space."""
    grid = M.dense(M.deposit(points, mesh.n, mesh.length, mesh.origin), mesh.n)
    scale = mesh.n**3 / total
    delta_k = smoothed_spectrum(grid, mesh, radius).select("vox", (F.col("re") * scale).alias("re"), (F.col("im") * scale).alias("im"))
    return _psi(delta_k, mesh, bias)


def survey_psi(points: DataFrame, randoms_smoothed: DataFrame, mesh: Mesh, radius: float, bias: float, alpha: float, ran_min: float) -> DataFrame:
    grid = M.dense(M.deposit(points, mesh.n, mesh.length, mesh.origin), mesh.n)
    both = fourier_smoothed(grid, mesh, radius).join(randoms_smoothed.withColumnRenamed("rho", "rho_r"), "vox")
    delta = both.select("vox", M.contrast_survey(F.col("rho"), F.col("rho_r"), alpha, ran_min).alias("rho"))
    return _psi(_spectrum_of(delta, mesh.n), mesh, bias)


def _along(cols: dict[str, Column], amount: Column) -> dict[str, Column]:
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return {name: base + amount * F.col(axis) / r for (name, base), axis in zip(cols.items(), "xyz")}


def reconstruct(tracers: DataFrame, mesh: Mesh, radius: float, bias: float = 2.0, growth: float = 0.78, rounds: int = 3, randoms: DataFrame | None = None, alpha: float = 1.0, ran_min: float = 0.0) -> DataFrame:
    """``tracers (id, x, y, z, w)`` with ``newx, newy, newz`` and the last ``psi_x, psi_y, psi_z`` at them.

    Each round deposits the tracers where they are now, solves for the displacements there
    and moves the *observed* positions along the line of sight by the growth rate times it:
    the z axis of a periodic box, the direction from the observer in a survey (``randoms``
    given).  The first estimate is scaled by 1 / (1 + growth / bias) along the line of sight.
    """
    beta = growth / bias
    box = randoms is None
    total = float(tracers.count())
    smooth_randoms = None if box else kept(fourier_smoothed(M.dense(M.deposit(randoms, mesh.n, mesh.length, mesh.origin), mesh.n), mesh, radius))
    now = tracers.withColumns({f"new{a}": F.col(a) for a in "xyz"})
    for k in range(rounds):
        moved = now.select("id", "w", *(F.col(f"new{a}").alias(a) for a in "xyz"))
        psi = box_psi(moved, mesh, radius, bias, total) if box else survey_psi(moved, smooth_randoms, mesh, radius, bias, alpha, ran_min)
        shifts = M.gather(moved, psi, ["psi_x", "psi_y", "psi_z"], mesh.n, mesh.length, mesh.origin)
        now = now.select("id", "x", "y", "z", "w", "newx", "newy", "newz").join(shifts, "id")
        if box:
            if k == 0:
                now = now.withColumn("psi_z", F.col("psi_z") - beta / (1 + beta) * F.col("psi_z"))
            now = now.withColumn("newz", S.wrapped(F.col("z") + growth * F.col("psi_z"), mesh.length, closed=True))
        else:
            r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
            radial = (F.col("psi_x") * F.col("x") + F.col("psi_y") * F.col("y") + F.col("psi_z") * F.col("z")) / r
            if k == 0:
                now = now.withColumns(_along({f"psi_{a}": F.col(f"psi_{a}") for a in "xyz"}, -beta / (1 + beta) * radial))
            now = now.withColumns(_along({f"new{a}": F.col(a) for a in "xyz"}, growth * radial))
        now = kept(now)
    return now


def shifted_randoms(randoms: DataFrame, psi: DataFrame, mesh: Mesh, growth: float) -> DataFrame:
    """Randoms moved along the line of sight as tracers are."""
    out = randoms.join(M.gather(randoms, psi, ["psi_x", "psi_y", "psi_z"], mesh.n, mesh.length, mesh.origin), "id")
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    radial = (F.col("psi_x") * F.col("x") + F.col("psi_y") * F.col("y") + F.col("psi_z") * F.col("z")) / r
    return out.withColumns(_along({f"new{a}": F.col(a) for a in "xyz"}, growth * radial))


def fully_shifted(points: DataFrame, psi: DataFrame, mesh: Mesh, periodic: bool = True) -> DataFrame:
    """Current positions plus the whole displacement there; modulo the box where it is periodic."""
    here = points.select("id", *(F.col(f"new{a}").alias(a) for a in "xyz"))
    out = points.drop("psi_x", "psi_y", "psi_z").join(M.gather(here, psi, ["psi_x", "psi_y", "psi_z"], mesh.n, mesh.length, mesh.origin), "id")
    moved = {f"new{a}": F.col(f"new{a}") + F.col(f"psi_{a}") for a in "xyz"}
    return out.withColumns({k: S.periodic(v, mesh.length) for k, v in moved.items()} if periodic else moved)


def shift_summary(points: DataFrame) -> DataFrame:
    """A row per axis: standard deviation, 16th and 84th percentile, smallest and largest shift."""
    long = points.select(F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), (F.col(f"new{a}") - F.col(a)).alias("s")) for a in "xyz"))).alias("e")).select("e.*")
    return long.groupBy("axis").agg(F.stddev_pop("s").alias("std"), F.percentile("s", 0.16).alias("p16"), F.percentile("s", 0.84).alias("p84"), F.min("s").alias("least"), F.max("s").alias("most"))


def export_positions(points: DataFrame, sky: bool, cosmology=None, keep: tuple[str, ...] = (), randoms: bool = False) -> DataFrame:
    """What later stages read: box positions, or sky positions with systematic weight and completeness (randoms: their weight)."""
    if not sky:
        return points.select(*keep, *(F.col(f"new{a}").alias(a) for a in "xyz"))
    ra, dec, r = S.sky(F.col("newx"), F.col("newy"), F.col("newz"))
    return points.select(*keep, ra.alias("ra"), dec.alias("dec"), cosmology.redshift(r).alias("redshift"), *(("weight_fkp",) if randoms else ("weight_systot", "comp")))
