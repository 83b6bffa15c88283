"""Voids and clusters by watershed on a mesh."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeflow.functions import scalars as S
from latticeflow.functions.cosmology import Cosmology
from latticeflow.operators import graph as G
from latticeflow.operators import mesh as M
from latticeflow.operators.stage import kept


EMPTY = 1e-12  # an empty cell weighs as one of this density


@dataclass(frozen=True)
class Basins:
    """A watershed of a grid: cells with their zones, touching zones, and the zone table."""

    cells: DataFrame  # id, dens, root, zone
    links: DataFrame  # h, h2, slv
    table: DataFrame  # h, core, core_dens, np, vol, edge
    max_dens: float


def watershed(grid: DataFrame, n: int, value: str = "rho", border: float = S.EDGE_DENSITY, single: bool = True) -> Basins:
    """Basins of ``grid (vox, value)``; ``single`` compares densities in single precision."""
    cells = grid.where(F.col(value) < border).select(F.col("vox").alias("id"), (F.col(value).cast("float").cast("double") if single else F.col(value)).alias("dens"))
    cells = kept(cells)
    valued = G.grid_edges(cells.select(F.col("id").alias("vox"), F.col("dens").alias("rho")), n)
    rooted = G.zones(G.roots(G.jumpers(cells, valued)))
    placed = kept(cells.join(rooted, "id"))
    edge = G.grid_zone_edges(valued, rooted)
    table = G.zone_table(cells, rooted).drop("edge").join(edge, "h")
    most = G.density_range(cells, border).first()["max_dens"]
    return Basins(placed, G.saddles(valued, rooted), kept(table), float(most or 0.0))


def box_density(points: DataFrame, n: int, length: float, sigma_cells: float | None = None) -> DataFrame:
    """Smoothed density in units of the mean, one row a cell."""
    grid = M.dense(M.deposit(points, n, length), n)
    if sigma_cells:
        grid = M.smoothed(grid, n, sigma_cells)
    total = points.agg(F.count("*").cast("double").alias("__total"))
    return grid.join(F.broadcast(total), how="cross").select("vox", M.density_box(F.col("rho"), n, F.col("__total")).alias("rho"))


def survey_density(tracers: DataFrame, randoms: DataFrame, n: int, length: float, origin: tuple[float, float, float], sums: DataFrame, sigma_cells: float | None = None) -> DataFrame:
    """``(vox, rho, masked)``: the mask tests unsmoothed randoms, the ratio smoothed ones."""
    g = M.dense(M.deposit(tracers, n, length, origin, wrap=False), n)
    r = M.dense(M.deposit(randoms, n, length, origin, wrap=False), n)
    gs, rs = (M.smoothed(x, n, sigma_cells, periodic=False) if sigma_cells else x for x in (g, r))
    both = gs.join(rs.withColumnRenamed("rho", "rho_r"), "vox").join(r.withColumnRenamed("rho", "raw_r"), "vox")
    return both.join(F.broadcast(sums), how="cross").select(
        "vox", M.density_survey(F.col("rho"), F.col("rho_r"), F.col("alpha"), F.col("ran_min")).alias("rho"), (F.col("raw_r") <= F.col("ran_min")).alias("masked")
    )


def catalogue(basins: Basins, densities: DataFrame, n: int, length: float, cut: float, clusters: bool = False, barycentres: bool = True, masked: DataFrame | None = None) -> DataFrame:
    """One row per void (or cluster): ``id, x, y, z, radius, extreme, mean_contrast, lambda, ratio``.

    ``densities (id, rho)`` are uninverted.  Centres are the core cell's corner, or the mean
    of the members' corners weighed by inverse density (density, for clusters).
    """
    links = G.direct_links(basins.table, basins.links, basins.max_dens)
    core = densities.select(F.col("id").alias("core"), F.col("rho").alias("extreme"))
    picked = basins.table.join(core, "core").where(~F.col("edge") & ((F.col("extreme") > cut) if clusters else (F.col("extreme") < cut)))
    if masked is not None:
        picked = picked.join(masked.where("masked").select(F.col("vox").alias("core")), "core", "left_anti")
    x, y, z = S.voxel_corner(F.col("id"), n, length)
    weight = F.col("rho") if clusters else 1 / F.greatest(F.col("rho"), F.lit(EMPTY))
    members = basins.cells.select("id", F.col("zone").alias("h")).join(densities, "id").join(picked.select("h"), "h", "left_semi").withColumns({"x": x, "y": y, "z": z, "w": weight})
    means = members.groupBy("h").agg(F.avg("rho").alias("mean"), *(((F.sum(F.col(a) * F.col("w")) / F.sum("w")) if barycentres else F.max(F.when(F.col("id") == F.col("h"), F.col(a)))).alias(a) for a in "xyz"))
    if not barycentres:
        cx, cy, cz = S.voxel_corner(F.col("core"), n, length)
        means = means.drop("x", "y", "z").join(picked.select("h", cx.alias("x"), cy.alias("y"), cz.alias("z")), "h")
    volume = F.col("np") * (length / n) ** 3
    radius = S.effective_radius(volume)
    out = picked.join(means, "h").join(links.select("h", F.col("ratio")), "h").withColumn("radius", radius)
    ordered = F.col("extreme").desc() if clusters else F.col("extreme").asc()
    return out.select(
        F.col("h").alias("id"), "x", "y", "z", "radius", (F.col("extreme") - 1).alias("extreme"), (F.col("mean") - 1).alias("mean_contrast"),
        S.structure_parameter(F.col("mean") - 1, F.col("radius"), clusters).alias("lambda"), "ratio",
    ).orderBy(ordered, "id")


def find_voids(points: DataFrame, n: int, length: float, cut: float = 1.0, sigma_cells: float | None = None, clusters: bool = False, barycentres: bool = True) -> DataFrame:
    """Voids (clusters: watershed of the inverted density) of a periodic box of tracers."""
    rho = kept(box_density(points, n, length, sigma_cells))
    field = rho.select("vox", S.inverted(F.col("rho")).alias("rho")) if clusters else rho
    basins = watershed(field.where("rho is not null"), n)
    return catalogue(basins, rho.select(F.col("vox").alias("id"), F.col("rho").cast("float").cast("double").alias("rho")), n, length, cut, clusters, barycentres)


def on_sky(rows: DataFrame, cosmology: Cosmology, middle: tuple[float, float, float], length: float, low: float, high: float) -> DataFrame:
    """Catalogue rows of a survey box as ``ra, dec, redshift, theta``, strictly between two redshifts."""
    moved: dict[str, Column] = {a: F.col(a) + (m - length / 2) for a, m in zip("xyz", middle)}
    out = rows.withColumns(moved)
    ra, dec, r = S.sky(F.col("x"), F.col("y"), F.col("z"))
    out = out.withColumns({"ra": ra, "dec": dec, "dist": r}).withColumn("redshift", cosmology.redshift(F.col("dist")))
    return out.withColumn("theta", S.effective_angle(F.col("radius"), F.col("dist"))).where((F.col("redshift") > low) & (F.col("redshift") < high))
