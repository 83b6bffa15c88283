"""Bound halos: unbinding of the particles of each candidate."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeflow.functions import scalars as S
from latticeflow.operators import graph as G
from latticeflow.operators.stage import kept

BLOCK = 1024


@dataclass(frozen=True)
class Units:
    """Simulation constants: box length in Mpc/h, particles a side, matter density and scale factor."""

    length: float
    side: int
    omega_m: float = 0.31
    a: float = 1.0

    @property
    def hubble(self) -> float:
        return 100.0 * math.sqrt(self.omega_m / self.a**3 + 1.0 - self.omega_m)

    @property
    def potential(self) -> float:
        """G times a particle's mass, in (km/s)**2 Mpc/h."""
        return self.omega_m * 3.0 * (self.length / self.side) ** 3 * 1e4 / (8.0 * math.pi)


def potentials(xyz: np.ndarray) -> np.ndarray:
    """Sum of inverse distances to all other particles, block by block."""
    out = np.zeros(len(xyz))
    for s in range(0, len(xyz), BLOCK):
        d2 = ((xyz[s : s + BLOCK, None, :] - xyz[None, :, :]) ** 2).sum(2)
        with np.errstate(divide="ignore"):
            inv = 1.0 / np.sqrt(d2)
        inv[np.arange(len(inv)), s + np.arange(len(inv))] = 0.0
        out[s : s + BLOCK] = inv.sum(1)
    return out


def bound(xyz: np.ndarray, vel: np.ndarray, central: np.ndarray, core: np.ndarray, units: Units, factor: float = 2.0):
    """``(alive, potential, boundness, centroid)`` of one candidate.

    The potential is first multiplied by the largest ratio of kinetic to potential energy,
    then by less and less (a ``factor`` a round) down to itself, and particles with positive
    energy leave: strongly unbound ones go before they can bias the rest.  The velocity
    centroid is that of the surviving particles of the core's own zone; positions are the
    images nearest to the core, for kinetic and potential energy alike.
    """
    n = len(xyz)
    half = units.length / 2
    rel = xyz - core
    rel = np.where(rel > half, rel - units.length, np.where(rel < -half, rel + units.length, rel))
    alive = np.ones(n, bool)
    if n == 1:
        return np.zeros(1, bool), np.zeros(1), np.zeros(1), vel[0]
    pot = potentials(rel)
    centroid = vel.mean(0)
    multiplier, first, left = 2.0, True, 1
    energy = np.zeros(n)
    while (left or multiplier > 1.0) and alive.sum() > 1:
        multiplier = 1.0 if not first and multiplier <= factor else multiplier / factor
        own = alive & central
        if own.any():
            centroid = vel[own].mean(0)
        kinetic = 0.5 * ((units.hubble * rel + vel - centroid) ** 2).sum(1)
        energy = kinetic - units.potential * multiplier * pot
        with np.errstate(divide="ignore", invalid="ignore"):
            most = max(1.0, float(np.max(np.where(alive, kinetic / (units.potential * pot), 0.0))))
        if first:
            multiplier, first = most, False
            continue
        gone = alive & (energy > 0)
        left = int(gone.sum())
        if left:
            stay = alive & ~gone
            # what leaves takes its share of the potential with it
            out = np.flatnonzero(gone)
            for s in range(0, len(out), BLOCK):
                d2 = ((rel[:, None, :] - rel[out[s : s + BLOCK]][None, :, :]) ** 2).sum(2)
                with np.errstate(divide="ignore"):
                    inv = np.where(d2 > 0, 1.0 / np.sqrt(d2), 0.0)
                pot = pot - inv.sum(1)
            alive = stay
        elif multiplier > factor:
            multiplier = most
    if alive.sum() <= 1:
        alive = np.zeros(n, bool)
    return alive, np.where(alive, -pot, 0.0), np.where(alive, energy, 0.0), centroid


HALO = "halo long, n_bound long, n_total long, bound_total double, bound_least double, most_bound long, deepest long, most_bound_central boolean, deepest_central boolean, vx double, vy double, vz double"


def unbound_removed(particles: DataFrame, units: Units, factor: float = 2.0) -> DataFrame:
    """Per halo: what is bound, its most bound and deepest particles and its velocity.

    ``particles (halo, id, x, y, z, vx, vy, vz, central, is_core)``; halos are independent
    and come many to a batch, in order, a halo cut by a batch's end with the next batch.
    """
    columns = ["halo", "id", "x", "y", "z", "vx", "vy", "vz", "central", "is_core"]
    names = [c.split()[0] for c in HALO.split(", ")]

    def of_halo(part: dict[str, np.ndarray]) -> tuple:
        xyz, vel = (np.stack([part[c] for c in axes], 1).astype(float) for axes in (("x", "y", "z"), ("vx", "vy", "vz")))
        central, ids = part["central"].astype(bool), part["id"]
        alive, pot, energy, v = bound(xyz, vel, central, xyz[int(np.argmax(part["is_core"]))], units, factor)
        k, d = int(np.argmin(energy)), int(np.argmin(pot))
        some = bool(alive.any())
        return int(part["halo"][0]), int(alive.sum()), len(ids), float(energy.sum()), float(energy.min()), int(ids[k]) if some else -1, int(ids[d]) if some else -1, some and bool(central[k]), some and bool(central[d]), *map(float, v)

    def run(batches):
        held = None
        for batch in batches:
            part = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
            if held is not None:
                part = {c: np.concatenate([held[c], part[c]]) for c in columns}
            if not len(part["id"]):
                continue
            heads = np.concatenate([[0], np.flatnonzero(part["halo"][1:] != part["halo"][:-1]) + 1])
            held = {c: part[c][heads[-1] :] for c in columns}
            rows = [of_halo({c: part[c][s:e] for c in columns}) for s, e in zip(heads[:-1].tolist(), heads[1:].tolist())]
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])
        if held is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, of_halo(held)))])

    return particles.select(*columns).repartition("halo").sortWithinPartitions("halo", "id").mapInArrow(run, HALO)


def pair_potential(particles: DataFrame) -> DataFrame:
    """``(id, potential)``: inverse distances summed over each halo, as a self-join within halos."""
    a, b = particles.alias("a"), particles.alias("b")
    d = F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2) + F.pow(F.col("a.z") - F.col("b.z"), 2))
    return a.join(b, (F.col("a.halo") == F.col("b.halo")) & (F.col("a.id") != F.col("b.id"))).groupBy(F.col("a.id").alias("id")).agg(F.sum(1 / d).alias("potential"))


def velocity_centroids(particles: DataFrame) -> DataFrame:
    return particles.groupBy("halo").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("vx", "vy", "vz")))


def halo_table(volumes: DataFrame, edges: DataFrame, tolerance: float = 1e30) -> tuple[DataFrame, DataFrame]:
    """Candidates: the watershed on cell volumes with density peaks as cores.

    Returns ``(h, core, core_vol, np, np_join, prob)`` in order and the zone of each particle.
    ``prob`` is the leak over the core's volume, one at least.
    """
    nodes = kept(volumes.select("id", F.col("volume").alias("dens")))
    valued = kept(G.with_values(edges, nodes))
    rooted = kept(G.zones(G.roots(G.jumpers(nodes, valued))))
    table = kept(G.zone_table(nodes, rooted))
    most = float(nodes.agg(F.max("dens")).first()[0] or 0.0)
    return candidates(table, kept(G.flood(table, kept(G.saddles(valued, rooted)), most, tolerance))), rooted


def candidates(table: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """The rows of :func:`halo_table` from the watershed's table and hierarchy."""
    joined = G.joined(table, hierarchy)
    prob = F.greatest(F.col("contrast"), F.lit(1.0))
    rows = kept(table.join(joined, "h").select("h", "core", F.col("core_dens").alias("core_vol"), "np", "np_join", prob.alias("prob")))
    top = float(rows.agg(F.max("prob")).first()[0] or 1.0)
    key = S.halo_order(F.col("np_join"), F.col("prob"), F.lit(top))
    return rows.withColumn("key", key).orderBy(F.desc("key"), "h")


def by_bound_mass(halos: DataFrame) -> DataFrame:
    return halos.where("n_bound > 0").orderBy(F.desc("n_bound"), F.desc("n_total"), "halo")
