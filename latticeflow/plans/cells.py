"""Voids and clusters from a tessellation: densities, basins, hierarchy and catalogues."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeflow.functions import scalars as S
from latticeflow.operators import blocks as B
from latticeflow.operators import graph as G
from latticeflow.operators import tessellation as T
from latticeflow.operators.stage import kept


class Hierarchy:
    """Zones of a graph and how they merge; each part is made when it is first asked for.

    ``members (id, root, zone, dens, vol, is_edge)``, with what else they carry; ``saddles`` as
    :func:`graph.saddles` has them.
    """

    def __init__(self, members: DataFrame, saddles: DataFrame, tolerance: float = 1e30):
        self.members, self._saddles, self._tolerance = members, saddles, tolerance

    @property
    def nodes(self) -> DataFrame:  # id, dens (as flooded), vol, is_edge
        return self.members.select("id", "dens", "vol", "is_edge")

    @property
    def zoned(self) -> DataFrame:  # id, root, zone
        return self.members.select("id", "root", "zone")

    @cached_property
    def table(self) -> DataFrame:  # h, core, core_dens, np, vol, edge
        return kept(G.zone_sums(self.members, F.col("is_edge"), "vol").where(F.col("core_dens") < S.EDGE_DENSITY))

    @cached_property
    def links(self) -> DataFrame:
        own = self.table.select("h")
        links = self._saddles.where(F.col("slv") < S.EDGE_DENSITY)
        return kept(links.join(own, "h", "left_semi").join(own.withColumnRenamed("h", "h2"), "h2", "left_semi"))

    @cached_property
    def max_dens(self) -> float:
        return float(G.density_range(self.members).first()["max_dens"] or 0.0)

    @cached_property
    def groups(self) -> DataFrame:  # h, groups, leak, final_ratio
        return kept(G.flood(self.table, self.links, self.max_dens, self._tolerance))


def basins(nodes: DataFrame, edges: DataFrame, tolerance: float = 1e30) -> Hierarchy:
    """Zones, saddles and hierarchy of ``nodes (id, dens, vol, is_edge)``.

    Border nodes keep their place in the graph with the border density, so that water leaves
    through them, but count neither as members nor as volume; zones with a border core are
    left out of the hierarchy's table.
    """
    nodes = kept(nodes.withColumn("dens", F.when(F.col("is_edge"), F.lit(S.EDGE_DENSITY)).otherwise(F.col("dens"))))
    valued = kept(G.with_values(edges, nodes))
    zoned = kept(G.zones(G.roots(G.jumpers(nodes, valued))))
    return Hierarchy(kept(nodes.join(zoned, "id")), G.saddles(valued, zoned), tolerance)


def basins_of_lists(nodes: DataFrame, length: float, count: int, tolerance: float = 1e30) -> Hierarchy:
    """:func:`basins` of about ``count`` ``nodes (id, dens, vol, neighbours, x, y, z)``, none at a border, block by block; members keep their places."""
    members, saddles = B.watershed(nodes, length, B.blocks_of(nodes, count))
    return Hierarchy(members.withColumn("is_edge", F.lit(False)), saddles, tolerance)


def circumcentre(corner: list[tuple[Column, Column, Column]]) -> tuple[Column, Column, Column]:
    """The point at equal distance from four points, by Cramer's rule around the first."""
    (x0, y0, z0), *rest = corner
    a = [(x - x0, y - y0, z - z0) for x, y, z in rest]
    b = [(dx * dx + dy * dy + dz * dz) / 2 for dx, dy, dz in a]

    def det(r0, r1, r2):
        return r0[0] * (r1[1] * r2[2] - r1[2] * r2[1]) - r0[1] * (r1[0] * r2[2] - r1[2] * r2[0]) + r0[2] * (r1[0] * r2[1] - r1[1] * r2[0])

    whole = det(*a)
    out = []
    for axis, base in enumerate((x0, y0, z0)):
        rows = [tuple(b[i] if k == axis else a[i][k] for k in range(3)) for i in range(3)]
        out.append(base + det(*rows) / F.nullif(whole, F.lit(0.0)))
    return out[0], out[1], out[2]


def near_image(x: Column, of: Column, length: float) -> Column:
    d = of - x
    return x + F.when(F.abs(d) > length / 2, length * F.signum(d)).otherwise(F.lit(0.0))


def circumcentres(voids: DataFrame, nodes: DataFrame, edges: DataFrame, positions: DataFrame, length: float) -> DataFrame:
    """``(h, x, y, z, status)`` of each void: the centre of the core and its three lowest mutual neighbours.

    Without three such neighbours the centre is the origin and the status ``missing``.
    """
    four = G.common_neighbours(edges, nodes, voids.select("core").distinct())
    at = positions.select("id", "x", "y", "z")
    joined = voids.select("h", "core").join(four, "core")
    for name in ("core", "a", "b", "c"):
        joined = joined.join(at.select(F.col("id").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in "xyz")), name, "left")
    # each step by columns of its own: written out in one expression the code outgrows what compiles
    joined = joined.withColumns({f"{n}_{c}": near_image(F.col(f"{n}_{c}"), F.col(f"core_{c}"), length) for n in ("a", "b", "c") for c in "xyz"})
    centre = [F.col(f"m_{c}") for c in "xyz"]
    joined = joined.withColumns({f"m_{c}": v for c, v in zip("xyz", circumcentre([tuple(F.col(f"{n}_{c}") for c in "xyz") for n in ("core", "a", "b", "c")]))})
    ok = F.col("c").isNotNull()

    def back(v: Column) -> Column:
        return F.when((v < 0) | (v > length), v - length * F.signum(v)).otherwise(v)

    return joined.select("h", *(F.when(ok, back(v)).otherwise(F.lit(0.0)).alias(c) for v, c in zip(centre, "xyz")), F.when(ok, F.lit("ok")).otherwise(F.lit("missing")).alias("status"))


def barycentres(voids: DataFrame, zoned: DataFrame, nodes: DataFrame, positions: DataFrame, length: float, strip: float | None = None, clusters: bool = False) -> DataFrame:
    """``(h, x, y, z, mean)``: centres of the members' volume around the core, nearest images, and their volume-weighted density.

    ``strip`` leaves out members of at least that density (at most, for clusters).
    """
    at = positions.select("id", "x", "y", "z")
    cores = at.select(F.col("id").alias("core"), *(F.col(c).alias(f"c{c}") for c in "xyz"))
    members = zoned.select("id", F.col("zone").alias("h")).join(voids.select("h", "core").join(cores, "core"), "h").join(at, "id").join(nodes.select("id", "dens", "vol", "is_edge").where("not is_edge"), "id")
    return _centred(members, length, strip, clusters)


def centres(tree: Hierarchy, length: float) -> DataFrame:
    """:func:`barycentres` of all zones of a hierarchy whose members keep their places."""
    inner = tree.members.where("not is_edge")
    cores = inner.where("id = root").select(F.col("zone").alias("h"), *(F.col(c).alias(f"c{c}") for c in "xyz"))
    return _centred(inner.select(F.col("zone").alias("h"), "dens", "vol", "x", "y", "z").join(cores, "h"), length)


def _centred(members: DataFrame, length: float, strip: float | None = None, clusters: bool = False) -> DataFrame:
    """:func:`barycentres` of ``members (h, dens, vol, x, y, z, cx, cy, cz)``."""
    if strip is not None:
        members = members.where(F.col("dens") > strip if clusters else F.col("dens") < strip)
    w = F.col("vol")
    sums = members.groupBy("h").agg(
        (F.sum(w * F.col("dens")) / F.sum(w)).alias("mean"),
        *((F.sum(w * (near_image(F.col(c), F.col(f"c{c}"), length) - F.col(f"c{c}"))) / F.sum(w) + F.max(f"c{c}")).alias(c) for c in "xyz"),
    )

    def back(v: Column) -> Column:
        return F.when((v < 0) | (v > length), v - length * F.signum(v)).otherwise(v)

    return sums.select("h", *(back(F.col(c)).alias(c) for c in "xyz"), "mean")


def described(voids: DataFrame, centres: DataFrame, means: DataFrame, clusters: bool = False) -> DataFrame:
    """The catalogue: ``id, x, y, z, radius, extreme, mean_contrast, lambda, ratio, edge_flag``."""
    radius = S.effective_radius(F.col("vol"))
    out = voids.join(centres.drop("mean"), "h").join(means.select("h", "mean"), "h").withColumn("radius", radius)
    ordered = F.col("extreme").desc() if clusters else F.col("extreme").asc()
    return out.select(
        F.col("h").alias("id"), "x", "y", "z", "radius", (F.col("core_dens") - 1).alias("extreme"), (F.col("mean") - 1).alias("mean_contrast"),
        S.structure_parameter(F.col("mean") - 1, F.col("radius"), clusters).alias("lambda"), F.col("dens_ratio").alias("ratio"), "edge_flag",
    ).orderBy(ordered, "id")


def zoned_cells(cells: DataFrame, length: float, inverted: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(members, table, groups)`` of a periodic box's cells: density is one over the volume.

    No cell touches a border there, so the first saddles are all that the catalogues take from
    the hierarchy; the zone graph stays distributed.
    """
    dens = 1 / F.col("volume")
    nodes = cells.select("id", (S.inverted(dens) if inverted else dens).alias("dens"), F.col("volume").alias("vol"), "neighbours", "x", "y", "z")
    members, links = B.watershed(nodes, length)
    table = kept(G.zone_sums(members, None, "vol").where(F.col("core_dens") < S.EDGE_DENSITY))
    links = links.where(F.col("slv") < S.EDGE_DENSITY)
    links = links.join(table.select("h"), "h", "left_semi").join(table.select(F.col("h").alias("h2")), "h2", "left_semi")
    top = float(G.density_range(members).first()["max_dens"] or 0.0)
    return members, table, G.unflooded(table, links, top)


def _members_of(voids: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cores ``(h, cx, cy, cz)`` of ``voids``, and their members as :func:`_centred` takes them."""
    cores = members.where("id = root").select(F.col("zone").alias("h"), *(F.col(c).alias(f"c{c}") for c in "xyz")).join(voids.select("h"), "h", "left_semi")
    own = members.select(F.col("zone").alias("h"), (1 / F.col("vol")).alias("dens"), "vol", "x", "y", "z")
    return cores, own.join(cores, "h")


def find_voids(points: DataFrame, length: float, cut: float = 1.0, least_members: int = 5, barycentre: bool = True) -> DataFrame:
    cells = T.tessellate(points, length)
    members, table, groups = zoned_cells(cells, length)
    voids = kept(G.void_list(table, groups, cut, least_members))
    means = kept(_centred(_members_of(voids, members)[1], length))
    centres = means if barycentre else circumcentres(voids, members, kept(T.edges_of(cells)), points, length).drop("status")
    return described(voids, centres, means)


def find_clusters(points: DataFrame, length: float, cut: float = 1.0, least_members: int = 5) -> DataFrame:
    """Clusters: the same on inverted densities; the centre is the core particle."""
    members, table, groups = zoned_cells(T.tessellate(points, length), length, inverted=True)
    found = kept(G.cluster_list(table, groups, cut, least_members))
    cores, own = _members_of(found, members)
    return described(found, cores.select("h", *(F.col(f"c{c}").alias(c) for c in "xyz")), kept(_centred(own, length)), clusters=True)


def on_survey(catalogue: DataFrame, mask: DataFrame, nside: int, cosmology, middle: tuple[float, float, float], length: float, low: float, high: float) -> DataFrame:
    """A survey's catalogue: sky positions, and only structures inside the mask and the redshift range."""
    from latticeflow.functions.healpix import pixel_of
    from latticeflow.plans.voxel import on_sky

    out = on_sky(catalogue, cosmology, middle, length, low, high)
    pix = pixel_of(F.col("ra"), F.col("dec"), nside)
    return out.withColumn("__p", pix).join(mask.where("val <> 0").select(F.col("pix").alias("__p")), "__p", "left_semi").drop("__p").where(F.col("edge_flag").cast("int") < 2)
