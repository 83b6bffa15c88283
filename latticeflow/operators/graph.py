"""Watershed on any graph: ``nodes (id, dens)`` and directed ``edges (src, dst, ord)``.

Grids, tessellations, clusters (inverted density) and halos differ only in their edges,
values and border rule, so there is one watershed.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeflow.functions.scalars import EDGE_DENSITY
from latticeflow.operators import floods
from latticeflow.operators.catalog import numbered
from latticeflow.operators.stage import kept

#: Face neighbours in the order in which ties are broken.
FACES = [(0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 0, 0)]


def grid_edges(grid: DataFrame, n: int, value: str = "rho", border: float = EDGE_DENSITY) -> DataFrame:
    """``(src, dst, ord, d, dn)`` of a periodic grid; cells at or above ``border`` take no part."""
    inner = grid.where(F.col(value) < border).select(F.col("vox").alias("src"), F.col(value).alias("d"))
    v = F.col("src")
    x, y, z = F.floor(v / (n * n)), F.floor(v / n) % n, v % n
    steps = F.array(
        *(
            F.struct(F.lit(o).alias("ord"), (F.pmod(x + i, F.lit(n)) * n * n + F.pmod(y + j, F.lit(n)) * n + F.pmod(z + k, F.lit(n))).cast("long").alias("dst"))
            for o, (i, j, k) in enumerate(FACES)
        )
    )
    out = inner.withColumn("e", F.explode(steps)).select("src", "d", "e.ord", "e.dst")
    return out.join(inner.select(F.col("src").alias("dst"), F.col("d").alias("dn")), "dst").select("src", "dst", "ord", "d", "dn")


def adjacency_lists(edges: DataFrame) -> DataFrame:
    """``(src, adj)``: each node's distinct neighbours in order."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("adj"))


def with_values(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges ``(src, dst, ord, d, dn)`` from ``edges (src, dst)`` and ``nodes (id, dens)``; neighbours in the order of their ids."""
    a = nodes.select(F.col("id").alias("src"), F.col("dens").alias("d"))
    b = nodes.select(F.col("id").alias("dst"), F.col("dens").alias("dn"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst").select("src", "dst", F.col("dst").alias("ord"), "d", "dn")


def jumpers(nodes: DataFrame, valued: DataFrame) -> DataFrame:
    """``(id, nxt)``: the lowest neighbour strictly below a node, ties to the first; itself if there is none."""
    down = valued.where("dn < d").groupBy(F.col("src").alias("id")).agg(F.min_by("dst", F.struct("dn", "ord")).alias("nxt"))
    return nodes.select("id").join(down, "id", "left").select("id", F.coalesce("nxt", "id").alias("nxt"))


def roots(jumps: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``(id, root)`` by pointer doubling: the rounds grow with the logarithm of the longest path."""
    state = kept(jumps)
    for _ in range(most_rounds):
        onward = state.select(F.col("id").alias("nxt"), F.col("nxt").alias("far"))
        further = kept(state.join(onward, "nxt").select("id", "far", (F.col("far") != F.col("nxt")).alias("moved")))
        moving = further.where("moved").limit(1).count()
        state = further.select("id", F.col("far").alias("nxt"))
        if not moving:
            return state.select("id", F.col("nxt").alias("root"))
    raise RuntimeError("descent did not end")


def zones(rooted: DataFrame) -> DataFrame:
    """``(id, root, zone)``: zones count from 0 in the order of their roots.

    Zones are numbered after they are distinct, range by range: no task sees them all.
    """
    names = numbered(rooted.select("root"), ("root",)).withColumnRenamed("particle", "zone")
    return rooted.join(names, "root").select("id", "root", "zone")


def saddles(valued: DataFrame, zoned: DataFrame) -> DataFrame:
    """``(h, h2, slv)``: for each pair of touching zones the lowest crossing, each as high as its higher end."""
    a = zoned.select(F.col("id").alias("src"), F.col("zone").alias("h"))
    b = zoned.select(F.col("id").alias("dst"), F.col("zone").alias("h2"))
    crossing = valued.join(a, "src").join(b, "dst").where("h <> h2")
    return crossing.groupBy("h", "h2").agg(F.min(F.greatest("d", "dn")).alias("slv"))


def zone_table(nodes: DataFrame, zoned: DataFrame, edge: Column | None = None, volume: str | None = None) -> DataFrame:
    """``(h, core, core_dens, np, vol, edge)``; border nodes count neither as members nor as volume."""
    return zone_sums(nodes.join(zoned, "id"), edge, volume)


def zone_sums(members: DataFrame, edge: Column | None = None, volume: str | None = None) -> DataFrame:
    """:func:`zone_table` of ``members (id, dens, root, zone)``."""
    joined = members.withColumn("__edge", edge if edge is not None else F.lit(False))
    size = F.count_if(~F.col("__edge")).alias("np")
    vol = (F.sum(F.when(~F.col("__edge"), F.col(volume)).otherwise(F.lit(0.0))) if volume else F.count_if(~F.col("__edge")).cast("double")).alias("vol")
    core = F.max(F.when(F.col("id") == F.col("root"), F.col("dens"))).alias("core_dens")
    return joined.groupBy(F.col("zone").alias("h")).agg(F.min("root").alias("core"), core, size, vol, F.max("__edge").alias("edge"))


def grid_zone_edges(valued: DataFrame, zoned: DataFrame) -> DataFrame:
    """``(h, edge)``: whether a member has between one and five neighbours; cells without any never count."""
    few = valued.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_adj"))
    return zoned.join(few, "id", "left").groupBy(F.col("zone").alias("h")).agg(F.max(F.coalesce((F.col("n_adj") > 0) & (F.col("n_adj") < 6), F.lit(False))).alias("edge"))


def density_range(nodes: DataFrame, border: float = EDGE_DENSITY) -> DataFrame:
    return nodes.where(F.col("dens") < border).agg(F.min("dens").alias("min_dens"), F.max("dens").alias("max_dens"))


def direct_links(table: DataFrame, links: DataFrame, max_dens: float) -> DataFrame:
    """``(h, leak, ratio)``: each zone's lowest saddle, the highest density where nothing touches it, over its core (infinite over an empty one)."""
    low = links.groupBy("h").agg(F.min("slv").alias("slv"))
    leak = F.coalesce("slv", F.lit(max_dens))
    ratio = F.when(F.col("core_dens") == 0, F.lit(float("inf"))).otherwise(leak / F.col("core_dens"))
    return table.join(low, "h", "left").select("h", leak.alias("leak"), ratio.alias("ratio"))


def unflooded(table: DataFrame, links: DataFrame, max_dens: float) -> DataFrame:
    """As :func:`flood`, but without groups: ``final_ratio`` is that of the first saddle.

    The first group's ratio, or the final one if there is no group, is this one either way.  So
    it is all that lists of unmerged voids need, unless a zone touches a border.
    """
    none = F.lit(None).cast("array<struct<ratio: double, zones: array<bigint>>>")
    return direct_links(table, links, max_dens).select("h", none.alias("groups"), "leak", F.col("ratio").alias("final_ratio"))


def flood(table: DataFrame, links: DataFrame, max_dens: float, tolerance: float = 1e30, block: int = floods.BLOCK) -> DataFrame:
    """``(h, groups, leak, final_ratio)``: the hierarchy of each zone.

    From its own zone water rises to the lowest saddle out.  It stops if there is none, the
    saddle is above ``tolerance``, or a zone behind it has a deeper core; else all that is
    reachable at that level is absorbed as one group, unless a deeper core is among it.
    :func:`rise` is the same for one zone; here all come from one pass, see :mod:`floods`.
    """
    return floods.hierarchy(table, links, max_dens, tolerance, block)


class Links:
    """Links of each zone in order, ``(slv, h2)``, as three arrays: a few bytes a link in the driver and in each task."""

    def __init__(self, h: np.ndarray, h2: np.ndarray, slv: np.ndarray):
        order = np.lexsort((h2, slv, h))
        self.zones, self.starts = np.unique(h[order], return_index=True)
        self.starts = np.append(self.starts, len(order))
        self.h2, self.slv = h2[order], slv[order]

    def get(self, h: int, default=()):
        at = int(np.searchsorted(self.zones, h))
        if at == len(self.zones) or self.zones[at] != h:
            return default
        own = slice(self.starts[at], self.starts[at + 1])
        return list(zip(self.slv[own].tolist(), self.h2[own].tolist()))


class Cores:
    """Core densities by zone, as two arrays."""

    def __init__(self, h: np.ndarray, dens: np.ndarray):
        order = np.argsort(h)
        self.zones, self.dens = h[order], dens[order]

    def __getitem__(self, h: int) -> float:
        at = int(np.searchsorted(self.zones, h))
        if at == len(self.zones) or self.zones[at] != h:
            raise KeyError(h)
        return float(self.dens[at])


def rise(h: int, graph: dict, cores: dict, max_dens: float, tolerance: float) -> tuple[list[dict], float, float]:
    """Flooding of one zone, see :func:`flood`."""
    inside, groups = {h}, []
    shore = list(graph.get(h, ()))
    heapq.heapify(shore)
    while True:
        while shore and shore[0][1] in inside:
            heapq.heappop(shore)
        if not shore:
            leak = max_dens
            break
        leak = shore[0][0]
        if leak > tolerance:
            break
        added: list[int] = []
        seen = set()
        beaten = False
        front = []
        while shore and shore[0][0] <= leak:
            front.append(heapq.heappop(shore)[1])
        while front:
            z = front.pop()
            if z in inside or z in seen:
                continue
            seen.add(z)
            if cores[z] < cores[h]:
                beaten = True
                break
            added.append(z)
            for level, other in graph.get(z, ()):
                if other in inside or other in seen:
                    continue
                if level <= leak:
                    front.append(other)
                else:
                    heapq.heappush(shore, (level, other))
        if beaten:
            break
        inside.update(added)
        groups.append({"ratio": leak / cores[h], "zones": sorted(added)})
    return groups, leak, leak / cores[h]


def joined(table: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """``(h, n_zones, vol_join, np_join, contrast)`` of each zone with all it absorbed."""
    absorbed = hierarchy.select("h", "final_ratio", F.explode_outer("groups").alias("g")).select("h", "final_ratio", F.explode_outer("g.zones").alias("z"))
    sums = absorbed.join(table.select(F.col("h").alias("z"), "vol", "np"), "z", "left").groupBy("h").agg(F.first("final_ratio").alias("contrast"), F.count("z").alias("more"), F.sum("vol").alias("v"), F.sum("np").alias("p"))
    return table.join(sums, "h").select("h", (F.col("more") + 1).alias("n_zones"), (F.col("vol") + F.coalesce("v", F.lit(0.0))).alias("vol_join"), (F.col("np") + F.coalesce("p", F.lit(0))).alias("np_join"), "contrast")


def void_list(table: DataFrame, hierarchy: DataFrame, min_dens_cut: float, least_members: int) -> DataFrame:
    """Unmerged voids: zones whose first ratio is at least one, deep and large enough.

    The density ratio is the first group's where there is one, else the final one (-1 beyond
    1e20).  ``edge`` tells whether a zone of that first group touches a border: the void's
    own border is not looked at.
    """
    first = hierarchy.select("h", F.get("groups", F.lit(0)).alias("g"), "final_ratio")
    ratio = F.coalesce("g.ratio", "final_ratio")
    members = first.select("h", F.explode("g.zones").alias("z")).join(table.select(F.col("h").alias("z"), "edge"), "z").groupBy("h").agg(F.max("edge").alias("edge_flag"))
    rows = table.join(first, "h").withColumn("ratio", ratio).where((F.col("ratio") >= 1) & (F.col("core_dens") < min_dens_cut) & (F.col("np") >= least_members))
    out = rows.join(members, "h", "left")
    return out.select("h", "core", "core_dens", "np", "vol", F.lit(1).alias("num_zones"), F.when(F.col("ratio") > 1e20, F.lit(-1.0)).otherwise(F.col("ratio")).alias("dens_ratio"), F.coalesce("edge_flag", F.lit(False)).alias("edge_flag"))


def cluster_list(table: DataFrame, hierarchy: DataFrame, max_dens_cut: float, least_members: int) -> DataFrame:
    """Unmerged clusters of a watershed on inverted density: as :func:`void_list`, with dense cores."""
    flipped = table.withColumn("core_dens", 1 / F.col("core_dens"))
    rows = void_list(flipped.withColumn("core_dens", -F.col("core_dens")), hierarchy, -max_dens_cut, least_members)
    return rows.withColumn("core_dens", -F.col("core_dens"))


def merged_zones(hierarchy: DataFrame, ratio_threshold: float = 1e30, link_density: float | None = None, cores: DataFrame | None = None) -> DataFrame:
    """``(h, zones)``: the prefix of the hierarchy below a ratio, or below a link density (ratio times core density)."""
    rows = hierarchy if link_density is None else hierarchy.join(cores.select("h", "core_dens"), "h")
    low = (lambda g: g["ratio"] < ratio_threshold) if link_density is None else (lambda g: (g["ratio"] < ratio_threshold) & (g["ratio"] * F.col("core_dens") < link_density))
    # ratios never fall along the hierarchy, so filtering takes a prefix
    return rows.select("h", F.concat(F.array("h"), F.flatten(F.transform(F.filter("groups", low), lambda g: g["zones"]))).alias("zones"))


def common_neighbours(edges: DataFrame, nodes: DataFrame, cores: DataFrame) -> DataFrame:
    """``(core, a, b, c)``: the core's lowest neighbour, their lowest common neighbour, and the lowest common one of all three."""
    dens = nodes.select(F.col("id").alias("n"), "dens")
    near = edges.select(F.col("src").alias("core"), F.col("dst").alias("n"))

    def lowest(candidates: DataFrame, name: str) -> DataFrame:
        return candidates.join(dens, "n").groupBy("core").agg(F.min_by("n", F.struct("dens", "n")).alias(name))

    own = near.join(cores.select("core"), "core", "left_semi")
    first = lowest(own, "a")
    with_a = own.join(first, "core")
    both = with_a.join(edges.select(F.col("src").alias("a"), F.col("dst").alias("n")), ["a", "n"]).select("core", "n")
    second = lowest(both, "b")
    triple = both.join(second, "core").join(edges.select(F.col("src").alias("b"), F.col("dst").alias("n")), ["b", "n"]).select("core", "n")
    third = lowest(triple, "c")
    return cores.select("core").join(first, "core", "left").join(second, "core", "left").join(third, "core", "left")
