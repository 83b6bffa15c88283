"""Floods of any number of links, and the neighbour lists and lazy hierarchies they rest on, by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeflow.operators import graph, spatial
from latticeflow.plans import cells


@pytest.mark.parametrize("n, edges, levels, tolerance", [(60, 90, 12, 1e30), (60, 90, 12, 8.0), (200, 190, 500, 1e30), (5, 0, 1, 1e30)])
def test_a_flood_is_that_of_each_zone_without_a_broadcast(spark, monkeypatch, n, edges, levels, tolerance):
    rng = np.random.default_rng(n)
    core = rng.integers(1, max(2, n // 4), n).astype(float)  # many cores are equal
    pairs = {tuple(sorted(p)) for p in rng.integers(0, n, (edges, 2)).tolist() if p[0] != p[1]}
    rows = [(a, b, float(max(core[a], core[b]) + rng.integers(0, levels))) for a, b in sorted(pairs)]
    rows += [(b, a, v) for a, b, v in rows]
    ends = np.array([r[:2] for r in rows], np.int64).reshape(-1, 2)
    links, cores = graph.Links(ends[:, 0], ends[:, 1], np.array([r[2] for r in rows], float)), graph.Cores(np.arange(n), core)
    want = {h: graph.rise(h, links, cores, 99.0, tolerance) for h in range(n)}

    def none(*_):
        raise AssertionError("the zone graph went through the driver")

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", none)
    table, low = spark.createDataFrame(list(enumerate(core.tolist())), "h long, core_dens double"), spark.createDataFrame(rows, "h long, h2 long, slv double")
    for found in (graph.flood(table, low, 99.0, tolerance), graph.flood(table, low, 99.0, tolerance, block=4)):
        assert {r.h: ([{"ratio": g.ratio, "zones": list(g.zones)} for g in r.groups], r.leak, r.final_ratio) for r in found.collect()} == want


def test_zones_and_saddles_need_no_flood(spark, monkeypatch):
    def none(*_):
        raise AssertionError("flooded")

    monkeypatch.setattr(graph, "flood", none)
    nodes = spark.createDataFrame([(i, float(d), 1.0, False) for i, d in enumerate((5, 1, 4, 2, 6, 9))], "id long, dens double, vol double, is_edge boolean")
    pairs = [(i, (i + 1) % 6) for i in range(6)]
    tree = cells.basins(nodes, spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src long, dst long"))
    assert tree.zoned.count() == 6 and tree.links.count() == 2 and tree.table.count() == 2


@pytest.mark.parametrize("count, radius", [(1500, 1.1), (40, 7.0), (20, 9.0)])
def test_neighbour_lists_are_the_radius_graph(spark, count, radius):
    rng = np.random.default_rng(count)
    xyz = rng.integers(0, 16384, (count, 3)) / 1024
    xyz[:3] = xyz[3]  # points in one place
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "id long, x double, y double, z double")
    got = spatial.neighbour_lists(points, 16.0, radius)
    want = sorted(map(tuple, spatial.radius_graph(points, 16.0, radius).collect()))
    assert got.count() == count and sorted(map(tuple, got.select("id", F.explode("neighbours")).collect())) == want and want
