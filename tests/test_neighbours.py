"""Range joins and floods: plans that keep rows off the driver, and the same results by brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeflow.operators import graph, spatial
from latticeflow.plans import cells


@pytest.mark.parametrize("length,radius", [(16.0, 0.5), (16.0, 2.0), (16.0, 2.6), (16.0, 4.5), (16.0, 7.0), (1.0, 0.125)])
def test_pairs_by_brute_force(spark, length, radius):
    rng = np.random.default_rng(7)
    xyz = np.concatenate([rng.uniform(0, length, (150, 3)), rng.integers(0, 9, (60, 3)) * length / 8])  # the far faces too
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "id long, x double, y double, z double")
    gap = np.abs(xyz[:, None] - xyz[None])
    d2 = ((gap - np.where(gap > length / 2, length, 0.0)) ** 2).sum(2)
    want = sorted(map(tuple, np.argwhere(d2 < radius * radius).tolist()))
    assert sorted((r.a, r.b) for r in spatial.pairs_within(points, points, length, radius).collect()) == want


def test_copies_of_points_are_not_broadcast(spark):
    points = spark.range(1000).select("id", *((F.col("id") % k).cast("double").alias(a) for a, k in zip("xyz", (16, 15, 13))))
    plan = spatial.radius_graph(points, 16.0, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_circumcentres_stay_within_compiled_code(spark):
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(itertools.product((1, 15), repeat=3))], "id long, x double, y double, z double")
    nodes = points.select("id", F.col("id").cast("double").alias("dens"))
    edges = nodes.select(F.col("id").alias("src")).crossJoin(nodes.select(F.col("id").alias("dst"))).where("src <> dst")
    found = cells.circumcentres(nodes.select(F.col("id").alias("h"), F.col("id").alias("core")), nodes, edges, points, 16.0)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    assert {r.status for r in found.collect()} == {"ok"}


def test_links_in_arrays():
    links = graph.Links(np.array([5, 0, 0, 5, 2]), np.array([2, 5, 1, 0, 5]), np.array([3.0, 2.0, 2.0, 1.0, 4.0]))
    assert links.get(0) == [(2.0, 1), (2.0, 5)] and links.get(5) == [(1.0, 0), (3.0, 2)] and links.get(1) == () and links.get(9, []) == []
    cores = graph.Cores(np.array([5, 0, 2]), np.array([0.5, 1.5, 2.5]))
    assert [cores[h] for h in (0, 2, 5)] == [1.5, 2.5, 0.5]
    assert graph.Links(*(np.zeros(0, t) for t in (int, int, float))).get(0) == ()
