"""Cells of points that share places and planes, and cells that are done again."""

from __future__ import annotations

import numpy as np
import pytest

from pyspark.sql import functions as F

from latticeflow.operators import blocks, graph, tessellation
from latticeflow.plans import cells

SCHEMA = "id long, x double, y double, z double"


def _frame(spark, xyz):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], SCHEMA)


def test_points_in_one_place_have_the_whole_cell_each(spark):
    rng = np.random.default_rng(11)
    xyz = np.floor(rng.random((400, 3)) * 64) / 16
    xyz = np.concatenate([xyz, xyz[:40]])
    done = {r.id: r for r in tessellation.tessellate(_frame(spark, xyz), 4.0).collect()}
    assert sorted(done) == list(range(440))
    scale = 440 / 64
    _, first, many = np.unique(xyz, axis=0, return_index=True, return_counts=True)
    assert sum(done[int(i)].volume for i in first) / scale == pytest.approx(64, rel=1e-9)
    assert all(done[i].volume == pytest.approx(done[400 + i].volume, rel=1e-9) and set(done[i].neighbours) == set(done[400 + i].neighbours) for i in range(40))
    assert (many > 1).sum() >= 40


def test_cells_of_a_lattice_with_copies(spark):
    xyz = np.stack(np.meshgrid(*[np.arange(6) + 0.5] * 3, indexing="ij"), -1).reshape(-1, 3)
    xyz = np.concatenate([xyz, xyz[:3]])
    done = tessellation.tessellate(_frame(spark, xyz), 6.0).collect()
    assert all(r.volume == pytest.approx(219 / 216, rel=1e-9) and len(r.neighbours) == 6 for r in done)


@pytest.mark.parametrize("periodic", [True, False])
def test_cells_done_again_are_the_same(spark, periodic):
    rng = np.random.default_rng(12)
    points = _frame(spark, np.concatenate([rng.normal(5, 0.4, (300, 3)), rng.random((100, 3)) * 10]) % 10)
    whole = {r.id: r for r in tessellation.tessellate(points, 10.0, periodic, boxes=1, buffer=10.0).collect()}
    again = {r.id: r for r in tessellation.tessellate(points, 10.0, periodic, boxes=3, buffer=0.2).collect()}
    assert sorted(whole) == sorted(again) == list(range(400))
    assert all(whole[i].volume == pytest.approx(again[i].volume, rel=1e-9) and set(whole[i].neighbours) == set(again[i].neighbours) for i in whole)
    assert sum(r.volume for r in again.values()) == pytest.approx(400, rel=1e-9)


def _clustered(spark):
    rng = np.random.default_rng(13)
    xyz = np.concatenate([rng.normal(5, 0.8, (1500, 3)), rng.random((1500, 3)) * 10]) % 10
    return _frame(spark, np.concatenate([xyz, xyz[:5]]))


@pytest.mark.parametrize("blocks_", [1, 7, 40])
def test_a_watershed_by_blocks_is_that_of_the_edges(spark, blocks_):
    done = tessellation.tessellate(_clustered(spark), 10.0)
    nodes = done.select("id", (1 / F.col("volume")).alias("dens"), F.col("volume").alias("vol"), "neighbours", "x", "y", "z").cache()
    members, links = blocks.watershed(nodes, 10.0, blocks_)
    tree = cells.basins(nodes.select("id", "dens", "vol", F.lit(False).alias("is_edge")), tessellation.edges_of(done))
    assert sorted(members.select("id", "root", "zone").collect()) == sorted(tree.zoned.select("id", "root", "zone").collect())
    assert sorted(links.select("h", "h2", "slv").collect()) == sorted(tree.links.select("h", "h2", "slv").collect())
    groups = graph.unflooded(tree.table, tree.links, tree.max_dens)
    got, want = (sorted(graph.void_list(tree.table, g, 1.0, 5).collect()) for g in (groups, tree.groups))
    assert got == want and len(got) > 20


def test_voids_and_clusters_take_more_links_than_a_flood(spark, monkeypatch):
    monkeypatch.setattr(graph.flood, "__defaults__", (1e30, 3))
    points = _clustered(spark)
    assert cells.find_voids(points, 10.0).count() and cells.find_clusters(points, 10.0).count()
