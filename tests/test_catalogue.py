"""Catalogue, mesh, graph and geometry operators: SQL equality on a small fixture, invariants and analytic cases."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeflow import params, registry
from latticeflow.functions import healpix, selection
from latticeflow.functions.cosmology import Cosmology
from latticeflow.operators import catalog, graph, halos, hulls, mesh, tessellation
from latticeflow.plans import cells, reconstruction, voxel
from latticeflow.sources import files

SMALL = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
SLOW = {"v5_g17_tessellation_checks"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(registry.ORACLES) - SLOW))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SMALL).toPandas()
    expected = duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    cols = sorted(got.columns)
    rows = lambda d: sorted(map(tuple, d[cols].astype(object).where(d[cols].notna(), None).to_numpy().tolist()), key=repr)
    a, b = rows(got), rows(expected)
    assert len(a) == len(b)
    assert [tuple(float(v) if isinstance(v, (int, float)) else v for v in r) for r in a] == [tuple(float(v) if isinstance(v, (int, float)) else v for v in r) for r in b]


def test_one_point_is_shared_by_eight_cells(spark):
    point = spark.createDataFrame([(1, 2.25, 3.5, 4.75, 1.0)], "id long, x double, y double, z double, w double")
    got = {r.vox: r.rho for r in mesh.deposit(point, 8, 8.0).collect()}
    assert sum(got.values()) == 1.0
    assert got[2 * 64 + 3 * 8 + 4] == 0.75 * 0.5 * 0.25
    assert got[3 * 64 + 4 * 8 + 5] == 0.25 * 0.5 * 0.75


def test_a_point_on_the_far_face_wraps(spark):
    point = spark.createDataFrame([(1, 8.0, 0.0, 0.0, 1.0)], "id long, x double, y double, z double, w double")
    assert {r.vox: r.rho for r in mesh.deposit(point, 8, 8.0).collect() if r.rho} == {0: 1.0}


def test_one_mode_has_one_displacement(spark):
    n, length, bias = 8, 16.0, 2.0
    k = 2 * math.pi / length
    rows = [(i * 64 + j * 8 + l, math.cos(k * i * length / n)) for i in range(n) for j in range(n) for l in range(n)]
    psi = mesh.displacement(spark.createDataFrame(rows, "vox long, delta double"), n, length, bias).collect()
    for r in psi:
        assert r.psi_x == pytest.approx(math.sin(k * (r.vox // 64) * length / n) / k / bias, abs=1e-9)
        assert abs(r.psi_y) < 1e-9 and abs(r.psi_z) < 1e-9


def test_reconstruction_equals_a_dense_solution(spark):
    rng = np.random.default_rng(3)
    n, length, radius, bias, growth = 8, 16.0, 2.0, 2.0, 0.78
    xyz = rng.random((200, 3)) * length
    frame = spark.createDataFrame([(i, *map(float, p), 1.0) for i, p in enumerate(xyz)], "id long, x double, y double, z double, w double")
    out = sorted(reconstruction.reconstruct(frame, reconstruction.Mesh(n, length), radius, bias, growth, rounds=2).select("id", "newz").collect())
    k = np.fft.fftfreq(n, length / n) * 2 * math.pi
    kx, ky, kz = np.meshgrid(k, k, k, indexing="ij")
    k2 = kx**2 + ky**2 + kz**2
    now = xyz.copy()
    for step in range(2):
        u = now / (length / n)
        i = np.floor(u).astype(int)
        d = u - i
        grid, corners = np.zeros((n, n, n)), []
        for o in np.ndindex(2, 2, 2):
            w = np.prod(np.where(np.array(o), d, 1 - d), axis=1)
            at = tuple(((i + np.array(o)) % n).T)
            corners.append((at, w))
            np.add.at(grid, at, w)
        delta = np.fft.fftn(np.fft.ifftn(np.fft.fftn(grid) * np.exp(-0.5 * k2 * radius**2)).real * n**3 / len(xyz) - 1)
        psi = np.fft.ifftn(np.where(k2 == 0, 0, -1j * kz * delta / bias / np.where(k2 == 0, 1, k2))).real
        shift = sum(psi[at] * w for at, w in corners)
        if step == 0:
            shift = shift * (1 - growth / bias / (1 + growth / bias))
        z = xyz[:, 2] + growth * shift
        now[:, 2] = np.where(z >= length, z - length, np.where(z < 0, z + length, z))
    assert np.allclose([r.newz for r in out], now[:, 2], atol=1e-9)


def test_two_basins_and_their_saddle(spark):
    dens = [5.0, 1.0, 4.0, 2.0, 6.0, 9.0]
    nodes = spark.createDataFrame(list(enumerate(dens)), "id long, dens double")
    pairs = [(i, (i + 1) % 6) for i in range(6)]
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src long, dst long")
    valued = graph.with_values(edges, nodes)
    zoned = graph.zones(graph.roots(graph.jumpers(nodes, valued)))
    assert {r.id: r.root for r in zoned.collect()} == {0: 1, 1: 1, 2: 1, 3: 3, 4: 3, 5: 1}
    assert {(r.h, r.h2): r.slv for r in graph.saddles(valued, zoned).collect()} == {(0, 1): 4.0, (1, 0): 4.0}


def test_every_cell_of_a_plateau_is_a_zone(spark):
    grid = mesh.all_voxels(spark, 3).withColumn("rho", F.lit(1.0))
    assert voxel.watershed(grid, 3).table.count() == 27


def test_flood_stops_at_deeper_cores():
    links = {0: [(2.0, 1)], 1: [(2.0, 0), (3.0, 2)], 2: [(3.0, 1)]}
    cores = {0: 0.5, 1: 1.0, 2: 0.1}
    assert graph.rise(0, links, cores, 9.0, 1e30) == ([{"ratio": 4.0, "zones": [1]}], 3.0, 6.0)
    assert graph.rise(1, links, cores, 9.0, 1e30) == ([], 2.0, 2.0)
    assert graph.rise(2, links, cores, 9.0, 1e30) == ([{"ratio": 30.0, "zones": [0, 1]}], 9.0, 90.0)


@pytest.mark.parametrize("periodic", [True, False])
def test_cells_fill_the_box_and_agree(spark, periodic):
    rng = np.random.default_rng(5)
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.random((300, 3)) * 10)], "id long, x double, y double, z double")
    done = tessellation.tessellate(points, 10.0, periodic).collect()
    assert sum(r.volume for r in done) == pytest.approx(300, rel=1e-9)
    near = {r.id: set(r.neighbours) for r in done}
    assert all(a in near[b] for a in near for b in near[a])
    if periodic:
        assert 15 < np.mean([len(v) for v in near.values()]) < 16.2


def test_lattice_cells_have_unit_volume(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i // 16 + 0.5 + 1e-4 * rng.random(), i // 4 % 4 + 0.5 + 1e-4 * rng.random(), i % 4 + 0.5 + 1e-4 * rng.random()) for i in range(64)]
    done = tessellation.tessellate(spark.createDataFrame(rows, "id long, x double, y double, z double"), 4.0).collect()
    assert all(r.volume == pytest.approx(1.0, abs=1e-3) for r in done)


def test_voids_of_a_small_box(spark):
    rng = np.random.default_rng(7)
    xyz = np.concatenate([rng.normal(5, 0.8, (150, 3)), rng.random((150, 3)) * 10]) % 10
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "id long, x double, y double, z double")
    found = cells.find_voids(points, 10.0).collect()
    assert found and all(r.extreme < 0 and r.ratio >= 1 and 0 <= r.x <= 10 for r in found)
    assert [r.extreme for r in found] == sorted(r.extreme for r in found)
    assert cells.find_voids(points, 10.0, barycentre=False).count() == len(found)
    assert all(r.extreme > 0 for r in cells.find_clusters(points, 10.0).collect())


def test_circumcentre_is_equidistant(spark):
    rows = [(1, 0.0, 0.0, 0.0), (2, 2.0, 0.0, 0.0), (3, 0.0, 2.0, 0.0), (4, 0.0, 0.0, 2.0)]
    nodes = spark.createDataFrame([(i, float(i)) for i, *_ in rows], "id long, dens double")
    edges = spark.createDataFrame([(a, b) for a in range(1, 5) for b in range(1, 5) if a != b], "src long, dst long")
    voids = spark.createDataFrame([(0, 1)], "h long, core long")
    got = cells.circumcentres(voids, nodes, edges, spark.createDataFrame(rows, "id long, x double, y double, z double"), 100.0).first()
    assert (got.x, got.y, got.z, got.status) == (1.0, 1.0, 1.0, "ok")


def test_unbinding_frees_the_fast():
    rng = np.random.default_rng(8)
    xyz = 5 + 0.05 * rng.normal(size=(60, 3))
    vel = 5.0 * rng.normal(size=(60, 3))
    vel[:5] += 20000.0
    alive, pot, energy, centroid = halos.bound(xyz, vel, np.ones(60, bool), xyz[10], halos.Units(16.0, 4))
    assert not alive[:5].any() and alive[5:].sum() > 40
    assert (energy[alive] <= 0).all() and (pot[alive] < 0).all()
    assert np.allclose(centroid, vel[alive].mean(0))
    assert not halos.bound(xyz[:1], vel[:1], np.ones(1, bool), xyz[0], halos.Units(16.0, 4))[0].any()


def test_hulls(spark):
    cube = hulls.Hull(np.array([[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)] + [[0.5, 0.5, 0.5]], float))
    assert (cube.area(), cube.volume()) == (pytest.approx(6), pytest.approx(1))
    assert 8 not in cube.vertices()
    rng = np.random.default_rng(9)
    for dim in (2, 3, 4):
        points = rng.normal(size=(60, dim))
        hull = hulls.Hull(points)
        for normal, offset in hull.facets.values():
            assert (points @ normal <= offset + 1e-9).all()
        assert all(len(v) == dim for v in hull.neighbours().values())
    flat = rng.random((80, 2))
    assert sorted(hulls.hull_2d(flat)) == hulls.Hull(flat).vertices()
    for s in hulls.delaunay(flat):
        centre = hulls.circumcentre(flat[list(s)])
        r = np.linalg.norm(flat[s[0]] - centre)
        assert (np.linalg.norm(flat - centre, axis=1) >= r - 1e-9).all()
    for s in hulls.delaunay(flat, furthest=True):
        centre = hulls.circumcentre(flat[list(s)])
        assert (np.linalg.norm(flat - centre, axis=1) <= np.linalg.norm(flat[s[0]] - centre) + 1e-9).all()
    box = hulls.halfspaces(np.vstack([np.eye(3), -np.eye(3)]), -np.ones(6), np.array([0.2, 0.1, 0.0]))
    assert {tuple(np.round(v, 9)) for v in box} == {(x, y, z) for x in (-1.0, 1.0) for y in (-1.0, 1.0) for z in (-1.0, 1.0)}
    ring = hulls.extreme_points_2d(spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(flat)], "grp long, id long, x double, y double")).collect()
    assert {r.id for r in ring} == set(hulls.hull_2d(flat))


@pytest.mark.parametrize("kind", ["cube", "cospherical", "disk", "lens", "spiral", "polygon", "simplex", "corners", "diamond", "mesh"])
def test_generators_repeat(spark, kind):
    a, b = (sorted(map(tuple, hulls.generated(spark, kind, 64, 3, seed=2, width=0.2 if kind != "cube" else 0.1).collect())) for _ in range(2))
    assert a == b and a
    if kind == "cospherical":
        assert all(abs(math.sqrt(sum(v * v for v in r[1:])) - 0.5) < 1e-9 for r in a)


def test_pixels(spark):
    for nside in (1, 2, 8):
        p = np.arange(healpix.pixels(nside))
        assert (healpix.nest_to_ring(healpix.ring_to_nest(p, nside), nside) == p).all()
        near = healpix.neighbours(p, nside)
        for i in p.tolist():
            own = near[i][near[i] >= 0]
            assert len(set(own.tolist())) == len(own) and all(i in near[j] for j in own)
    assert (healpix.neighbours(np.arange(768), 8) < 0).sum() == 24
    ra, dec = healpix.centre_of(F.col("id"), 32)
    back = spark.range(healpix.pixels(32)).select("id", ra.alias("ra"), dec.alias("dec")).select("id", healpix.pixel_of(F.col("ra"), F.col("dec"), 32).alias("p"))
    assert back.where("id <> p").count() == 0
    up = healpix.regraded(spark.createDataFrame([(5, 2.0), (6, 1.0)], "pix long, val double"), 2, 8)
    assert up.count() == 32
    down = {r.pix: r.val for r in healpix.regraded(up, 8, 2).collect()}
    assert down == {5: 2.0, 6: 1.0}


def test_boundary_leaves_a_gap(spark):
    mask = spark.createDataFrame([(300, 1.0)], "pix long, val double")
    got = {r.pix for r in healpix.boundary(mask, 8, rounds=3).collect()}
    touching = set(healpix.neighbours(np.array([300]), 8)[0].tolist())
    assert got and not got & touching and 300 not in got


def test_distances_clamp_and_invert(spark):
    c = Cosmology(0.31)
    rows = spark.createDataFrame([(0.0,), (0.5,), (3.999,), (4.0,), (7.0,), (None,)], "z double")
    got = rows.select("z", c.distance(F.col("z")).alias("r")).withColumn("back", c.redshift(F.col("r"))).collect()
    assert got[4].r == got[3].r == pytest.approx(c.r[-1])
    assert [r.back for r in got[:4]] == pytest.approx([0.0, 0.5, 3.999, 4.0])
    assert got[5].r is None or math.isnan(got[5].r)


def test_trim_keeps_bounds_only_when_nothing_is_outside(spark):
    inside = spark.createDataFrame([(1, 0.2), (2, 0.5), (3, 0.8)], "id long, redshift double")
    assert catalog.redshift_trim(inside, 0.2, 0.8).count() == 3
    assert catalog.redshift_trim(inside.unionByName(spark.createDataFrame([(4, 0.9)], "id long, redshift double")), 0.2, 0.8).count() == 1


def test_file_formats(spark, tmp_path):
    rng = np.random.default_rng(1)
    m = rng.random((20, 5))
    np.save(tmp_path / "a.npy", m)
    got = files.npy(spark, str(tmp_path / "a.npy"), ["a", "b", "c", "d", "e"]).toPandas()
    assert np.array_equal(got.to_numpy(), m)
    np.savetxt(tmp_path / "a.txt", m, header="numbers")
    assert np.allclose(files.text_matrix(spark, str(tmp_path / "a.txt"), ["a", "b", "c", "d", "e"]).toPandas().to_numpy(), m)
    (tmp_path / "a.fits").write_bytes(files.fits_bytes({"RA": m[:, 0], "DEC": m[:, 1], "Z": m[:, 2], "ID": np.arange(20)}))
    table = files.tracers(spark, str(tmp_path / "a.fits"), 1, box=False).toPandas()
    assert np.array_equal(table["redshift"], m[:, 2]) and (table["weight_cp"] == 1).all()
    frame = spark.createDataFrame([(i, *map(float, r[:3])) for i, r in enumerate(m)], "id long, x double, y double, z double")
    files.positions_file(frame, ["x", "y", "z"], str(tmp_path / "p.dat"))
    assert np.array_equal(files.blocks(spark, str(tmp_path / "p.dat"), ["x", "y", "z"]).orderBy("id").toPandas()[["x", "y", "z"]].to_numpy(), m[:, :3])
    edges = [(0, 1), (1, 2), (0, 3)]
    (tmp_path / "g.adj").write_bytes(files.adjacency_bytes(4, edges))
    assert {tuple(r) for r in files.adjacency(spark, str(tmp_path / "g.adj")).collect()} == {e for a, b in edges for e in ((a, b), (b, a))}
    m[:, 0].astype("<f4").tofile(tmp_path / "d.dat")
    assert files.density_grid(spark, str(tmp_path / "d.dat")).count() == 20
    tree = spark.createDataFrame([(3, [{"ratio": 1.5, "zones": [1, 2]}], 4.0), (4, [], 2.5)], "h long, groups array<struct<ratio: double, zones: array<long>>>, final_ratio double")
    text = files.hierarchy_text(tree)
    assert {r.value for r in text.collect()} == {"3 2 1.5 1 2 0 4.0", "4 0 2.5"}
    assert sorted(files.hierarchy_lines(text).collect()) == sorted(tree.collect())
    files.write_catalogue(frame.limit(3), ["id", "x"], str(tmp_path / "cat"), "voids")
    assert spark.read.text(str(tmp_path / "cat")).count() == 5
    names = files.positional(6, [0, 1, 2], False, {"fkp": True, "comp": True})
    assert names == ["ra", "dec", "redshift", "weight_fkp", "comp", "c5"]


def test_smoothing_keeps_cubics(spark):
    x = np.linspace(-1, 1, 300)
    y = 2 * x**3 - x + 0.5
    assert np.allclose(selection.local_polynomials(y), y)
    assert np.allclose(selection.linear(np.array([-1.0, 0.5, 3.0]), np.array([0.0, 1.0, 2.0]), np.array([0.0, 1.0, 3.0])), [-1.0, 0.5, 5.0])
    curve = selection.Selection([0.0, 1.0], [1.0, 2.0], 0.0, 1.0)
    got = spark.createDataFrame([(0.0,), (0.25,), (1.0,), (1.5,)], "z double").select(curve(F.col("z")).alias("f")).collect()
    assert [r.f for r in got] == pytest.approx([1.0, 1.25, 2.0, 2.5])


def test_parameters(tmp_path):
    path = tmp_path / "p.py"
    path.write_text("bias = 1.5\nis_box = True\nunrelated = 3\n")
    got = params.from_file(str(path))
    assert got.bias == 1.5 and got.is_box and got.nbins == 512
    assert params.Params(z_min=0.1, z_max=0.9).clamped().z_min == 0.4
    with pytest.raises(ValueError):
        params.from_dict({"nonsense": 1})
    params.save_state(str(tmp_path / "s.json"), {"n": 3})
    assert params.load_state(str(tmp_path / "s.json")) == {"n": 3}
