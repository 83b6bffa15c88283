"""Voronoi cells and Delaunay neighbours of periodic or isolated point sets.

Points are dealt to sub-boxes, with every periodic image that falls into a sub-box's buffer
as a ghost.  A cell starts as a box and is clipped by the bisectors of its neighbours, from
the nearest outward, until the next is farther than twice its farthest vertex: nothing
beyond can cut it.  All cells of a sub-box are clipped together, the j-th neighbour of each
in one step over padded arrays.  Faces and volumes come from the same polyhedra.  Cells that
the buffer does not reach far enough for are done again, and only those, each among the points
within twice its reach, or within a growing margin where that is farther; nothing is left open.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOX_POINTS = 512
CHUNK = 512  # cells clipped together
NEAREST = 96  # neighbours sorted at first
PART = 50_000  # points of a task, if that gives every core some
ROWS = 1 << 17  # places for neighbours, of cells that are done singly, at once
DENSE = 1 << 23  # places of a table of plane pairs; more are looked up by sorting
FLAT = 1e-12  # faces below this share of the cell's reach squared are rounding, not faces


def clipped(rel: np.ndarray, d2: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells around the origin, one a row, cut by the bisectors of their neighbours in turn.

    ``rel`` has each cell's neighbours, nearest first, ``d2`` their distances squared (infinite
    behind the last), ``room`` the distances to the six planes the cell starts with (+x, -x, +y,
    -y, +z, -z).  Returns volumes, reaches squared, the faces that have an area as ``(cell,
    neighbour)``, and which cells neighbours beyond those given might still cut.

    A vertex lies on three planes in dual orientation: 0 to 5 are the first ones, ``6 + j`` the
    bisector of neighbour ``j``.  Free places hold the origin, which no plane cuts off.
    """
    m, k = d2.shape
    planes = k + 6
    normals, offsets = np.empty((m, planes, 3)), np.empty((m, planes))
    normals[:, :6] = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    normals[:, 6:], offsets[:, :6], offsets[:, 6:] = rel, room, d2 / 2
    flat, away = normals.reshape(-1, 3), offsets.reshape(-1)
    along, dist = np.ascontiguousarray(rel.transpose(1, 2, 0)), np.ascontiguousarray(d2.T)
    spots, tri = np.zeros((4, m, 32)), np.full((m, 32, 3), -1, np.int32)  # x, y, z and distance squared
    at = 0
    for sx, a in ((1, 0), (-1, 1)):
        for sy, b in ((1, 2), (-1, 3)):
            for sz, c in ((1, 4), (-1, 5)):
                spots[:3, :, at] = sx * room[:, a], sy * room[:, b], sz * room[:, c]
                tri[:, at] = (a, b, c) if sx * sy * sz > 0 else (a, c, b)
                at += 1
    spots[3] = (spots[:3] ** 2).sum(0)
    rows, used, far = np.arange(m), np.full(m, 8), spots[3].max(1)
    reach, pending, done = np.zeros(m), np.zeros(m, bool), []

    def finish(which: np.ndarray) -> None:
        cell, v = np.nonzero(tri[which, :, 0] >= 0)
        cell = which[cell]
        reach[rows[which]] = far[which]
        done.append((rows[cell], tri[cell, v].astype(np.int64), spots[:3, cell, v]))

    for j in range(k):
        active = dist[j, rows] <= 4 * far
        many = int(np.count_nonzero(active))
        if many < 0.75 * len(rows) or not many:
            finish(np.flatnonzero(~active))
            rows, used, far, spots, tri, active = rows[active], used[active], far[active], spots[:, active], tri[active], active[active]
            if not many:
                break
        width = int(used.max())
        nx, ny, nz = along[j][:, rows]
        beyond = spots[0, :, :width] * nx[:, None]
        beyond += spots[1, :, :width] * ny[:, None]
        beyond += spots[2, :, :width] * nz[:, None]
        near = np.where(active, dist[j, rows], np.inf)
        at, v = np.nonzero(beyond > (near / 2 + FLAT * np.sqrt(near * far))[:, None])  # a vertex on the plane stays
        if not len(at):
            continue
        lost = np.bincount(at, minlength=len(rows))
        cut = np.flatnonzero(lost)
        seen = np.cumsum(lost > 0) - 1
        corner = tri[at, v].astype(np.int64)
        a, b, of = corner.reshape(-1), corner[:, [1, 2, 0]].reshape(-1), np.repeat(at, 3)
        known = j + 6
        base = seen[of] * known
        there, back = (base + a) * known + b, (base + b) * known + a
        if len(cut) * known * known <= DENSE:
            table = np.zeros(len(cut) * known * known, bool)
            table[there] = True
            edge = ~table[back]  # an edge between two lost vertices is seen from both
        else:
            edge = ~np.isin(there, back)
        of, a, b, left = of[edge], a[edge], b[edge], np.repeat(np.arange(len(at)), 3)[edge]
        first = rows[of] * planes
        n1, n2, n3 = flat[first + a].T, flat[first + b].T, flat[first + known].T
        d1, d2_, d3 = away[first + a], away[first + b], away[first + known]
        c12, c23, c31 = _cross(n1, n2), _cross(n2, n3), _cross(n3, n1)
        det = c12[0] * n3[0] + c12[1] * n3[1] + c12[2] * n3[2]
        new = np.stack([d1 * c23[axis] + d2_ * c31[axis] + d3 * c12[axis] for axis in range(3)])
        with np.errstate(all="ignore"):
            new /= det
            astray = ~((new**2).sum(0) <= far[of] * (1 + 1e-9))
        if astray.any():  # an edge in the plane, but for rounding: its lost end is on the plane, too
            new[:, astray] = spots[:3, at[left[astray]], v[left[astray]]]
        gained = np.bincount(of, minlength=len(rows))
        rank = np.arange(len(of)) - (np.cumsum(gained) - gained)[of]
        taken = (np.cumsum(lost) - lost)[of]
        again = rank < lost[of]
        slot = np.where(again, v[np.minimum(taken + rank, len(v) - 1)], used[of] + rank - lost[of])
        used = used + np.maximum(gained - lost, 0)
        more = int(used.max()) - tri.shape[1]
        if more > 0:
            spots = np.pad(spots, ((0, 0), (0, 0), (0, more + 8)))
            tri = np.pad(tri, ((0, 0), (0, more + 8), (0, 0)), constant_values=-1)
        spots[:, at, v] = 0
        tri[at, v] = -1
        spots[:3, of, slot] = new
        spots[3, of, slot] = (new**2).sum(0)
        tri[of, slot] = np.stack([a, b, np.full(len(a), known)], 1)
        far[cut] = spots[3, cut].max(1)
    else:
        if k:
            pending[rows[dist[-1, rows] <= 4 * far]] = True
        finish(np.arange(len(rows)))
    cell, corner, points = (np.concatenate([d[i] for d in done], axis=1 if i == 2 else 0) for i in range(3))
    volume, of, plane = _measured(cell, corner, points, m, planes, flat, away, reach)
    seen = plane >= 6
    return volume, reach, of[seen], plane[seen] - 6, pending


def _cross(a, b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _measured(cell, corner, points, m: int, planes: int, flat, away, reach) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Volume of each cell, and the faces that have an area: ``(cell, plane)``.

    In the face of plane p a vertex on (p, q, r) is followed by the one on (p, r, s).
    """
    p, q, r = corner.reshape(-1), corner[:, [1, 2, 0]].reshape(-1), corner[:, [2, 0, 1]].reshape(-1)
    own = np.repeat(np.arange(len(cell)), 3)
    face = np.repeat(cell, 3) * planes + p
    there, seek = face * planes + q, face * planes + r
    if m * planes * planes <= DENSE:
        table = np.full(m * planes * planes, -1, np.int32)
        table[there] = own
        onward = table[seek]
        found = onward >= 0
    else:
        order = np.argsort(there, kind="stable")
        at = np.minimum(np.searchsorted(there[order], seek), len(there) - 1)
        onward = own[order[at]]
        found = there[order[at]] == seek
    part = _cross(points[:, own], points[:, onward])
    area2 = sum(np.bincount(face, np.where(found, x, 0.0) / 2, m * planes) ** 2 for x in part)
    faces = np.flatnonzero(area2)
    area, of = np.sqrt(area2[faces]), faces // planes
    volume = np.bincount(of, area * away[faces] / np.sqrt((flat[faces] ** 2).sum(1)) / 3, m)
    real = area > FLAT * reach[of]
    return volume, of[real], faces[real] % planes


def carved(xyz: np.ndarray, own: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the points ``own`` of ``xyz`` among all of them: volumes, reaches squared and neighbours ``(cell, index in xyz)``.

    Of points in one place the first is everyone's neighbour, and each has the whole cell.
    """
    m, points = len(own), xyz[own]
    order = np.lexsort(xyz.T[::-1])
    other = np.ones(len(xyz), bool)
    other[1:] = (xyz[order[1:]] != xyz[order[:-1]]).any(1)
    firsts, place = order[other], np.empty(len(xyz), np.int64)
    place[order] = np.cumsum(other) - 1
    xyz, own = xyz[firsts], place[own]
    middle = xyz.mean(0)
    others, mine = xyz - middle, points - middle
    gap = (others**2).sum(1)[None, :] - 2 * (mine @ others.T)  # but for the point's own length, which orders nothing
    gap[np.arange(m), own] = np.inf
    volumes, reaches, owners, near = np.zeros(m), np.zeros(m), [], []
    todo, k = np.arange(m), NEAREST
    while len(todo):
        k = min(k, len(xyz) - 1)
        part = np.argpartition(gap[todo], max(k - 1, 0), axis=1)[:, :k]
        rel = xyz[part] - points[todo][:, None, :]
        d2 = (rel * rel).sum(2)
        order = np.lexsort((part, d2), axis=1)
        part, d2, rel = np.take_along_axis(part, order, 1), np.take_along_axis(d2, order, 1), np.take_along_axis(rel, order[:, :, None], 1)
        volume, reach, of, j, open_ = clipped(rel, d2, room[todo])
        if k == len(xyz) - 1:
            open_[:] = False
        volumes[todo[~open_]], reaches[todo[~open_]] = volume[~open_], reach[~open_]
        seen = ~open_[of]
        owners.append(todo[of[seen]])
        near.append(firsts[part[of[seen], j[seen]]])
        todo, k = todo[open_], 4 * k
    return volumes, reaches, np.concatenate(owners or [np.empty(0, np.int64)]), np.concatenate(near or [np.empty(0, np.int64)])


def ghosts(points: DataFrame, length: float, n: int, buffer: float, periodic: bool = True) -> DataFrame:
    """``(box, id, x, y, z, own)``: each point in its sub-box, and as ghosts in those whose buffer it lies in.

    An image is generated for every sub-box it can reach; none is looked for by joining.
    """
    width = length / n
    out = points.select("id", "x", "y", "z")
    reach = int(math.ceil(buffer / width))
    for axis in "xyz":
        own = F.least(F.greatest(F.floor(F.col(axis) / width).cast("int"), F.lit(0)), F.lit(n - 1))
        out = out.withColumn(f"__o{axis}", own)
        spread = F.explode(F.sequence(F.col(f"__o{axis}") - reach, F.col(f"__o{axis}") + reach))
        out = out.withColumn(f"__c{axis}", spread)
        shift = F.floor(F.col(f"__c{axis}") / n) * length
        out = out.withColumn(f"__i{axis}", F.col(axis) - shift).withColumn(f"__b{axis}", F.pmod(F.col(f"__c{axis}"), F.lit(n)))
        inside = (F.col(f"__i{axis}") >= F.col(f"__b{axis}") * width - buffer) & (F.col(f"__i{axis}") <= (F.col(f"__b{axis}") + 1) * width + buffer)
        out = out.where(inside if periodic else inside & (F.col(f"__c{axis}") >= 0) & (F.col(f"__c{axis}") < n))
    same = F.lit(True)
    for axis in "xyz":
        same = same & (F.col(f"__c{axis}") == F.col(f"__o{axis}"))
    box = (F.col("__bx") * n + F.col("__by")) * n + F.col("__bz")
    return out.select(box.cast("long").alias("box"), "id", F.col("__ix").alias("x"), F.col("__iy").alias("y"), F.col("__iz").alias("z"), same.alias("own"))


#: Cells as the kernels give them; those that points unseen might still cut are not closed, and then have their reach.
FOUND = "id long, volume double, neighbours array<long>, closed boolean, reach double, x double, y double, z double"


def _found(ids: np.ndarray, at: np.ndarray, volume: np.ndarray, reach: np.ndarray, closed: np.ndarray, of: np.ndarray, near: np.ndarray) -> pa.Table:
    """Rows of ``FOUND``; ``(of, near)`` are places in ``ids`` and ids of neighbours, images of one point once and a cell's own ones never."""
    order = np.lexsort((near, of))
    of, near = of[order], near[order]
    first = np.ones(len(of), bool)
    first[1:] = (of[1:] != of[:-1]) | (near[1:] != near[:-1])
    first &= near != ids[of]
    of, near = of[first], near[first]
    bounds = np.searchsorted(of, np.arange(len(ids) + 1)).astype(np.int32)
    around = pa.ListArray.from_arrays(pa.array(bounds), pa.array(near, pa.int64()))
    place = [pa.array(np.sqrt(reach), pa.float64(), mask=closed), *(pa.array(at[:, a], pa.float64()) for a in range(3))]
    return pa.table([pa.array(ids, pa.int64()), pa.array(volume, pa.float64()), around, pa.array(closed), *place], names=["id", "volume", "neighbours", "closed", "reach", "x", "y", "z"])


def _room(at: np.ndarray, length: float, periodic: bool) -> np.ndarray:
    """Distances to the six planes that cells at ``at`` start with."""
    return np.full((len(at), 6), length / 2) if periodic else np.stack([side for a in range(3) for side in (length - at[:, a], at[:, a])], 1)


def _around(points: DataFrame, wanted: DataFrame, length: float, n: int, periodic: bool) -> DataFrame:
    """``(id, x, y, z, radius, other, dx, dy, dz, d2)``: points and images within ``radius`` of each row of ``wanted``.

    Within a radius of ``length``: along each axis.  The row's own place is among them.
    """
    width = length / n
    reached = wanted
    for axis in "xyz":
        low, high = (F.floor((F.col(axis) + sign * F.col("radius") * (1 + 1e-9)) / width) for sign in (-1, 1))
        if not periodic:
            low, high = F.least(F.greatest(low, F.lit(0)), F.lit(n - 1)), F.greatest(F.least(high, F.lit(n - 1)), F.lit(0))
        reached = reached.withColumn(f"__c{axis}", F.explode(F.sequence(low, high)))
    box, own = F.lit(0), F.lit(0)
    for axis in "xyz":
        box = box * n + F.pmod(F.col(f"__c{axis}"), F.lit(n))
        own = own * n + F.least(F.greatest(F.floor(F.col(f"o{axis}") / width), F.lit(0)), F.lit(n - 1))
    reached = reached.withColumn("box", box.cast("long"))
    others = points.select(F.col("id").alias("other"), *(F.col(c).alias(f"o{c}") for c in "xyz")).withColumn("box", own.cast("long"))
    met = others.join(reached.hint("merge"), "box")
    for axis in "xyz":
        met = met.withColumn(f"d{axis}", F.col(f"o{axis}") + F.floor(F.col(f"__c{axis}") / n) * length - F.col(axis))
        met = met.where(F.abs(f"d{axis}") <= F.col("radius"))
    met = met.withColumn("d2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    met = met.where((F.col("radius") >= length) | (F.col("d2") <= F.col("radius") * F.col("radius")))
    return met.select("id", "x", "y", "z", "radius", "other", "dx", "dy", "dz", "d2")


def _singly(length: float, periodic: bool):
    """Cells from streams of rows of :func:`_around`, those of a cell together and nearest first."""

    def of(cells: list[np.ndarray]) -> pa.Table:
        longest = max(len(c) for c in cells)
        rel, d2, other = np.zeros((len(cells), longest, 3)), np.full((len(cells), longest), np.inf), np.zeros((len(cells), longest), np.int64)
        for i, c in enumerate(cells):
            place = np.stack([c["dx"], c["dy"], c["dz"]], 1)
            kept = c["d2"] > 0
            kept[1:] &= (place[1:] != place[:-1]).any(1)  # of points in one place the first
            place, c = place[kept], c[kept]
            rel[i, : len(c)], d2[i, : len(c)], other[i, : len(c)] = place, c["d2"], c["other"]
        ids, at, radius = np.array([c["id"][0] for c in cells]), np.array([[c[a][0] for a in "xyz"] for c in cells]), np.array([c["radius"][0] for c in cells])
        volume, reach, cell, j, _ = clipped(rel, d2, _room(at, length, periodic))
        return _found(ids, at, volume, reach, (4 * reach <= radius**2) | (radius >= length), cell, other[cell, j])

    def run(batches):
        cells, rows, held = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            frame = np.rec.fromarrays([c.to_numpy(zero_copy_only=False) for c in batch.columns], names=list(batch.schema.names))
            frame = frame if held is None else np.concatenate([held, frame])
            heads = np.concatenate([[0], np.flatnonzero(frame["id"][1:] != frame["id"][:-1]) + 1])
            for s, e in zip(heads[:-1].tolist(), heads[1:].tolist()):
                if cells and (len(cells) + 1) * max(rows, e - s) > ROWS:
                    yield from of(cells).to_batches()
                    cells, rows = [], 0
                cells.append(frame[s:e])
                rows = max(rows, e - s)
            held = frame[heads[-1] :]
        if held is not None:
            cells.append(held)
        if cells:
            yield from of(cells).to_batches()

    return run


def tessellate(points: DataFrame, length: float, periodic: bool = True, boxes: int | None = None, buffer: float | None = None) -> DataFrame:
    """``(id, volume, neighbours, x, y, z)``: Voronoi volumes in units of the mean, Delaunay neighbours and the points' places.

    Isolated sets are bounded by the box; points at its faces have cells cut by it.
    """
    from latticeflow.operators.stage import kept

    count = points.count()
    n = boxes or max(1, int((count / BOX_POINTS) ** (1.0 / 3)))
    width = length / n
    spacing = length / max(1.0, count ** (1.0 / 3))
    margin = min(buffer if buffer is not None else 3.0 * spacing, length)
    scale = count / length**3

    def of_box(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("id", "x", "y", "z")])
        xyz, ids = np.stack([table[c].to_numpy() for c in "xyz"], 1), table["id"].to_numpy()
        own = np.flatnonzero(table["own"].to_numpy())
        box = table["box"][0].as_py()
        corner = np.array([box // (n * n), box // n % n, box % n])
        low = corner * width
        out = []
        for s in range(0, len(own), CHUNK):
            mine = own[s : s + CHUNK]
            at = xyz[mine]
            volume, reach, of, near = carved(xyz, mine, _room(at, length, periodic))
            below, above = at - low, low + width - at
            if not periodic:  # nothing lies beyond the box
                below, above = np.where(corner == 0, np.inf, below), np.where(corner == n - 1, np.inf, above)
            known = margin + np.minimum(below, above).min(1)
            out.append(_found(ids[mine], at, volume, reach, (4 * reach <= known**2) | (margin >= length), of, ids[near]))
        return pa.concat_tables(out) if out else _found(ids[:0], xyz[:0], *(np.empty(0) for _ in range(2)), np.empty(0, bool), *(np.empty(0, np.int64) for _ in range(2)))

    done, parts = None, 1 + max(count // PART, min(count // BOX_POINTS, 2 * points.sparkSession.sparkContext.defaultParallelism))
    points = points.select("id", "x", "y", "z").repartition(parts, "id")  # ghosts are many times what a file's one task reads
    found = kept(ghosts(points, length, n, margin, periodic).repartition(parts, "box").groupBy("box").applyInArrow(of_box, FOUND))
    while True:
        closed = found.where("closed").select("id", (F.col("volume") * scale).alias("volume"), "neighbours", "x", "y", "z")
        done = closed if done is None else done.unionByName(closed)
        wanted = found.where("not closed").select("id", "x", "y", "z", "reach")
        if not wanted.limit(1).count():
            return done
        # a cell that is too large as yet is cut by nothing beyond twice its reach
        margin = min(2 * margin, length)
        wanted = wanted.withColumn("radius", F.least(2 * (1 + 1e-9) * F.col("reach"), F.lit(margin))).drop("reach")
        met = _around(points, wanted, length, n, periodic).repartition("id").sortWithinPartitions("id", "d2", "dx", "dy", "dz", "other")
        found = kept(met.mapInArrow(_singly(length, periodic), FOUND))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def edges_of(cells: DataFrame) -> DataFrame:
    """Symmetric ``(src, dst)``; a face seen from one side only (rounding) counts for both."""
    return symmetric(cells.select(F.col("id").alias("src"), F.explode("neighbours").alias("dst")))


def real_edges(edges: DataFrame, particles: DataFrame) -> DataFrame:
    """Edges between particles that are no mocks."""
    real = particles.where("not is_mock").select("id")
    one = edges.join(real.withColumnRenamed("id", "src"), "src", "left_semi")
    return one.join(real.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def checks(cells: DataFrame) -> DataFrame:
    """``(n, mean_neighbours, mean_volume)``; a Poisson process has 48 pi**2 / 35 + 2 neighbours."""
    return cells.agg(F.count("*").alias("n"), F.avg(F.size("neighbours")).alias("mean_neighbours"), F.avg("volume").alias("mean_volume"))
