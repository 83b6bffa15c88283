"""Convex hulls, half-space intersections and point generators, a group at a time."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hull_2d(xy: np.ndarray) -> list[int]:
    """Extreme points in counter-clockwise order, by monotone chains."""
    order = np.lexsort((xy[:, 1], xy[:, 0])).tolist()

    def turn(o: int, a: int, b: int) -> float:
        return (xy[a, 0] - xy[o, 0]) * (xy[b, 1] - xy[o, 1]) - (xy[a, 1] - xy[o, 1]) * (xy[b, 0] - xy[o, 0])

    def chain(points: list[int]) -> list[int]:
        out: list[int] = []
        for p in points:
            if out and (xy[p] == xy[out[-1]]).all():
                continue
            while len(out) > 1 and turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out

    lower, upper = chain(order), chain(order[::-1])
    return lower[:-1] + upper[:-1] if len(lower) > 1 else lower[:1]


class Hull:
    """A convex hull in any dimension, one point at a time (beneath-beyond with visible-facet sets).

    Facets are simplices; points within ``eps`` of a facet are on it.  Points that lie in a
    space of lower dimension (or too few of them) have no facets.
    """

    def __init__(self, points: np.ndarray, eps: float = 1e-10):
        self.points = np.asarray(points, float)
        n, self.dim = self.points.shape
        scale = float(np.abs(self.points).max()) if n else 1.0
        self.eps = eps * max(scale, 1e-300)
        self.facets: dict[tuple[int, ...], tuple[np.ndarray, float]] = {}
        self.corners: list[tuple[int, ...]] = []
        self.normals, self.offsets, self.alive = np.zeros((0, self.dim)), np.zeros(0), np.zeros(0, bool)
        start = self._simplex() if n else []
        if not start:
            self.centre = np.zeros(self.dim)
            return
        self.centre = self.points[start].mean(0)
        self._add([tuple(sorted(set(start) - {i})) for i in start])
        rest = np.argsort(-((self.points - self.centre) ** 2).sum(1), kind="stable")
        rest = rest[~np.isin(rest, start)]
        step = 8
        while len(rest):  # a few points, and then a look at which others are still outside
            for p in rest[:step].tolist():
                self._insert(p)
            rest = rest[step:]
            rest = rest[self._outside(rest)]
            step = min(2 * step, 64)
        alive = np.flatnonzero(self.alive)
        self.facets = {self.corners[i]: (self.normals[i], float(self.offsets[i])) for i in alive.tolist()}

    def _simplex(self) -> list[int]:
        chosen = [int(np.lexsort(self.points.T[::-1])[0])]
        basis = np.zeros((0, self.dim))
        for _ in range(self.dim):
            rel = self.points - self.points[chosen[0]]
            rel = rel - rel @ basis.T @ basis
            d2 = (rel * rel).sum(1)
            k = int(np.argmax(d2))
            if d2[k] <= self.eps**2:
                return []
            chosen.append(k)
            basis = np.vstack([basis, rel[k] / math.sqrt(d2[k])])
        return chosen

    def _add(self, corners: list[tuple[int, ...]]) -> None:
        """New facets, all at once."""
        v = self.points[np.array(corners)]
        normals = np.linalg.svd(v[:, 1:] - v[:, :1])[2][:, -1]
        offsets = (normals * v[:, 0]).sum(1)
        turn = np.where(normals @ self.centre > offsets, -1.0, 1.0)
        self.corners += corners
        self.normals = np.concatenate([self.normals, normals * turn[:, None]])
        self.offsets = np.concatenate([self.offsets, offsets * turn])
        self.alive = np.concatenate([self.alive, np.ones(len(corners), bool)])

    def _outside(self, rows: np.ndarray) -> np.ndarray:
        """Which points lie beyond some facet, a slice of them at a time."""
        alive = np.flatnonzero(self.alive)
        normals, limit = self.normals[alive], self.offsets[alive] + self.eps
        size = max(1, (1 << 22) // max(1, len(alive)))
        return np.concatenate([(self.points[rows[s : s + size]] @ normals.T > limit).any(1) for s in range(0, len(rows), size)] or [np.zeros(0, bool)])

    def _insert(self, p: int) -> None:
        seen = np.flatnonzero(self.alive & (self.normals @ self.points[p] > self.offsets + self.eps))
        if not len(seen):
            return
        ridges: dict[tuple[int, ...], int] = {}
        for i in seen.tolist():
            own = self.corners[i]
            for k in range(len(own)):
                r = own[:k] + own[k + 1 :]
                ridges[r] = ridges.get(r, 0) + 1
        self.alive[seen] = False
        self._add([tuple(sorted((*r, p))) for r, times in ridges.items() if times == 1])
        if 2 * int(self.alive.sum()) < len(self.alive) - 256:  # lost facets go
            kept = np.flatnonzero(self.alive)
            self.corners = [self.corners[i] for i in kept.tolist()]
            self.normals, self.offsets, self.alive = self.normals[kept], self.offsets[kept], self.alive[kept]

    def vertices(self) -> list[int]:
        return sorted({c for f in self.facets for c in f})

    def neighbours(self) -> dict[tuple[int, ...], list[tuple[int, ...]]]:
        """Facets that share a ridge."""
        by_ridge: dict[tuple[int, ...], list[tuple[int, ...]]] = {}
        for f in self.facets:
            for c in f:
                by_ridge.setdefault(tuple(q for q in f if q != c), []).append(f)
        out: dict[tuple[int, ...], list[tuple[int, ...]]] = {f: [] for f in self.facets}
        for pair in by_ridge.values():
            if len(pair) == 2:
                out[pair[0]].append(pair[1])
                out[pair[1]].append(pair[0])
        return out

    def facet_area(self, corners: tuple[int, ...]) -> float:
        v = self.points[list(corners)]
        e = v[1:] - v[0]
        return math.sqrt(max(0.0, float(np.linalg.det(e @ e.T)))) / math.factorial(self.dim - 1)

    def area(self) -> float:
        return sum(self.facet_area(f) for f in self.facets)

    def volume(self) -> float:
        return sum(self.facet_area(f) * (d - float(n @ self.centre)) / self.dim for f, (n, d) in self.facets.items())


def _turn(ax: float, ay: float, bx: float, by: float, cx: float, cy: float) -> float:
    """Above 0 if ``c`` lies left of ``a`` to ``b``; the sign is exact."""
    left, right = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
    det = left - right
    if abs(det) > 4e-16 * (abs(left) + abs(right)):
        return det
    ax, ay, bx, by, cx, cy = map(Fraction, (ax, ay, bx, by, cx, cy))
    det = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (det > 0) - (det < 0)


def _in_circle(ax: float, ay: float, bx: float, by: float, cx: float, cy: float, dx: float, dy: float) -> bool:
    """Whether ``d`` lies inside the circle through ``a``, ``b`` and ``c`` (anticlockwise); exact."""
    ux, uy, vx, vy, wx, wy = ax - dx, ay - dy, bx - dx, by - dy, cx - dx, cy - dy
    u, v, w = ux * ux + uy * uy, vx * vx + vy * vy, wx * wx + wy * wy
    p1, p2, q1, q2, r1, r2 = vx * wy, wx * vy, wx * uy, ux * wy, ux * vy, vx * uy
    det = u * (p1 - p2) + v * (q1 - q2) + w * (r1 - r2)
    if abs(det) > 2e-15 * (u * (abs(p1) + abs(p2)) + v * (abs(q1) + abs(q2)) + w * (abs(r1) + abs(r2))):
        return det > 0
    ax, ay, bx, by, cx, cy, dx, dy = map(Fraction, (ax, ay, bx, by, cx, cy, dx, dy))
    ux, uy, vx, vy, wx, wy = ax - dx, ay - dy, bx - dx, by - dy, cx - dx, cy - dy
    u, v, w = ux * ux + uy * uy, vx * vx + vy * vy, wx * wx + wy * wy
    return u * (vx * wy - wx * vy) + v * (wx * uy - ux * wy) + w * (ux * vy - vx * uy) > 0


def delaunay_2d(xy: np.ndarray) -> np.ndarray:
    """Triangles of a plane Delaunay triangulation by divide and conquer, as sorted rows of indices.

    Directed edges are numbers, ``e ^ 1`` the other way; around an origin they form a ring
    anticlockwise (``after``, ``before``).  Of points at one place the first stands for all.
    """
    order = np.lexsort((np.arange(len(xy)), xy[:, 1], xy[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (xy[order[1:]] != xy[order[:-1]]).any(1)
    order = order[new]
    if len(order) < 3:
        return np.zeros((0, 3), np.int64)
    xs, ys = xy[order, 0].tolist(), xy[order, 1].tolist()
    org: list[int] = []
    after: list[int] = []
    before: list[int] = []
    lost = bytearray()

    def edge(a: int, b: int) -> int:
        e = len(org)
        org.extend((a, b))
        after.extend((e, e + 1))
        before.extend((e, e + 1))
        lost.extend((0, 0))
        return e

    def splice(a: int, b: int) -> None:
        an, bn = after[a], after[b]
        after[a], after[b] = bn, an
        before[an], before[bn] = b, a

    def connect(a: int, b: int) -> int:
        e = edge(org[a ^ 1], org[b])
        splice(e, before[a ^ 1])
        splice(e ^ 1, b)
        return e

    def remove(e: int) -> None:
        splice(e, before[e])
        splice(e ^ 1, before[e ^ 1])
        lost[e] = lost[e ^ 1] = 1

    def turn(a: int, b: int, c: int) -> float:
        return _turn(xs[a], ys[a], xs[b], ys[b], xs[c], ys[c])

    def inside(a: int, b: int, c: int, d: int) -> bool:
        return _in_circle(xs[a], ys[a], xs[b], ys[b], xs[c], ys[c], xs[d], ys[d])

    def part(low: int, high: int) -> tuple[int, int]:
        """Hull edges out of the first point (anticlockwise) and of the last (clockwise)."""
        if high - low == 2:
            a = edge(low, low + 1)
            return a, a ^ 1
        if high - low == 3:
            a, b = edge(low, low + 1), edge(low + 1, low + 2)
            splice(a ^ 1, b)
            way = turn(low, low + 1, low + 2)
            if not way:
                return a, b ^ 1
            c = connect(b, a)
            return (a, b ^ 1) if way > 0 else (c ^ 1, c)
        middle = (low + high) // 2
        left_out, left_in = part(low, middle)
        right_in, right_out = part(middle, high)
        while True:  # down to the lower common tangent
            if turn(org[right_in], org[left_in], org[left_in ^ 1]) > 0:
                left_in = before[left_in ^ 1]
            elif turn(org[left_in], org[right_in ^ 1], org[right_in]) > 0:
                right_in = after[right_in ^ 1]
            else:
                break
        base = connect(right_in ^ 1, left_in)
        if org[left_in] == org[left_out]:
            left_out = base ^ 1
        if org[right_in] == org[right_out]:
            right_out = base
        while True:  # up along the seam
            start, end = org[base], org[base ^ 1]
            lc = after[base ^ 1]
            l_ok = turn(org[lc ^ 1], end, start) > 0
            if l_ok:
                while inside(end, start, org[lc ^ 1], org[after[lc] ^ 1]):
                    following = after[lc]
                    remove(lc)
                    lc = following
            rc = before[base]
            r_ok = turn(org[rc ^ 1], end, start) > 0
            if r_ok:
                while inside(end, start, org[rc ^ 1], org[before[rc] ^ 1]):
                    following = before[rc]
                    remove(rc)
                    rc = following
            if not (l_ok or r_ok):
                return left_out, right_out
            if not l_ok or (r_ok and inside(org[lc ^ 1], org[lc], org[rc], org[rc ^ 1])):
                base = connect(rc, base ^ 1)
            else:
                base = connect(base ^ 1, lc ^ 1)

    hull = part(0, len(order))[0] ^ 1
    alive = np.frombuffer(lost, np.uint8) == 0
    e = hull
    while True:  # the outer face is none of the triangles
        alive[e] = False
        e = before[e ^ 1]
        if e == hull:
            break
    begin, ring = np.array(org), np.array(before)
    first = np.flatnonzero(alive)
    second = ring[first ^ 1]
    third = ring[second ^ 1]
    found = (ring[third ^ 1] == first) & (first < second) & (first < third)
    out = np.sort(order[np.stack([begin[f[found]] for f in (first, second, third)], 1)], axis=1)
    return out[np.lexsort(out.T[::-1])]


def delaunay(points: np.ndarray, furthest: bool = False) -> list[tuple[int, ...]]:
    """Simplices of the (furthest-site) Delaunay triangulation: the lower (upper) hull of the lifted points.

    In the plane the first is triangulated as such, and only extreme points enter the second: no other is farthest from anywhere.
    """
    plane = points.shape[1] == 2
    if plane and not furthest:
        return list(map(tuple, delaunay_2d(np.asarray(points, float)).tolist()))
    lifted = np.column_stack([points, ((points - points.mean(0)) ** 2).sum(1)])
    if not plane:
        return sorted(f for f, (n, _) in Hull(lifted).facets.items() if (n[-1] > 1e-12 if furthest else n[-1] < -1e-12))
    rows = np.sort(hull_2d(points)) if len(points) else np.zeros(0, int)
    if len(rows) < 3:
        return []
    lifted = lifted[rows]  # and a point below them all, without which three, or those on one circle, have no volume
    below = np.append(lifted[:, :2].mean(0), lifted[:, 2].min() - np.ptp(lifted[:, :2]) ** 2)
    hull = Hull(np.vstack([lifted, below]))
    return sorted(tuple(rows[list(f)].tolist()) for f, (n, _) in hull.facets.items() if n[-1] > 1e-12 and len(rows) not in f)


def circumcentre(v: np.ndarray) -> np.ndarray:
    """The point at equal distance from the corners of a simplex: a Voronoi vertex."""
    return np.linalg.solve(2 * (v[1:] - v[0]), (v[1:] ** 2).sum(1) - (v[0] ** 2).sum())


def voronoi(points: np.ndarray, furthest: bool = False) -> tuple[list[np.ndarray], dict[int, list[int]], list[tuple[int, int, list[int]]]]:
    """Voronoi vertices, regions (site to vertices) and ridges (site, site, vertices)."""
    simplices = delaunay(points, furthest)
    centres = [circumcentre(points[list(s)]) for s in simplices]
    regions: dict[int, list[int]] = {}
    ridges: dict[tuple[int, int], list[int]] = {}
    for k, s in enumerate(simplices):
        for i, a in enumerate(s):
            regions.setdefault(a, []).append(k)
            for b in s[i + 1 :]:
                ridges.setdefault((a, b), []).append(k)
    return centres, regions, [(a, b, v) for (a, b), v in sorted(ridges.items())]


def halfspaces(normals: np.ndarray, offsets: np.ndarray, interior: np.ndarray) -> np.ndarray:
    """Vertices of ``normal . x + offset <= 0`` about an interior point, by the hull of the dual points."""
    room = -(normals @ interior + offsets)
    if (room <= 0).any():
        raise ValueError("the point is not inside all half-spaces")
    dual = Hull(normals / room[:, None])
    return np.array([n / d + interior for n, d in dual.facets.values()]).reshape(-1, normals.shape[1])


FACETS = "grp long, facet int, vertices array<long>, normal array<double>, offset double, area double, centre array<double>, neighbours array<int>"


def facets(points: DataFrame, axes: list[str], group: str = "grp", id_col: str = "id") -> DataFrame:
    """Facets of each group's hull: vertex ids, outward normal, offset, area, centre and adjacent facets."""

    def of_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        hull, ids = Hull(pdf[axes].to_numpy(float)), pdf[id_col].to_numpy()
        order = sorted(hull.facets)
        place = {f: i for i, f in enumerate(order)}
        near = hull.neighbours()
        rows = [
            (int(pdf[group].iloc[0]), i, [int(ids[c]) for c in f], hull.facets[f][0].tolist(), hull.facets[f][1], hull.facet_area(f), hull.points[list(f)].mean(0).tolist(), sorted(place[g] for g in near[f]))
            for i, f in enumerate(order)
        ]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FACETS.split(", ")])

    return points.select(F.col(group).cast("long").alias(group), F.col(id_col).cast("long").alias(id_col), *axes).groupBy(group).applyInPandas(of_group, FACETS)


def hull_measures(facet_rows: DataFrame, dim: int) -> DataFrame:
    """``(grp, n_facets, area, volume)`` from the facets alone."""
    inner = facet_rows.groupBy("grp").agg(F.array(*(F.avg(F.col("centre")[i]) for i in range(dim))).alias("c"))
    dot = F.aggregate(F.zip_with("normal", "c", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    joined = facet_rows.join(inner, "grp").withColumn("part", F.col("area") * (F.col("offset") - dot) / dim)
    return joined.groupBy("grp").agg(F.count("*").alias("n_facets"), F.sum("area").alias("area"), F.sum("part").alias("volume"))


def largest_facets(facet_rows: DataFrame, n: int) -> DataFrame:
    return facet_rows.orderBy(F.desc("area"), "grp", "facet").limit(n)


def facets_seeing(facet_rows: DataFrame, point: list[float], visible: bool = True) -> DataFrame:
    """Facets that a point lies above (or the others)."""
    dot = F.aggregate(F.zip_with("normal", F.array(*(F.lit(float(p)) for p in point)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return facet_rows.where(dot > F.col("offset") if visible else dot <= F.col("offset"))


def facets_with(facet_rows: DataFrame, vertex: int, included: bool = True) -> DataFrame:
    has = F.array_contains("vertices", F.lit(vertex))
    return facet_rows.where(has if included else ~has)


def facets_within(facet_rows: DataFrame, axis: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Facets whose normal's component lies between two thresholds."""
    out = facet_rows
    out = out.where(F.col("normal")[axis] >= low) if low is not None else out
    return out.where(F.col("normal")[axis] <= high) if high is not None else out


POLYGON = "grp long, seq int, id long"


def extreme_points_2d(points: DataFrame, group: str = "grp", id_col: str = "id") -> DataFrame:
    """``(grp, seq, id)``: each group's hull in counter-clockwise order.

    Groups are thinned where they lie: only the extreme points of each batch's part of a group
    can be extreme in the group, so few points travel and no task holds a whole group.
    """
    rows = points.select(F.col(group).cast("long").alias("grp"), F.col(id_col).cast("long").alias("id"), "x", "y")

    def thin(batches):
        for pdf in batches:
            for _, own in pdf.sort_values("id").groupby("grp"):
                yield own.iloc[hull_2d(own[["x", "y"]].to_numpy(float))]

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        ring = hull_2d(pdf[["x", "y"]].to_numpy(float))
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "seq": range(len(ring)), "id": pdf["id"].to_numpy()[ring]})

    thinned = rows.mapInPandas(thin, "grp long, id long, x double, y double")
    return thinned.groupBy("grp").applyInPandas(whole, POLYGON)


def simplices(points: DataFrame, axes: list[str], furthest: bool = False, group: str = "grp", id_col: str = "id") -> DataFrame:
    """``(grp, simplex, vertices, centre)`` of each group's Delaunay triangulation; centres are Voronoi vertices."""

    def of_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        xyz, ids = pdf[axes].to_numpy(float), pdf[id_col].to_numpy()
        found = np.array(delaunay(xyz, furthest), np.int64).reshape(-1, len(axes) + 1)
        v = xyz[found]
        centres = np.linalg.solve(2 * (v[:, 1:] - v[:, :1]), ((v[:, 1:] ** 2).sum(2) - (v[:, :1] ** 2).sum(2))[..., None])[..., 0]
        return pd.DataFrame({"grp": int(pdf[group].iloc[0]), "simplex": range(len(found)), "vertices": list(ids[found]), "centre": list(centres)})

    return points.select(F.col(group).cast("long").alias(group), F.col(id_col).cast("long").alias(id_col), *axes).groupBy(group).applyInPandas(of_group, "grp long, simplex int, vertices array<long>, centre array<double>")


def regions(simplex_rows: DataFrame) -> DataFrame:
    """``(grp, site, vertices)``: Voronoi regions as sets of simplices around each site."""
    return simplex_rows.select("grp", "simplex", F.explode("vertices").alias("site")).groupBy("grp", "site").agg(F.sort_array(F.collect_list("simplex")).alias("vertices"))


def ridges(simplex_rows: DataFrame) -> DataFrame:
    """``(grp, a, b, vertices)``: Voronoi ridges between neighbouring sites."""
    pair = simplex_rows.select("grp", "simplex", F.explode("vertices").alias("a"), F.col("vertices").alias("v")).select("grp", "simplex", "a", F.explode("v").alias("b")).where("a < b")
    return pair.groupBy("grp", "a", "b").agg(F.sort_array(F.collect_list("simplex")).alias("vertices"))


def intersections(planes: DataFrame, axes: list[str], interior: list[float], group: str = "grp") -> DataFrame:
    """``(grp, vertex, *axes)``: corners of each group's half-spaces ``normal . x + offset <= 0`` about a point inside all."""

    def of_group(pdf: pd.DataFrame) -> pd.DataFrame:
        corners = halfspaces(pdf[axes].to_numpy(float), pdf["offset"].to_numpy(float), np.array(interior))
        corners = corners[np.lexsort(np.round(corners, 9).T[::-1])]
        return pd.DataFrame({"grp": int(pdf[group].iloc[0]), "vertex": range(len(corners))} | {a: corners[:, i] for i, a in enumerate(axes)})

    return planes.select(F.col(group).cast("long").alias(group), *axes, "offset").groupBy(group).applyInPandas(of_group, "grp long, vertex int, " + ", ".join(f"{a} double" for a in axes))


def joggled(points: DataFrame, axes: list[str], size: float, seed: int = 0) -> DataFrame:
    """Each coordinate moved by less than ``size``, reproducibly."""
    return points.withColumns({a: F.col(a) + size * (2 * uniform(F.col("id"), seed + i) - 1) for i, a in enumerate(axes)})


def scaled(points: DataFrame, axis: str, low: float, high: float) -> DataFrame:
    """One coordinate scaled to a range."""
    ends = points.agg(F.min(axis).alias("__lo"), F.max(axis).alias("__hi"))
    return points.join(F.broadcast(ends), how="cross").withColumn(axis, F.lit(low) + (F.col(axis) - F.col("__lo")) * (high - low) / (F.col("__hi") - F.col("__lo"))).drop("__lo", "__hi")


def rotated(points: DataFrame, axes: list[str], seed: int = 0) -> DataFrame:
    """Coordinates turned by a random rotation."""
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(axes), len(axes))))[0]
    return points.withColumns({a: sum((F.col(b) * float(turn[i, j]) for j, b in enumerate(axes)), F.lit(0.0)) for i, a in enumerate(axes)})


def uniform(key, seed: int):
    """A reproducible uniform number in [0, 1) for each key."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 53)).cast("double")) / float(1 << 53)


def normal(key, seed: int):
    return F.sqrt(-2 * F.log(1 - uniform(key, seed))) * F.cos(2 * math.pi * uniform(key, seed + 1000003))


def generated(spark, kind: str, n: int, dim: int = 3, seed: int = 0, size: float = 0.5, width: float = 0.0) -> DataFrame:
    """``(id, x0, x1, ...)``: points of a usual test set, generated in parallel.

    ``cube`` (uniform; ``width`` > 0 keeps a shell), ``cospherical``, ``disk`` (a flattened
    ball of thickness ``width``), ``lens`` (two caps), ``spiral``, ``polygon``, ``simplex`` (a
    shell of ``width`` within a simplex), ``corners`` and ``diamond`` (no random points), ``mesh`` (a lattice).
    """
    axes = [f"x{i}" for i in range(dim)]
    ids = spark.range(n)
    u = [uniform(F.col("id"), seed * 31 + i) for i in range(dim + 1)]
    g = [normal(F.col("id"), seed * 31 + 100 + i) for i in range(dim)]
    if kind == "corners":
        return spark.range(1 << dim).select("id", *(F.when(F.shiftright("id", i) % 2 == 1, F.lit(size)).otherwise(F.lit(-size)).alias(a) for i, a in enumerate(axes)))
    if kind == "diamond":
        return spark.range(2 * dim).select("id", *(F.when(F.floor(F.col("id") / 2) == i, F.when(F.col("id") % 2 == 0, F.lit(size)).otherwise(F.lit(-size))).otherwise(F.lit(0.0)).alias(a) for i, a in enumerate(axes)))
    if kind == "mesh":
        side = max(1, round(n ** (1.0 / dim)))
        return spark.range(side**dim).select("id", *((F.floor(F.col("id") / side**i) % side).cast("double").alias(a) for i, a in enumerate(axes)))
    if kind == "spiral":
        t = F.col("id") / max(1, n - 1)
        cols = [size * F.cos(4 * math.pi * t), size * F.sin(4 * math.pi * t), size * (2 * t - 1)]
        return ids.select("id", *((cols[i] if i < 3 else F.lit(0.0)).alias(a) for i, a in enumerate(axes)))
    if kind == "polygon":
        t = F.col("id") * (2 * math.pi / n)
        cols = [size * F.cos(t), size * F.sin(t)]
        return ids.select("id", *((cols[i] if i < 2 else F.lit(0.0)).alias(a) for i, a in enumerate(axes)))
    if kind in ("cospherical", "disk", "lens"):
        length = F.sqrt(sum((x * x for x in g[1:]), g[0] * g[0]))
        unit = [size * x / length for x in g]
        if kind == "disk":
            flat = F.sqrt(sum((x * x for x in g[1 : dim - 1]), g[0] * g[0]))
            unit = [size * F.pow(u[0], F.lit(1.0 / max(1, dim - 1))) * x / flat for x in g[:-1]] + [width * (u[dim] - 0.5)]
        if kind == "lens":
            tilt = F.when(u[0] < 0.5, F.lit(1.0)).otherwise(F.lit(-1.0))
            unit = [*unit[:-1], F.abs(unit[-1]) * 0.25 * tilt]
        return ids.select("id", *(c.alias(a) for c, a in zip(unit, axes)))
    if kind == "simplex":
        raw = [-F.log(1 - v) for v in u]
        total = sum(raw[1:], raw[0])
        shell = [F.when(F.pmod(F.col("id"), F.lit(dim + 1)) == i, r / total * width).otherwise(r / total) for i, r in enumerate(raw)] if width else [r / total for r in raw]
        return ids.select("id", *(shell[i].alias(a) for i, a in enumerate(axes)))
    if kind == "cube":
        cols = [2 * size * v - size for v in u[:dim]]
        if width:
            side = F.pmod(F.col("id"), F.lit(2 * dim))
            cols = [F.when(F.floor(side / 2) == i, F.when(side % 2 == 0, 1.0).otherwise(-1.0) * (size - width * (0.5 + c / (2 * size)))).otherwise(c) for i, c in enumerate(cols)]
        return ids.select("id", *(c.alias(a) for c, a in zip(cols, axes)))
    raise ValueError(f"no generator {kind!r}")
