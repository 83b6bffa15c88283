"""The RING and NESTED pixelisations of the sphere with equal areas (Gorski et al. 2005).

Column expressions for positions, vectorised NumPy (over Arrow batches) for neighbours and
changes of resolution.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pixels(nside: int) -> int:
    return 12 * nside * nside


def side_of(npix: int) -> int:
    nside = math.isqrt(npix // 12)
    if pixels(nside) != npix:
        raise ValueError(f"no map has {npix} pixels")
    return nside


def pixel_of(ra: Column, dec: Column, nside: int) -> Column:
    """RING pixel of a direction in degrees."""
    z = F.sin(F.radians(dec))
    za = F.abs(z)
    tt = F.pmod(ra, F.lit(360.0)) / 90.0  # in [0, 4)
    n = nside
    # equatorial belt: rings of 4n pixels, found by ascending and descending edge lines
    up = F.floor(n * (0.5 + tt) - n * z * 0.75)
    down = F.floor(n * (0.5 + tt) + n * z * 0.75)
    ring = n + 1 + up - down  # from 1 at z = 2/3
    shift = F.when(F.pmod(ring, F.lit(2)) == 0, F.lit(1)).otherwise(F.lit(0))
    along = F.pmod(F.floor((up + down - n + shift + 1) / 2), F.lit(4 * n))
    belt = 2 * n * (n - 1) + (ring - 1) * 4 * n + along
    # polar caps: ring i has 4i pixels; 1 - |z| by the half angle, without cancellation
    colatitude = F.radians(90 - F.abs(dec))
    tmp = n * F.sqrt(F.lit(6.0)) * F.sin(colatitude / 2)
    tp = tt - F.floor(tt)
    jp, jm = F.floor(tp * tmp), F.floor((1 - tp) * tmp)
    i = jp + jm + 1
    ip = F.pmod(F.floor(tt * i), 4 * i)
    cap = F.when(z > 0, 2 * i * (i - 1) + ip).otherwise(pixels(n) - 2 * i * (i + 1) + ip)
    return F.when(za <= 2.0 / 3.0, belt).otherwise(cap).cast("long")


def centre_of(pix: Column, nside: int) -> tuple[Column, Column]:
    """Right ascension and declination, in degrees, of a RING pixel's centre."""
    n, npix = nside, pixels(nside)
    cap = 2 * n * (n - 1)
    # a cap's ring from the number of pixels before it: exact for whole numbers below 2**53
    def ring_of(p: Column) -> Column:
        guess = F.floor((1 + F.sqrt(1 + 2 * p)) / 2)
        guess = F.when(2 * guess * (guess - 1) > p, guess - 1).otherwise(guess)
        return F.when(2 * guess * (guess + 1) <= p, guess + 1).otherwise(guess)

    north = ring_of(pix)
    mirrored = npix - 1 - pix
    south = ring_of(mirrored)
    in_ring = pix - cap
    belt = F.floor(in_ring / (4 * n)) + n
    odd = F.when(F.pmod(belt + n, F.lit(2)) == 1, 1.0).otherwise(0.5)
    z_n = 1 - north * north / (3.0 * n * n)
    z_s = -(1 - south * south / (3.0 * n * n))
    z_b = (2 * n - belt) * 2 / (3.0 * n)
    phi_n = (pix - 2 * north * (north - 1) + 0.5) / north
    phi_s = (4 * south - 1 - (mirrored - 2 * south * (south - 1)) + 0.5) / south
    phi_b = (F.pmod(in_ring, F.lit(4 * n)) + 1 - odd) / n
    first, last = pix < cap, pix >= npix - cap
    z = F.when(first, z_n).when(last, z_s).otherwise(z_b)
    phi = F.when(first, phi_n).when(last, phi_s).otherwise(phi_b)
    return phi * 90.0, F.degrees(F.asin(z))


def _spread(v: np.ndarray) -> np.ndarray:
    out = np.zeros_like(v)
    for k in range(29):
        out |= (v >> k & 1) << (2 * k)
    return out


def _squeeze(v: np.ndarray) -> np.ndarray:
    out = np.zeros_like(v)
    for k in range(29):
        out |= (v >> (2 * k) & 1) << k
    return out


#: Ring and longitude offsets of the twelve base faces.
_ROW = np.array([2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4])
_LON = np.array([1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7])


def face_coordinates(nest: np.ndarray, nside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    face, rest = nest // (nside * nside), nest % (nside * nside)
    return face, _squeeze(rest), _squeeze(rest >> 1)


def nest_of(face: np.ndarray, x: np.ndarray, y: np.ndarray, nside: int) -> np.ndarray:
    return face * nside * nside + _spread(x) + 2 * _spread(y)


def nest_to_ring(nest: np.ndarray, nside: int) -> np.ndarray:
    nest = np.asarray(nest, np.int64)
    face, x, y = face_coordinates(nest, nside)
    ring = _ROW[face] * nside - x - y - 1
    north, south = ring < nside, ring > 3 * nside
    width = np.where(north, ring, np.where(south, 4 * nside - ring, nside))
    before = np.where(north, 2 * width * (width - 1), np.where(south, pixels(nside) - 2 * width * (width + 1), 2 * nside * (nside - 1) + (ring - nside) * 4 * nside))
    shift = np.where(north | south, 0, (ring - nside) & 1)
    along = (_LON[face] * width + x - y + 1 + shift) // 2
    along = (along - 1) % (4 * width) + 1
    return before + along - 1


def ring_to_nest(ring: np.ndarray, nside: int) -> np.ndarray:
    """Inverse of :func:`nest_to_ring`: the face and its coordinates from the pixel's place in its ring."""
    p = np.asarray(ring, np.int64)
    npix, cap = pixels(nside), 2 * nside * (nside - 1)
    north, south = p < cap, p >= npix - cap
    q = np.where(south, npix - 1 - p, p)
    i = ((1 + np.sqrt(1 + 2 * q.astype(float))) / 2).astype(np.int64)
    i -= 2 * i * (i - 1) > q
    i += 2 * i * (i + 1) <= q
    belt = (p - cap) // (4 * nside) + nside
    row = np.where(north, i, np.where(south, 4 * nside - i, belt))
    width = np.where(north | south, i, nside)
    along = np.where(north, p - 2 * i * (i - 1), np.where(south, 4 * i - 1 - (q - 2 * i * (i - 1)), (p - cap) % (4 * nside))) + 1
    shift = np.where(north | south, 0, (row - nside) & 1)
    # faces: in a cap by the quarter, in the belt by the edge lines crossed
    up, down = row - nside + 1, 2 * nside + 1 - row + nside
    a = (along - up // 2 + nside - 1) // nside
    b = (along - down // 2 + nside - 1) // nside
    belt_face = np.where(a == b, np.where(a == 4, 4, a + 4), np.where(b < a, b, a + 8))
    quarter = (along - 1) // np.maximum(width, 1)
    face = np.where(north, quarter, np.where(south, quarter + 8, belt_face))
    irt = row - _ROW[face] * nside + 1
    ipt = 2 * along - _LON[face] * width - shift - 1
    ipt = np.where(ipt >= 2 * nside, ipt - 8 * nside, ipt)
    return nest_of(face, (ipt - irt) >> 1, (-(ipt + irt)) >> 1, nside)


def neighbours(ring: np.ndarray, nside: int) -> np.ndarray:
    """Eight neighbours of each RING pixel as columns, -1 where one is missing.

    A neighbour inside the face is a step in its coordinates; over an edge the coordinates go
    on in the next face, turned by a quarter between faces of one polar band.
    """
    ring = np.asarray(ring, np.int64)
    face, x, y = face_coordinates(ring_to_nest(ring, nside), nside)
    out = np.full((len(ring), 8), -1, np.int64)
    for k, (dx, dy) in enumerate(((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))):
        nx, ny = x + dx, y + dy
        inside = (nx >= 0) & (nx < nside) & (ny >= 0) & (ny < nside)
        out[inside, k] = nest_to_ring(nest_of(face[inside], nx[inside], ny[inside], nside), nside)
        for i in np.flatnonzero(~inside).tolist():
            out[i, k] = _across(int(face[i]), int(nx[i]), int(ny[i]), nside)
    return out


#: For each base face, its neighbours by edge (south-west, south-east, north-west, north-east).
_SW = (4, 5, 6, 7, 11, 8, 9, 10, 11, 8, 9, 10)
_SE = (5, 6, 7, 4, 8, 9, 10, 11, 9, 10, 11, 8)
_NW = (3, 0, 1, 2, 3, 0, 1, 2, 4, 5, 6, 7)
_NE = (1, 2, 3, 0, 0, 1, 2, 3, 5, 6, 7, 4)


def _over(face: int, x: int, y: int, nside: int) -> tuple[int, int, int]:
    """One step over one edge; coordinates may still be outside along the other axis."""
    band = face // 4
    if x < 0:  # south-west
        f = _SW[face]
        return (f, x + nside, y) if band < 2 or f // 4 != band else (f, y, -1 - x)
    if x >= nside:  # north-east
        f = _NE[face]
        return (f, x - nside, y) if band > 0 and f // 4 != band else (f, y, 2 * nside - 1 - x)
    if y < 0:  # south-east
        f = _SE[face]
        return (f, x, y + nside) if band < 2 or f // 4 != band else (f, -1 - y, x)
    f = _NW[face]  # north-west
    return (f, x, y - nside) if band > 0 and f // 4 != band else (f, 2 * nside - 1 - y, x)


def _across(face: int, x: int, y: int, nside: int) -> int:
    ends = set()
    both = (x < 0 or x >= nside) and (y < 0 or y >= nside)
    if not both:
        f, a, b = _over(face, x, y, nside)
        return int(nest_to_ring(np.array([nest_of(np.array([f]), np.array([a]), np.array([b]), nside)[0]]), nside)[0])
    if face < 4 and x >= nside and y >= nside:  # over a pole, to the opposite face
        return int(nest_to_ring(nest_of(np.array([(face + 2) % 4]), np.array([nside - 1]), np.array([nside - 1]), nside), nside)[0])
    if face >= 8 and x < 0 and y < 0:
        return int(nest_to_ring(nest_of(np.array([8 + (face - 6) % 4]), np.array([0]), np.array([0]), nside), nside)[0])
    # at a corner: over either edge first; the two ways must meet, else four faces do not
    for first in ("x", "y"):
        px = x if first == "x" else min(max(x, 0), nside - 1)
        py = y if first == "y" else min(max(y, 0), nside - 1)
        f, a, b = _over(face, px, py, nside)
        base = (a, b)
        step = {"x": (0, y - py), "y": (x - px, 0)}[first]
        if _same_axes(face, f, first, x if first == "x" else y):
            a, b = base[0] + step[0], base[1] + step[1]
        else:
            return -1
        if 0 <= a < nside and 0 <= b < nside:
            ends.add((f, a, b))
            continue
        ends.add(_over(f, a, b, nside))
    if len(ends) != 1:
        return -1
    f, a, b = ends.pop()
    if not (0 <= a < nside and 0 <= b < nside):
        return -1
    return int(nest_to_ring(nest_of(np.array([f]), np.array([a]), np.array([b]), nside), nside)[0])


def _same_axes(face: int, other: int, axis: str, at: int) -> bool:
    """Whether coordinates go on unturned over an edge: not between faces of one polar band."""
    return face // 4 != other // 4


def regraded(maps: DataFrame, old: int, new: int) -> DataFrame:
    """``(pix, val)`` at another resolution: means of the children, or copies of the parent; missing pixels are 0."""
    if new == old:
        return maps.select("pix", "val")
    ratio = (old // new) ** 2 if new < old else (new // old) ** 2

    def parent(batches):
        for pdf in batches:
            nest = ring_to_nest(pdf["pix"].to_numpy(), old)
            if new < old:
                yield pd.DataFrame({"pix": nest_to_ring(nest // ratio, new), "val": pdf["val"].to_numpy()})
            else:
                child = (nest[:, None] * ratio + np.arange(ratio)).reshape(-1)
                yield pd.DataFrame({"pix": nest_to_ring(child, new), "val": np.repeat(pdf["val"].to_numpy(), ratio)})

    out = maps.select("pix", "val").mapInPandas(parent, "pix long, val double")
    return out.groupBy("pix").agg((F.sum("val") / ratio).alias("val")) if new < old else out


def with_neighbours(rows: DataFrame, nside: int, pix: str = "pix") -> DataFrame:
    """``(pix, near)``: a row for each neighbour that exists."""

    def run(batches):
        for pdf in batches:
            p = pdf[pix].to_numpy()
            near = neighbours(p, nside)
            at, k = np.nonzero(near >= 0)
            yield pd.DataFrame({"pix": p[at], "near": near[at, k]})

    return rows.select(pix).mapInPandas(run, "pix long, near long")


def boundary(mask: DataFrame, nside: int, rounds: int | None = None) -> DataFrame:
    """``(pix)`` of the layer around the mask's filled pixels, but for the ring that touches it.

    Rings grow outward by joining each newest ring's neighbours against all seen so far.
    """
    from latticeflow.operators.stage import kept

    rounds = int(3 + nside / 64) if rounds is None else rounds
    seen = kept(mask.where("val <> 0").select("pix"))
    ring, out = seen, None
    for k in range(rounds):
        near = with_neighbours(ring, nside).select(F.col("near").alias("pix")).distinct()
        ring = kept(near.join(seen, "pix", "left_anti"))
        seen = seen.unionByName(ring)
        if k:
            out = ring if out is None else out.unionByName(ring)
    return out if out is not None else ring.limit(0)
