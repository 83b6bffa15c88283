"""Plane triangulations: whole, right by their definition, and fast enough for large groups."""

import time

import numpy as np
import pytest

from latticeflow.operators import hulls


def _area(xy, triangles):
    v = xy[np.array(triangles).reshape(-1, 3)]
    e, f = v[:, 1] - v[:, 0], v[:, 2] - v[:, 0]
    return np.abs(e[:, 0] * f[:, 1] - e[:, 1] * f[:, 0]).sum() / 2


SETS = {
    "random": lambda r: r.random((300, 2)),
    "flat": lambda r: r.random((200, 2)) * [1, 1e-4],
    "copies and ties": lambda r: r.integers(0, 12, (300, 2)) * 1.0,
    "lattice": lambda r: np.array([[x, y] for x in range(9) for y in range(9)], float),
    "circle": lambda r: np.array([[5, 0], [4, 3], [3, 4], [0, 5], [-3, 4], [-4, -3], [0, -5], [3, -4]], float),
    "triangle": lambda r: np.array([[0, 0], [1, 0], [0, 1]], float),
    "a triangle's hull": lambda r: np.vstack([[[0, 0], [9, 0], [0, 9]], 1 + r.random((20, 2))]),
}


@pytest.mark.parametrize("kind", sorted(SETS))
@pytest.mark.parametrize("furthest", [False, True])
def test_circles_hold_none_or_all(kind, furthest):
    xy = SETS[kind](np.random.default_rng(5))
    ring = hulls.hull_2d(xy)
    triangles = hulls.delaunay(xy, furthest)
    whole = _area(xy, [(ring[0], a, b) for a, b in zip(ring[1:], ring[2:])])
    assert _area(xy, triangles) == pytest.approx(whole, rel=1e-9)
    if furthest:
        assert len(triangles) == len(ring) - 2
    else:
        assert len(np.unique(xy[sorted({c for t in triangles for c in t})], axis=0)) == len(np.unique(xy, axis=0))
    for t in triangles:
        corners = xy[list(t)]
        centre = hulls.circumcentre(corners)
        r2, gap = ((corners[0] - centre) ** 2).sum(), ((xy - centre) ** 2).sum(1)
        assert (gap <= r2 * (1 + 1e-6) + 1e-9).all() if furthest else (gap >= r2 * (1 - 1e-6) - 1e-9).all()


@pytest.mark.parametrize("xy", [np.zeros((0, 2)), np.zeros((1, 2)), np.zeros((4, 2)), np.array([[0, 0], [1, 1], [2, 2], [5, 5]], float)])
def test_no_triangles_on_a_line(xy):
    assert hulls.delaunay(xy) == [] and hulls.delaunay(xy, True) == []


@pytest.mark.parametrize("furthest", [False, True])
def test_time_of_a_large_group(furthest):
    xy = np.random.default_rng(6).random((20_000, 2))
    start = time.process_time()
    hulls.delaunay(xy, furthest)
    assert time.process_time() - start < 8
