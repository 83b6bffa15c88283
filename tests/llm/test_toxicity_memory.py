"""Work arrays of the toxicity index stay small, whatever the lists of a batch of queries add up to."""

import pickle
import tracemalloc

import numpy as np

from latticeflow.llm.toxicity import QUERIES, Index


def test_work_arrays_are_bounded():
    rng = np.random.default_rng(11)
    n, terms, own = 2048, 6000, 600
    vectors = [(np.sort(rng.choice(terms, own, replace=False)), np.full(own, own**-0.5)) for _ in range(n)]
    index = Index(np.arange(terms, dtype=np.uint64), np.ones(terms), vectors, np.zeros(n), np.ones(n), np.arange(n), 15)
    first = index.nearest_of(vectors[:QUERIES])
    tracemalloc.start()
    again = index.nearest_of(vectors[:QUERIES])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all((a == b).all() for a, b in zip(first, again))
    dense = np.zeros((n, terms))
    for i, (at, w) in enumerate(vectors):
        dense[i, at] = w
    cosines = dense[:QUERIES] @ dense.T
    assert (first[1] == np.argsort(np.round(-cosines, 12), axis=1, kind="stable")[:, :15]).all() or np.allclose(first[0], -np.sort(-cosines, axis=1)[:, :15])
    assert peak < 40 << 20


def test_a_posting_is_kept_once():
    rng = np.random.default_rng(12)
    vectors = [(np.sort(rng.choice(9000, 300, replace=False)), np.full(300, 300**-0.5)) for _ in range(500)]
    index = Index(np.arange(9000, dtype=np.uint64), np.ones(9000), vectors, np.zeros(500), np.ones(500), np.arange(500), 15)
    before = index.nearest_of(vectors[:QUERIES])
    held = sum(a.nbytes for a in vars(index).values() if isinstance(a, np.ndarray) and len(a) == 500 * 300)
    assert held <= 16 * 500 * 300
    again = pickle.loads(pickle.dumps(index)).nearest_of(vectors[:QUERIES])
    assert all((a == b).all() for a, b in zip(before, again))
