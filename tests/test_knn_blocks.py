"""Neighbours within a block: few exact distances, bounded memory, the same rows."""

import tracemalloc

import numpy as np
import pytest

from neurotab.operators import knn


def plain(q, p, q_ids, p_ids, k, exclude_self):
    out = []
    for x, i in zip(q, q_ids):
        d = np.zeros(len(p))
        for j in range(q.shape[1]):
            d += (x[j] - p[:, j]) ** 2
        rows = sorted((round(float(np.sqrt(v)), knn.DECIMALS), o) for v, o in zip(d, p_ids) if not (exclude_self and o == i))
        out.append([o for _, o in rows[:k]])
    return out


@pytest.mark.parametrize("shape", ["normal", "ties", "copies", "far", "nan"])
def test_same_neighbours_as_plain(shape):
    rng = np.random.default_rng(3)
    q, p = rng.normal(size=(40, 6)), rng.normal(size=(700, 6))
    if shape == "ties":
        q, p = np.round(q), np.round(p)
    if shape == "copies":
        q[:], p[:] = p[0], p[0]
    if shape == "far":  # the product's rounding errors exceed the distances
        q, p = 1e-3 * q + 1e5, 1e-3 * p + 1e5
    if shape == "nan":
        p[5, 2] = np.nan
    q_ids, p_ids = np.arange(40), rng.permutation(700)
    for k, own in ((1, True), (7, False), (7, True)):
        place, _, real = knn._nearest(q, p, q_ids, p_ids, k, own)
        good = np.isfinite(p).all(1)
        assert [p_ids[r][f].tolist() for r, f in zip(place, real)] == plain(q, p[good], q_ids, p_ids[good], k, own)


def test_few_exact_distances_and_bounded_memory():
    """Pairs that get an exact distance do not grow with the block, and a slice
    holds little more than one matrix of the block's distances."""
    rng = np.random.default_rng(4)
    q, p = rng.normal(size=(knn.SLICE, 64)), rng.normal(size=(knn.POINT_BLOCK, 64))
    rows, _ = knn._candidates(q, p, None, 5)
    assert len(rows) < 40 * len(q)
    tracemalloc.start()
    knn._nearest(q, p, np.arange(len(q)), np.arange(len(p)), 5, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * q.shape[0] * p.shape[0] * 8
