"""The kernel of exact search against a plain version."""

import numpy as np
import pytest

from nearledger.operators import knn


@pytest.mark.parametrize(("dims", "k", "bounded", "exclude"), [(14, 5, False, False), (14, 64, True, False), (3, 5, True, True), (2, 70, False, True)])
def test_best_keeps_the_nearest_with_ties_by_row(dims, k, bounded, exclude):
    draw = np.random.default_rng(dims * k)
    v, r = draw.integers(0, 5, (700, dims)) / 4, draw.integers(0, 5, (2000, dims)) / 4
    rid = draw.permutation(2000).astype(np.int64)
    own = np.arange(700, dtype=np.int64) if exclude else None
    d = np.zeros((700, 2000))
    for i in range(dims):
        d += (v[:, i, None] - r[None, :, i]) ** 2
    if exclude:
        d[own[:, None] == rid[None, :]] = np.inf
    want = [[(rid[j], d[q, j]) for j in np.lexsort((rid, d[q]))[:k]] for q in range(700)]
    best = knn.Best(v, k, np.array([w[-1][1] for w in want]) if bounded else None, own)
    for a in range(0, 2000, 333):
        best.add(best.reach(r[a : a + 333].min(0), r[a : a + 333].max(0)), r[a : a + 333], rid[a : a + 333])
    q, got, far, _ = best.rows()
    # a task gives k rows a query, however many batches it has
    assert len(q) == 700 * k
    assert [[(x, y) for x, y in zip(got[q == n], far[q == n], strict=True)] for n in range(700)] == want


def test_leaves_part_what_differs_and_stop_at_equal_rows():
    draw = np.random.default_rng(1)
    v = np.concatenate([np.ones((500, 3)), draw.random((500, 3))])
    tree = knn.Leaves(v, 16)
    leaf = tree.of(v)
    assert leaf.max() < tree.n and len(set(leaf[:500].tolist())) == 1 and np.bincount(leaf[500:], minlength=tree.n).max() <= 16
