"""Lanes filled with an early end are those that all targets give."""

import random

import numpy as np
import pytest

from inkweave.operators import lists as L


def _read(n, links):
    c = L.chunk(np.unique(np.array([a << 32 | b for a, b in links], np.int64)))
    return L.Read(n, list(zip(c["ks"], c["sizes"], c["gaps"])))


@pytest.mark.parametrize("n,m", [(3, 1), (30, 20), (300, 300), (300, 900), (300, 4000)])
def test_lanes_are_filled(n, m):
    """F8: bfs_ball_distance reads no further targets of a node that has all it can get."""
    known = 0
    for seed in range(12):
        rng = random.Random(seed)
        out = _read(n, {(min(int(rng.expovariate(3 / n)), n - 1) if seed % 2 else rng.randrange(n), rng.randrange(n)) for _ in range(m)})
        heart, nodes = L._Heart(out), np.arange(min(n, 200))
        r, changed = np.zeros((n, 4), np.uint64), np.zeros(n, bool)
        r[nodes, nodes // 64] = np.uint64(1) << (nodes % 64).astype(np.uint64)
        changed[nodes] = True
        steps = [r]
        while changed.any():
            r, changed = L._wider(out, heart.order, heart.begin, r, changed)
            steps.append(r)
        if heart.known:
            known += 1
            final = heart.final(steps[0], nodes)
            assert (final == steps[-1]).all()
            for was, now in zip(steps, steps[1:]):
                got, gained = heart.filled(was, final, np.flatnonzero((was != final).any(axis=1)))
                assert (got == now).all() and (gained == (was != now).any(axis=1)).all()
    assert known == 12 or m < 4000
