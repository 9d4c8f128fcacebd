"""Hamerly's bounds against full scans of Python integers, with ties, repeats, nulls and odd vectors."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from loomgraph.llm import clusters as cl

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, q string, distance long"


def _plain(rows, k=16, rounds=3, dims=64, scale=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-cl.MOST, min(cl.MOST, math.floor(scale * x))) for x in v]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    now = [q for _, q in order[:k]]
    if not now:
        return []

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(now))

    for _ in range(rounds):
        of = [nearest(q)[1] for _, q in kept]
        for n in range(len(now)):
            mine = [q for (_, q), c in zip(kept, of, strict=True) if c == n]
            if mine:
                now[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *nearest(q)) for i, q in kept]
    total, by = sum(d for _, d, _ in found), {}
    for _, d, c in found:
        by[c] = by.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return [(i, c, d, by[c], total, digest[c]) for i, d, c in found]


def _got(frame):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in frame.collect()), key=str)


def test_odd_vectors(spark):
    rng = np.random.default_rng(12)
    rows = [(int(k), rng.normal(size=64).round(1).tolist()) for k in range(150)]
    rows += [(None, rows[3][1]), (None, rows[4][1]), (7, rows[9][1]), (7, rows[9][1]), (500, [0.0] * 64), (501, [-0.0] * 64), (502, [1e300] * 64), (503, [-1e30] + [0.5] * 63)]
    rows += [(600, None), (601, []), (602, [1.0] * 63), (603, [None] + [1.0] * 63), (604, [float("nan")] + [1.0] * 63), (605, [float("inf")] + [1.0] * 63)]
    rows += [(700 + k, [0.25] * 64) for k in range(60)]  # a third of a table in one place
    df = spark.createDataFrame([(i, v, 1, 2, "q", 3) for i, v in rows], SCHEMA).repartition(5)
    assert _got(cl.clusters(df)) == sorted(_plain(rows), key=str)
    few = [r for r in rows if r[0] in (1, 2, 3, 603)]
    assert _got(cl.clusters(df.where("vec_id IN (1, 2, 3, 603)"))) == sorted(_plain(few), key=str)
    none = cl.clusters(df.where("vec_id = 603"))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("spread", [1, 40])
def test_bounds_give_what_full_scans_give(spread):
    """Five rounds with ties in plenty; the bounds must hold, and settle vectors without a scan where clusters are apart."""
    rng = np.random.default_rng(spread)
    x = rng.integers(0, 3, (2000, 6)) + spread * rng.integers(0, 4, (2000, 1))
    c = x[rng.choice(2000, 7, replace=False)].copy()
    state, before, scans = (np.full(2000, -1), np.full(2000, np.inf), np.zeros(2000)), None, []
    for _ in range(5):
        bounds = cl.Bounds(c, before)
        state = bounds.assign(x, *state)
        scans.append(bounds.scanned)
        d = ((x[:, None] - c) ** 2).sum(2)
        assert (state[0] == d.argmin(1)).all()
        own = np.sqrt(d[np.arange(2000), state[0]])
        rest = d.astype(float)
        rest[np.arange(2000), state[0]] = np.inf
        assert (state[1] >= own).all() and (state[2] <= np.sqrt(rest.min(1))).all()
        before, c = c, np.stack([x[state[0] == k].sum(0) // max(1, (state[0] == k).sum()) if (state[0] == k).any() else c[k] for k in range(7)])
    assert scans[0] == 2000 and (spread == 1 or scans[-1] < 1500)
