"""Clustering with bounds against the plain algorithm in Python's integers."""

import hashlib

import numpy as np
import pytest

from lumenfold.llm.centroids import Settings, cluster, reassign, scan_all

SCHEMA = "vec_id long, embedding array<float>, cluster string"


def plain(rows, s):
    kept = [(i, [int(np.floor(float(np.float32(x)) * s.scale)) for x in v]) for i, v in rows if v is not None and len(v) == s.width and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda i: (i is None, hashlib.sha256(f"{s.seed}:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[: s.k]]
    square = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (square(v, centroids[c]), c))
    for _ in range(s.rounds):
        own = [nearest(v) for _, v in kept]
        groups = [[v for (_, v), o in zip(kept, own, strict=True) if o == c] for c in range(len(centroids))]
        centroids = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centroids, strict=True)]
    out = [(i, nearest(v), square(v, centroids[nearest(v)])) for i, v in kept]
    inertia = [sum(d for _, o, d in out if o == c) for c in range(len(centroids))]
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia), marks[c]) for i, c, d in out), key=str)


@pytest.mark.parametrize("k, near, chunk", [(8, 3, 50), (8, 0, 4096), (5, 7, 7), (40, 6, 64)])
def test_equals_plain_algorithm(spark, k, near, chunk):
    rng = np.random.default_rng(3)
    width = 6
    rows = [(i, (rng.integers(-3, 4, width) / 3 + rng.normal(0, 0.05, width) * (i % 3)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(500 + i, rows[0][1]) for i in range(60)] + [(7, rows[9][1]), (None, rows[3][1]), (8, rows[8][1])]  # copies, repeated and null ids
    rows += [(601, None), (602, []), (603, [1.0] * 5), (604, [1.0] * 5 + [None]), (605, [1.0] * 5 + [float("nan")]), (606, [1.0] * 5 + [float("inf")])]
    s = Settings(k=k, width=width, near=near, chunk=chunk)
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, cluster(df, settings=s).collect()), key=str) == plain(rows, s)


def test_few_and_no_vectors(spark):
    s = Settings(width=2, k=8)
    rows = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 0.0])]
    frame = lambda rows: spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    assert sorted(map(tuple, cluster(frame(rows), settings=s).collect()), key=str) == plain(rows, s)
    assert cluster(frame([(1, None)]), settings=s).collect() == [] == cluster(frame([]), settings=s).collect()
    with pytest.raises(Exception, match="64-bit"):
        cluster(frame([(1, [1e30, 0.0])]), settings=s).collect()


def test_bounds_save_distances_and_change_nothing():
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(16, 12)).repeat(200, axis=0) * 900 + rng.normal(size=(3200, 12)) * 90).astype(np.int64)
    centroids = x[rng.choice(len(x), 16, replace=False)]
    b, taken = scan_all(x, centroids, 4), 0
    for _ in range(12):
        before = centroids
        centroids = np.array([x[b.own == c].sum(axis=0) // max(1, (b.own == c).sum()) if (b.own == c).any() else centroids[c] for c in range(16)])
        taken += reassign(x, b, centroids, np.sqrt(((centroids - before) ** 2).sum(axis=1)) * (1 + 1e-12))
        assert (b.own == scan_all(x, centroids, 4).own).all()
    assert taken < 0.3 * 12 * x.shape[0] * 16
