"""Links of vectors against comparing all pairs, in shards so small that cells split several times."""

from collections import defaultdict

import numpy as np
import pytest

from lumenfold.llm import vectorgraph
from lumenfold.llm.vectorgraph import Settings, build, near_vectors, range_search, unit

SCHEMA = "vec_id long, embedding array<double>, label int, node string"


def brute(rows, least):
    fine = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    groups, links, edges = defaultdict(list), [0] * len(rows), defaultdict(set)
    for n, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and fine(v):
            groups[label, len(v)].append(n)
    for own in groups.values():
        u = unit(np.array([rows[n][1] for n in own], float))
        for x, y in np.argwhere(u @ u.T >= least):
            if x != y:
                links[own[x]] += 1
                edges[rows[own[x]][0]].add(rows[own[y]][0])
    root = {}
    for start in sorted({i for i, _, _ in rows if i is not None}):
        reach = [start] if start not in root else []
        while reach:
            at = reach.pop()
            if at not in root:
                root[at] = start
                reach += edges[at]
    return sorted(((i, n, root.get(i), None if i is None else root[i] == i) for (i, _, _), n in zip(rows, links, strict=True)), key=str)


def planted(width=24, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=width).tolist(), int(i % 3)) for i in range(900)]
    near = lambda v, noise: (np.array(v) / np.linalg.norm(v) + rng.normal(0, noise, width) / np.sqrt(width)).tolist()
    for i in range(120):  # pairs around the threshold
        rows.append((1000 + i, near(rows[i][1], rng.uniform(0.1, 0.6)), rows[i][2]))
    centre = rng.normal(size=width)
    for i in range(400):  # a dense group that is most of its label, its edge beyond the range of its other edge
        rows.append((2000 + i, near(centre, 0.05 if i < 300 else rng.uniform(0.15, 0.4)), 4))
    rows += [(3000 + i, rows[950][1], rows[950][2]) for i in range(50)]  # copies
    rows += [(3100 + i, (2.5 * np.array(rows[1500 % len(rows)][1])).tolist(), rows[1500 % len(rows)][2]) for i in range(3)]  # and copies of another length
    return rows


def odd(width=24):
    v = [1.0] + [0.0] * (width - 1)
    inf, nan = float("inf"), float("nan")
    return [(None, v, 7), (4000, v, 7), (4001, v, 7), (4001, [1.0] * width, 7), (4002, [1.0] * width, 7), (4003, v, None), (4004, None, 7), (4005, [], 7), (4006, [0.0] * width, 7), (4007, [nan, *v[1:]], 7), (4008, [*v[:-1], None], 7), (4009, [inf, *v[1:]], 7), (4010, [1.0, 0.0], 7), (4011, [2.0, 0.0], 7), (4012, [-0.0, *v[1:]], 7), (4013, [1e300, *v[1:]], 7), (4014, [1e-300, *v[1:]], 7), (4015, [1.0], 8)]


@pytest.mark.parametrize("shard", [384, 60])
def test_equals_all_pairs(spark, shard):
    rows = planted() + odd()
    df = spark.createDataFrame([(i, v, label, "clash") for i, v, label in rows], SCHEMA).repartition(5)
    s = Settings(shard=shard, sample=256)
    assert sorted(map(tuple, near_vectors(df, settings=s).collect()), key=str) == brute(rows, s.cosine)


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_search_reaches_the_range_of_one_graph():
    """Recall of the graph alone, entered at its medoid only, among vectors of loose groups."""
    rng = np.random.default_rng(2)
    s = Settings(cosine=0.9)
    u = unit(rng.normal(size=(60, 32)).repeat(25, axis=0) + 0.22 * rng.normal(size=(1500, 32)))
    lists = build(u.astype(np.float32), s)
    assert lists.shape == (1500, s.degree) and (np.arange(1500)[:, None] != lists).all()
    medoid = np.full(1500, int(np.argmax(u @ u.mean(axis=0))))
    found = {(int(a), int(b)) for q, x in range_search(u.astype(np.float32), lists, u.astype(np.float32), medoid, lambda q, x: np.full(len(q), s.cosine), s) for a, b in zip(q, x, strict=True) if a != b}
    true = {(int(a), int(b)) for a, b in np.argwhere(u @ u.T >= s.cosine) if a != b}
    assert len(true) > 10_000 and len(found & true) >= 0.95 * len(true)


def test_lost_links_are_noticed(spark, monkeypatch):
    """A search that finds nothing fails the audit, however often it is widened."""
    rows = [(i, [1.0, i / 1000], 1) for i in range(6)]
    monkeypatch.setattr(vectorgraph, "_links", lambda nodes, *rest: (nodes.select("node", "node").toDF("a", "b").limit(0),) * 2)
    with pytest.raises(RuntimeError, match="audited"):
        near_vectors(spark.createDataFrame([(*r, "") for r in rows], SCHEMA))
