"""Near-duplicate vectors over a robust-pruned flat graph that is built in overlapping cluster shards.

1. Equal vectors of a label are one node from here on. Null, zero and non-finite vectors are none.
2. Shards: the cells of (label, width) that are larger than ``shard`` are split again and again around centroids that are
   learnt from a bounded sample of the cell; each vector moves to the nearest child, and a copy of it to the next
   ``overlap`` nearest. A sample also shows a cell's dense balls: vectors so near to one pivot that all of them are
   linked with each other. A ball's pivot stays in the graph, with the ball's radius, for all of its vectors, so that a group
   of near copies, which may hold a third of all rows, is neither torn apart nor compared pair by pair.
3. Build: in every shard, each node's nearest candidates are pruned robustly (a candidate goes if a kept one is nearer
   to it by the factor ``alpha``), reverse edges are added and pruned again. The adjacency lists that a node has
   from its shards are united.
4. Search: every node is a query in each of its shards: greedily from the shard's medoid and from its own list, with a beam;
   then the range is expanded from every node found within it until nothing new turns up. Where a node that was found
   lies in further shards, the query goes on there, until no query finds anything in a shard that it hasn't been in.
5. Audit: a bounded sample of queries is compared with all vectors; should less than ``recall`` of their links have been
   found, shards are built anew with more overlap.
6. Verify: cosines are taken anew in double precision. Links of balls are certain by the triangle inequality of angles or are
   verified vector by vector.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import Workspace, released
from lumenfold.llm.components import connected_components

EPS = 1e-9  # of an angle; what lies within is left to the comparison of the vectors themselves


@dataclass(frozen=True)
class Settings:
    """``sample``: vectors of a cell that its centroids and balls are learnt from; ``audited``: queries of the audit."""

    cosine: float = 0.93
    shard: int = 384
    fan: int = 64
    overlap: int = 1
    sample: int = 1024
    dense: int = 8
    candidates: int = 48
    degree: int = 16
    alpha: float = 1.2
    beam: int = 24
    audited: int = 256
    recall: float = 0.95

    @property
    def angle(self) -> float:
        return math.acos(self.cosine)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one, in double precision whatever their size."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one width, stored as bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


# --- one shard --------------------------------------------------------------------------------------------------------


def _pruned(own: np.ndarray, u: np.ndarray, candidates: np.ndarray, s: Settings) -> np.ndarray:
    """Of each own vector's candidates in u (n x c, nearest first, -1 for none): at most ``degree``, none in another's shadow."""
    n = len(own)
    out = np.full((n, s.degree), -1, np.int32)
    vectors = u[candidates]
    near = np.einsum("nd,ncd->nc", own, vectors)
    alive = candidates >= 0
    rows = np.arange(n)
    for r in range(s.degree):
        pick = np.argmax(alive, axis=1)
        has = alive[rows, pick]
        if not has.any():
            break
        chosen = candidates[rows, pick]
        out[:, r] = np.where(has, chosen, -1)
        alive[rows, pick] = False
        between = np.einsum("nd,ncd->nc", u[chosen], vectors)
        # squared distances of unit vectors are 2 - 2 cos
        alive &= ~(has[:, None] & (s.alpha**2 * (2 - 2 * between) <= 2 - 2 * near))
    return out


def build(u: np.ndarray, s: Settings) -> np.ndarray:
    """Adjacency lists (n x degree, -1 for none) of a shard's unit vectors."""
    n = len(u)
    c = min(s.candidates, n - 1)
    if c < 1:
        return np.full((n, s.degree), -1, np.int32)
    nearest = np.empty((n, c), np.int32)
    for at in range(0, n, 512):
        cosines = u[at : at + 512] @ u.T
        cosines[np.arange(len(cosines)), np.arange(at, at + len(cosines))] = -3
        some = np.argpartition(-cosines, c - 1, axis=1)[:, :c]
        nearest[at : at + 512] = np.take_along_axis(some, np.argsort(-np.take_along_axis(cosines, some, axis=1), axis=1, kind="stable"), axis=1)
    forward = _in_blocks(u, nearest, s)
    # both directions, each node's nearest first; a node that many choose keeps the candidates nearest to it
    a, b = np.nonzero(forward >= 0)[0], forward[forward >= 0]
    edges = np.unique(np.concatenate([np.stack([a, b], 1), np.stack([b, a], 1)]), axis=0)
    far = -np.einsum("nd,nd->n", u[edges[:, 0]], u[edges[:, 1]])
    edges = edges[np.lexsort([far, edges[:, 0]])]
    start = np.searchsorted(edges[:, 0], np.arange(n))
    place = np.arange(len(edges)) - start[edges[:, 0]]
    both = np.full((n, s.candidates), -1, np.int32)
    kept = place < s.candidates
    both[edges[kept, 0], place[kept]] = edges[kept, 1]
    return _in_blocks(u, both, s)


def _in_blocks(u: np.ndarray, candidates: np.ndarray, s: Settings, rows: int = 256) -> np.ndarray:
    return np.concatenate([_pruned(u[at : at + rows], u, candidates[at : at + rows], s) for at in range(0, len(u), rows)])


def range_search(u: np.ndarray, lists: np.ndarray, queries: np.ndarray, entries: np.ndarray, least: Callable[[np.ndarray, np.ndarray], np.ndarray], s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) of a shard's nodes within range of query vectors that enter at a node each and at the medoid.

    ``least`` gives, for numbers of queries and of nodes, the cosine from which on a node is within range.
    """
    medoid = int(np.argmax(u @ u.mean(axis=0)))
    for at in range(0, len(queries), 256):
        q = np.arange(at, min(at + 256, len(queries)))
        rows = np.arange(len(q))
        cosines = np.full((len(q), len(u)), -2.0, np.float32)  # -2: not seen

        def see(r: np.ndarray, nodes: np.ndarray, q=q, cosines=cosines) -> None:
            cosines[r, nodes] = np.einsum("nd,nd->n", queries[q[r]], u[nodes])

        see(rows, np.full(len(q), medoid))
        see(rows, entries[q])
        expanded = np.zeros(cosines.shape, bool)

        def expand(r: np.ndarray, nodes: np.ndarray, cosines=cosines, expanded=expanded, see=see) -> None:
            expanded[r, nodes] = True
            then = lists[nodes]
            i, j = np.nonzero(then >= 0)
            fresh = np.unique(r[i].astype(np.int64) * len(u) + then[i, j])
            r, nodes = fresh // len(u), fresh % len(u)
            new = cosines[r, nodes] < -1.5
            see(r[new], nodes[new])

        beam = min(s.beam, len(u))
        while True:  # greedy: the best node of each query's beam that isn't expanded yet
            worst = np.partition(cosines, len(u) - beam, axis=1)[:, len(u) - beam]
            waiting = np.where(expanded | (cosines < np.maximum(worst, -1.5)[:, None]), -2.0, cosines)
            best = np.argmax(waiting, axis=1)
            going = waiting[rows, best] > -1.5
            if not going.any():
                break
            expand(rows[going], best[going])
        while True:  # the range: whatever lies within it is expanded
            r, nodes = np.nonzero((cosines > -1.5) & ~expanded)
            within = cosines[r, nodes] >= least(q[r], nodes)
            if not within.any():
                break
            expand(r[within], nodes[within])
        r, nodes = np.nonzero(cosines > -1.5)
        within = cosines[r, nodes] >= least(q[r], nodes)
        yield q[r[within]], nodes[within]


# --- shards -----------------------------------------------------------------------------------------------------------


def _pivots(u: np.ndarray, home: np.ndarray, s: Settings) -> tuple[list[int], np.ndarray]:
    """Pivots of dense balls, the fullest first, and each vector's pivot or -1; only home vectors are taken."""
    close = (u @ u.T >= math.cos(s.angle / 2 - EPS)) & home[None, :]
    own, pivots = np.full(len(u), -1, np.int64), []
    while True:
        counts = (close & (own < 0)[None, :]).sum(axis=1) * (home & (own < 0))
        p = int(np.argmax(counts))
        if counts[p] < s.dense:
            return pivots, own
        pivots.append(p)
        own[close[p] & (own < 0)] = p


def _learnt(cell: pa.Table, s: Settings) -> pa.Table:
    """From a cell's sample: the children's centroids, and pivots of dense balls with the angle that members may have."""
    u, nodes = _matrix(cell["v"]), cell["node"].to_numpy()
    n = cell["n"][0].as_py()
    k = int(min(s.fan, max(2, -(-2 * n // s.shard)), len(u)))
    order = np.argsort(nodes)
    u, nodes, home = u[order], nodes[order], cell["home"].to_numpy(zero_copy_only=False)[order]
    pivots, free = _pivots(u, home, s)
    free = free < 0
    rest = u[free | ~home] if (free | ~home).sum() >= k else u
    centroids = rest[np.linspace(0, len(rest) - 1, k).astype(int)]
    for _ in range(8):
        own = np.argmax(rest @ centroids.T, axis=1)
        sums = np.stack([rest[own == c].sum(axis=0) if (own == c).any() else centroids[c] for c in range(k)])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return pa.table({"cell": cell["cell"].slice(0, 1), "centroids": [centroids.tobytes()], "pivots": [u[pivots].tobytes()], "pivot_nodes": pa.array([nodes[pivots].tolist()], pa.list_(pa.int64()))})


PLACED = "cell string, node bigint, home boolean, v binary, pivot bigint"


def _split(members: DataFrame, space: Workspace, tag: str, s: Settings) -> tuple[DataFrame, DataFrame | None]:
    """Members in the children of too large cells, those of balls with a pivot; the cells that are small enough."""
    sizes = members.groupBy("cell").count().withColumnRenamed("count", "n")
    large = space.save(sizes.where(F.col("n") > 2 * s.shard), f"large-{tag}")
    pieces = large.agg(F.sum("n")).first()[0]
    if not pieces:
        return members, None
    sampled = members.join(large, "cell").where(F.pmod(F.xxhash64("node", "cell"), "n") < s.sample)
    learnt = sampled.groupBy("cell").applyInArrow(lambda t: _learnt(t, s), "cell string, centroids binary, pivots binary, pivot_nodes array<bigint>")
    # a cell's centroids go to each of the pieces that its members are dealt into, ahead of them
    chunk = 8 * s.shard
    rules = learnt.join(large, "cell").withColumn("piece", F.explode(F.expr(f"sequence(0L, n div {chunk})")))
    rows = members.join(large, "cell").withColumn("piece", F.pmod(F.xxhash64("node"), F.expr(f"n div {chunk} + 1")))
    blank = lambda *names: [F.lit(None).alias(n) for n in names]
    both = rows.select("cell", "piece", F.lit(1).alias("kind"), "node", "home", "v", *blank("centroids", "pivots", "pivot_nodes")).unionByName(
        rules.select("cell", "piece", F.lit(0).alias("kind"), *blank("node", "home", "v"), "centroids", "pivots", "pivot_nodes")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = pivots = pivot_nodes = None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            edges = np.flatnonzero(kinds == 0)
            for start, end in zip([0, *edges + 1], [*edges, batch.num_rows], strict=True):
                if start and kinds[start - 1] == 0:
                    rule = batch.slice(start - 1, 1)
                    v = np.frombuffer(rule.column("centroids")[0].as_py(), np.float64)
                    pivot_nodes = np.array(rule.column("pivot_nodes")[0].as_py(), np.int64)
                    pivots = np.frombuffer(rule.column("pivots")[0].as_py(), np.float64)
                    centroids = v
                if end > start:
                    yield _placed(batch.slice(start, end - start), centroids, pivots, pivot_nodes, s)

    number = max(1, pieces // chunk)
    placed = both.repartition(number, "cell", "piece").sortWithinPartitions("cell", "piece", "kind").mapInArrow(released(place), PLACED)
    return space.save(placed, f"placed-{tag}"), space.save(members.join(large, "cell", "left_anti"), f"small-{tag}")


def _placed(batch: pa.RecordBatch, centroids: np.ndarray, pivots: np.ndarray, pivot_nodes: np.ndarray, s: Settings) -> pa.RecordBatch:
    u = _matrix(batch.column("v"))
    n, width = u.shape
    home, nodes, cells = batch.column("home").to_numpy(zero_copy_only=False), batch.column("node").to_numpy(), batch.column("cell").to_pylist()
    own = np.full(n, -1, np.int64)
    if len(pivot_nodes):
        cosines = u @ pivots.reshape(-1, width).T
        best = np.argmax(cosines, axis=1)
        inside = home & (cosines[np.arange(n), best] >= math.cos(s.angle / 2 - EPS))
        own[inside] = pivot_nodes[best[inside]]
        own[np.isin(nodes, pivot_nodes) & home] = nodes[np.isin(nodes, pivot_nodes) & home]
    staying = np.flatnonzero((own < 0) | (own == nodes))
    cosines = u[staying] @ centroids.reshape(-1, width).T
    ranked = np.argsort(-cosines, axis=1, kind="stable")[:, : 1 + s.overlap]
    take, child, first = [np.flatnonzero(own >= 0)], [np.full((own >= 0).sum(), -1)], [np.zeros((own >= 0).sum(), bool)]
    for r in range(ranked.shape[1]):
        some = staying if r == 0 else staying[home[staying]]
        take.append(some)
        child.append(ranked[:, r] if r == 0 else ranked[home[staying], r])
        first.append(home[some] if r == 0 else np.zeros(len(some), bool))
    take, child, first = np.concatenate(take), np.concatenate(child), np.concatenate(first)
    balls = child < 0
    names = [None if c < 0 else f"{cells[i]}/{c}" for i, c in zip(take, child, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(nodes[take]), pa.array(first), batch.column("v").take(pa.array(take)), pa.array(own[take], mask=~balls)], names=["cell", "node", "home", "v", "pivot"])


def _shards(nodes: DataFrame, space: Workspace, tag: str, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(cell, node, home, v) of all shards, and (node, pivot, v) of the vectors in balls, pivots included."""
    members = nodes.select(F.concat_ws(":", "label", F.octet_length("v")).alias("cell"), "node", F.lit(True).alias("home"), "v")
    done, balls = [], []
    for i in range(40):
        placed, small = _split(members, space, f"{tag}-{i}", s)
        if small is None:
            done.append(members)
            break
        done.append(small)
        balls.append(placed.where("pivot is not null").select("node", "pivot", "v"))
        members = placed.where("pivot is null").select("cell", "node", "home", "v")
    else:
        done.append(members)
    def dense(cell: pa.Table) -> pa.Table:
        order = np.argsort(cell["node"].to_numpy())
        cell = cell.take(pa.array(order))
        _, own = _pivots(_matrix(cell["v"]), cell["home"].to_numpy(), s)
        kept = np.flatnonzero(own >= 0)
        return cell.select(["node", "v"]).take(pa.array(kept)).append_column("pivot", pa.array(cell["node"].to_numpy()[own[kept]], pa.int64()))

    shards = space.save(_union(done), f"cells-{tag}")
    before = _union(balls) if balls else nodes.select("node", "v", F.col("node").alias("pivot")).limit(0)
    # the pivots of earlier balls are vectors like others to the balls of a shard, but keep their own
    gone = before.where("node <> pivot").select("node")
    shards = shards.join(gone, "node", "left_anti")
    late = shards.join(before.select("node"), "node", "left_anti").groupBy("cell").applyInArrow(dense, "node bigint, v binary, pivot bigint")
    inside = space.save(before.select("node", "v", "pivot").unionByName(late), f"balls-{tag}")
    # of a ball's vectors only the pivot is in the graph, also where copies lay in other shards
    return space.save(shards.join(inside.where("node <> pivot").select("node"), "node", "left_anti"), f"shards-{tag}"), inside


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- whole graph ------------------------------------------------------------------------------------------------------


def _near_points(shards: DataFrame, radius: DataFrame, space: Workspace, tag: str, s: Settings) -> DataFrame:
    """(a, b) of the graph's nodes whose balls, or vectors, may hold a link: the united lists searched in every shard."""

    def lists(cell: pa.Table) -> pa.Table:
        nodes = cell["node"].to_numpy()
        found = build(_matrix(cell["v"]).astype(np.float32), s)
        return pa.table({"node": nodes, "next": pa.array([nodes[x[x >= 0]] for x in found], pa.list_(pa.int64()))})

    per_shard = shards.groupBy("cell").applyInArrow(lists, "node bigint, next array<bigint>")
    united = per_shard.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next"))  # a list for each of a node's few shards
    united = space.save(united, f"lists-{tag}")
    points = shards.select("cell", "node", "v").join(radius, "node", "left").withColumn("radius", F.coalesce("radius", F.lit(0.0)))
    whole = space.save(points.join(united, "node").withColumn("entry", F.lit(None).cast("bigint")), f"graph-{tag}")
    search = lambda rows: rows.groupBy("cell").applyInArrow(lambda t: _searched(t, s), "a bigint, b bigint").distinct()
    near = fresh = space.save(search(whole), f"near-{tag}-0")
    been = points.select("node", "cell")
    for i in range(1, 100):
        both = fresh.select("a", "b").unionByName(fresh.select(F.col("b").alias("a"), F.col("a").alias("b")))
        onward = both.join(shards.select(F.col("node").alias("b"), "cell"), "b").groupBy(F.col("a").alias("node"), "cell").agg(F.min("b").alias("entry")).join(been, ["node", "cell"], "left_anti")
        onward = space.save(onward, f"onward-{tag}-{i}")
        if onward.isEmpty():
            return near
        been = been.unionByName(onward.select("node", "cell"))
        guests = onward.join(points.drop("cell").dropDuplicates(["node"]), "node").withColumn("next", F.lit(None).cast("array<bigint>"))
        hosts = whole.join(onward.select("cell").distinct(), "cell", "left_semi")
        fresh = space.save(search(hosts.unionByName(guests)).join(near, ["a", "b"], "left_anti"), f"near-{tag}-{i}")
        near = near.unionByName(fresh)
    raise RuntimeError("ranges don't end")


def _searched(cell: pa.Table, s: Settings) -> pa.Table:
    """Pairs within range: of all of a shard's nodes, or only of guests from other shards if there are any."""
    cell = cell.take(pa.array(np.lexsort([cell["node"].to_numpy(), cell["entry"].is_valid().to_numpy()])))
    guest = cell["entry"].is_valid().to_numpy()
    nodes, u, r = cell["node"].to_numpy(), _matrix(cell["v"]), cell["radius"].to_numpy()
    own = nodes[~guest]
    flat = cell["next"].combine_chunks().slice(0, len(own))
    then = flat.flatten().to_numpy()
    at = np.searchsorted(own, then)
    here = (at < len(own)) & (own[np.minimum(at, len(own) - 1)] == then)
    owner = np.repeat(np.arange(len(own)), flat.value_lengths().to_numpy())[here]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    lists = np.full((len(own), int(place.max(initial=0)) + 1), -1, np.int32)
    lists[owner, place] = at[here]
    asking = np.flatnonzero(guest) if guest.any() else np.arange(len(own))
    entries = np.searchsorted(own, cell["entry"].to_numpy()[asking].astype(np.int64)) if guest.any() else asking
    reach = lambda q, x: np.cos(np.minimum(np.pi, s.angle + r[asking[q]] + r[x]))
    a, b = [], []
    for q, x in range_search(u[: len(own)].astype(np.float32), lists, u[asking].astype(np.float32), entries, lambda q, x: reach(q, x) - 1e-5, s):
        one = nodes[asking[q]]
        exact = (np.einsum("nd,nd->n", u[asking[q]], u[x]) >= reach(q, x) - EPS) & (one != own[x])
        a.append(np.minimum(one, own[x])[exact])
        b.append(np.maximum(one, own[x])[exact])
    return pa.table({"a": np.concatenate(a) if a else own[:0], "b": np.concatenate(b) if b else own[:0]})


def _cosine(a: str, b: str) -> Column:
    """Of two unit vectors in bytes; numpy over whole batches."""
    from pyspark.sql.types import DoubleType

    @F.arrow_udf(DoubleType())
    def cosine(x: pa.Array, y: pa.Array) -> pa.Array:
        out = np.zeros(len(x))
        widths = np.array([len(v) for v in x.to_pylist()])
        for w in np.unique(widths):
            at = pa.array(np.flatnonzero(widths == w))
            out[widths == w] = np.einsum("nd,nd->n", _matrix(x.take(at)), _matrix(y.take(at)))
        return pa.array(out)

    return cosine(a, b)


def _links(nodes: DataFrame, near: DataFrame, balls: DataFrame, radius: DataFrame, space: Workspace, tag: str, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between vectors of different balls or none, and pairs of balls (a, b) that are linked throughout."""
    v = nodes.select("node", "v")
    side = lambda df, name, *cols: df.select(F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in cols])
    pairs = near.join(side(v, "a", "v"), "a").join(side(v, "b", "v"), "b").join(side(radius, "a", "radius"), "a", "left").join(side(radius, "b", "radius"), "b", "left")
    pairs = pairs.withColumn("cosine", _cosine("a_v", "b_v")).withColumn("reach", F.coalesce("a_radius", F.lit(0.0)) + F.coalesce("b_radius", F.lit(0.0)))
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "cosine")))
    pairs = pairs.withColumn("plain", F.col("a_radius").isNull() & F.col("b_radius").isNull()).withColumn("sure", ~F.col("plain") & (angle + F.col("reach") < s.angle - EPS))
    pairs = space.save(pairs.where(F.when(F.col("plain"), F.col("cosine") >= s.cosine).otherwise(True)).select("a", "b", "plain", "sure"), f"pairs-{tag}")
    inside = balls.select("node", "pivot", "v")
    single = lambda name: F.coalesce(f"{name}_node", F.col(name)).alias(name)
    member = lambda name: inside.select(F.col("pivot").alias(name), F.col("node").alias(f"{name}_node"))
    open_ = pairs.where("not plain and not sure").join(member("a"), "a", "left").join(member("b"), "b", "left").select(single("a"), single("b"))
    checked = open_.join(side(v, "a", "v"), "a").join(side(v, "b", "v"), "b").where(_cosine("a_v", "b_v") >= s.cosine).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = pairs.where("plain").select("a", "b").unionByName(checked)
    return space.save(links, f"links-{tag}"), pairs.where("sure").select("a", "b")


def _nodes(df: DataFrame, id_col: str, vector_col: str, label_col: str, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """(id, label, print) of every row, print null where it links with nothing; (node, id, label, print, weight, v) of different vectors."""
    fine = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))) & F.exists("x", lambda c: c != 0)
    x = F.col(f"`{vector_col}`").cast("array<double>").alias("x")
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), x)
    rows = rows.select("id", F.when(F.coalesce(fine, F.lit(False)) & F.col("id").isNotNull(), F.col("label")).alias("label"), "x")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("label").is_valid().to_pylist()
            # -0.0 and 0.0 are one number
            data = [(np.array(v, np.float64) + 0.0).tobytes() if ok else None for ok, v in zip(known, batch.column("x").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(data, pa.binary())], names=["id", "label", "raw"])

    packed = rows.mapInArrow(released(pack), "id bigint, label string, raw binary").withColumn("print", F.md5("raw"))
    packed = space.save(packed, "rows")
    classes = packed.where("raw is not null").groupBy("label", "print").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("raw").alias("raw"))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [unit(np.frombuffer(r, np.float64)[None])[0].tobytes() for r in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("node", "id", "label", "print", "weight")], pa.array(made, pa.binary())], names=["node", "id", "label", "print", "weight", "v"])

    numbered = classes.withColumn("node", F.monotonically_increasing_id()).select("node", "id", "label", "print", "weight", "raw")
    nodes = space.save(numbered.mapInArrow(released(normal), "node bigint, id bigint, label string, print string, weight bigint, v binary"), "nodes")
    return packed.select("id", "label", "print"), nodes


def _audited(nodes: DataFrame, links: DataFrame, balls: DataFrame, sure: DataFrame, s: Settings) -> float:
    """Share of the links of a bounded sample of nodes outside balls that was found; they meet all vectors in one pass."""
    asked = nodes.join(balls, "node", "left_anti").orderBy(F.xxhash64("node")).limit(s.audited).select("node", "label", "v").toArrow()  # of fixed size
    if not asked.num_rows:
        return 1.0
    shared = nodes.sparkSession.sparkContext.broadcast((asked["node"].to_numpy(), asked["label"].to_pylist(), asked["v"].to_pylist()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, labels, vectors = shared.value
        of: dict[tuple[str, int], list[int]] = {}
        for i, (label, v) in enumerate(zip(labels, vectors, strict=True)):
            of.setdefault((label, len(v)), []).append(i)
        for batch in batches:
            own: dict[tuple[str, int], list[int]] = {}
            for i, (label, v) in enumerate(zip(batch.column("label").to_pylist(), batch.column("v").to_pylist(), strict=True)):
                own.setdefault((label, len(v)), []).append(i)
            for key in of.keys() & own.keys():
                q, x = np.array(of[key]), np.array(own[key])
                u = np.frombuffer(b"".join(vectors[i] for i in q), np.float64).reshape(len(q), -1)
                i, j = np.nonzero(u @ _matrix(batch.column("v").take(pa.array(x))).T >= s.cosine)
                a, b = queries[q[i]], batch.column("node").to_numpy()[x[j]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[a != b]), pa.array(np.maximum(a, b)[a != b])], names=["a", "b"])

    true = nodes.select("node", "label", "v").mapInArrow(released(compare), "a bigint, b bigint").distinct()
    at = balls.select("node", "pivot")
    true = true.join(at.withColumnsRenamed({"node": "a", "pivot": "ap"}), "a", "left").join(at.withColumnsRenamed({"node": "b", "pivot": "bp"}), "b", "left")
    true = true.withColumns({"x": F.coalesce("ap", "a"), "y": F.coalesce("bp", "b")}).withColumns({"x": F.least("x", "y"), "y": F.greatest("x", "y")})
    seen = lambda df, mark, *on: df.select(F.col("a").alias(on[0]), F.col("b").alias(on[1]), F.lit(True).alias(mark)).distinct()
    found = true.join(seen(links, "linked", "a", "b"), ["a", "b"], "left").join(seen(sure, "certain", "x", "y"), ["x", "y"], "left")
    row = found.agg(F.count("*").alias("n"), F.count_if(F.col("linked").isNotNull() | F.col("certain").isNotNull() | (F.col("x") == F.col("y"))).alias("found")).first()
    return row.found / row.n if row.n else 1.0


def near_vectors(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", settings: Settings = Settings()) -> DataFrame:
    """id, n_links, component_id, kept of every row.

    Two rows are linked if their labels are equal and not null, their vectors have one width, and the cosine is
    ``settings.cosine`` or more. n_links counts linked rows other than itself, component_id is the smallest id that links
    reach, itself included, kept says whether that is the row's own. Vectors that are null, empty, zero, or hold null
    or non-finite components link with nothing. A null id links with nothing and has component and kept null. Rows
    that share an id are returned each, with their own number of links and one component. Ids are whole numbers. Further columns
    aren't read; an empty table gives an empty result. Every link returned is verified; of all links, the audit's
    sample had at least ``settings.recall`` found, or this raises.
    """
    s, space = settings, Workspace(df.sparkSession, "vectors")
    rows, nodes = _nodes(df, id_col, vector_col, label_col, space)
    for turn in range(3):
        tag = str(turn)
        shards, balls = _shards(nodes, space, tag, s)
        to_pivot = balls.join(nodes.select(F.col("node").alias("pivot"), F.col("v").alias("pv")), "pivot").withColumn("cosine", _cosine("v", "pv"))
        radius = space.save(to_pivot.groupBy(F.col("pivot").alias("node")).agg((F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.min("cosine")))) + EPS).alias("radius")), f"radius-{tag}")
        near = _near_points(shards, radius, space, tag, s)
        links, sure = _links(nodes, near, balls, radius, space, tag, s)
        found = _audited(nodes, links, balls, sure, s)
        if found >= s.recall:
            break
        s = replace(s, overlap=2 * s.overlap + 1)
    else:
        raise RuntimeError(f"only {found:.3f} of the audited links found")
    return _result(df, id_col, rows, nodes, links, balls, sure, space)


def _result(df: DataFrame, id_col: str, rows: DataFrame, nodes: DataFrame, links: DataFrame, balls: DataFrame, sure: DataFrame, space: Workspace) -> DataFrame:
    weight = nodes.select("node", "weight")
    both = lambda df: df.select("a", "b").unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    plain = both(links).join(weight.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("linked"))
    at = balls.select("node", "pivot")
    heavy = at.join(weight, "node").groupBy("pivot").agg(F.sum("weight").alias("heavy"))
    whole = weight.join(at, "node", "left").withColumn("pivot", F.coalesce("pivot", "node")).join(heavy, "pivot", "left")
    points = whole.where("node = pivot").select(F.col("pivot").alias("b"), F.coalesce("heavy", "weight").alias("w"))
    certain = both(sure).join(points, "b").groupBy(F.col("a").alias("pivot")).agg(F.sum("w").alias("certain"))
    counted = whole.join(plain, "node", "left").join(certain, "pivot", "left")
    zero = F.lit(0).cast("bigint")
    total = F.coalesce("heavy", "weight") - 1 + F.coalesce("linked", zero) + F.coalesce("certain", zero)
    numbers = nodes.select("node", "id", "label", "print").join(counted.select("node", total.alias("n_links")), "node")
    # components over ids: rows of one vector, vectors of one ball, links
    ids = nodes.select("node", "id")
    step = lambda pairs: pairs.join(ids.withColumnsRenamed({"node": "a", "id": "x"}), "a").join(ids.withColumnsRenamed({"node": "b", "id": "y"}), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = rows.join(nodes.select("label", "print", F.col("id").alias("least")), ["label", "print"]).select(F.col("id").alias("a"), F.col("least").alias("b"))
    edges = step(_union([links.select("a", "b"), sure.select("a", "b"), at.select(F.col("node").alias("a"), F.col("pivot").alias("b"))])).unionByName(same).where("a <> b")
    roots = connected_components(edges, space, "roots")
    out = rows.join(numbers.select("label", "print", "n_links"), ["label", "print"], "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("root", "id")
    kind = df.schema[id_col].dataType
    return out.select(F.col("id").cast(kind).alias(id_col), F.coalesce("n_links", zero).alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
