"""Centroid clustering of integer vectors with Drake's adaptive bounds.

Each vector carries its centroid, an upper bound on the distance to it, lower bounds on the distances to its ``near`` next
nearest centroids, in order, and one remainder bound below the distances to all others. When centroids move, the upper
bound grows by the own centroid's way, the lower bounds shrink by theirs, and the remainder by the longest way of all. A vector
whose upper bound lies below all its lower bounds stays without a distance being taken. Where it doesn't, the distance to the own
centroid is taken exactly; if that certifies nothing either, the near centroids whose bounds failed are measured, and all
centroids if the remainder bound failed. Distances are sums of squares in 64-bit integers and ties go to the smaller number, so
assignments are those of the plain algorithm; bounds are floating point with a margin, and only ever save work.

A round is one pass over the vectors: a task reads chunks with their bounds and the centroids (k vectors, a broadcast of fixed
size), writes the chunks anew to the shared folder, and beside them its sums by centroid, which are all that is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import Workspace, narrow, released

MOST = 1 << 27  # components beyond would overflow 64-bit distances


@dataclass(frozen=True)
class Settings:
    """``chunk``: vectors that are kept and handled together."""

    k: int = 8
    rounds: int = 10
    width: int = 64
    scale: float = 1024.0
    seed: str = "3"
    near: int = 3
    chunk: int = 4096


CHUNKS = "ids binary, vectors binary, bounds binary, measured bigint, centroid array<int>, count array<bigint>, total array<array<bigint>>"
SLACK = 1e-6


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of vectors to one centroid each, exactly."""
    return ((x - c) ** 2).sum(axis=1)


@dataclass
class Bounds:
    """Of n vectors: own centroid, upper bound, near centroids with lower bounds (n x near), remainder bound."""

    own: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lower: np.ndarray
    rest: np.ndarray

    def pack(self) -> bytes:
        return b"".join(x.tobytes() for x in (self.upper, self.lower, self.rest, self.own.astype(np.int32), self.near.astype(np.int32)))

    @staticmethod
    def unpack(data: bytes, n: int, near: int) -> Bounds:
        real = np.frombuffer(data, np.float64, n * (2 + near))
        whole = np.frombuffer(data, np.int32, n * (1 + near), offset=real.nbytes)
        return Bounds(whole[:n].copy(), real[:n].copy(), whole[n:].reshape(n, near).copy(), real[n : n * (1 + near)].reshape(n, near).copy(), real[n * (1 + near) :].copy())


def scan_all(x: np.ndarray, centroids: np.ndarray, near: int) -> Bounds:
    """Assignments by all distances, with bounds that are exact."""
    squares = np.stack([_squares(x, c) for c in centroids], axis=1)
    order = np.argsort(squares, axis=1, kind="stable")  # stable: of equal distances the smaller number
    far = np.sqrt(np.take_along_axis(squares, order, axis=1).astype(np.float64))
    rest = far[:, near + 1] if far.shape[1] > near + 1 else np.full(len(x), np.inf)
    return Bounds(order[:, 0].astype(np.int32), far[:, 0], order[:, 1 : near + 1].astype(np.int32), far[:, 1 : near + 1], rest)


def reassign(x: np.ndarray, b: Bounds, centroids: np.ndarray, moved: np.ndarray) -> int:
    """Assignments to ``centroids``, each having moved so far since the last ones; how many distances were taken."""
    near = b.near.shape[1]
    b.upper += moved[b.own]
    b.lower -= moved[b.near]
    b.rest -= moved.max(initial=0.0)
    least = lambda i: np.minimum(b.lower[i].min(axis=1, initial=np.inf), b.rest[i])
    sure = lambda upper, bound: upper * (1 + 1e-12) + SLACK < bound
    every = np.arange(len(x))
    doubt = every[~sure(b.upper, least(every))]
    own = _squares(x[doubt], centroids[b.own[doubt]])
    taken = len(doubt)
    b.upper[doubt] = np.sqrt(own.astype(np.float64))
    open_ = ~sure(b.upper[doubt], least(doubt))
    doubt, own = doubt[open_], own[open_]
    if not len(doubt):
        return taken
    # near centroids whose bounds don't certify are measured; the remainder must certify against the best of them
    best, who = own.copy(), b.own[doubt].copy()
    for z in range(near):
        measure = np.flatnonzero(~sure(b.upper[doubt], b.lower[doubt, z]))
        squares = _squares(x[doubt[measure]], centroids[b.near[doubt[measure], z]])
        taken += len(measure)
        b.lower[doubt[measure], z] = np.sqrt(squares.astype(np.float64))
        rival = b.near[doubt[measure], z]
        wins = (squares < best[measure]) | ((squares == best[measure]) & (rival < who[measure]))
        best[measure[wins]], who[measure[wins]] = squares[wins], rival[wins]
    upper = np.sqrt(best.astype(np.float64))
    certain = sure(upper, b.rest[doubt])
    swap = np.flatnonzero(certain & (who != b.own[doubt]))
    for z in range(near):  # the old own centroid takes the winner's place among the near ones
        here = swap[b.near[doubt[swap], z] == who[swap]]
        b.near[doubt[here], z], b.lower[doubt[here], z] = b.own[doubt[here]], b.upper[doubt[here]]
    b.own[doubt[swap]], b.upper[doubt[swap]] = who[swap], upper[swap]
    all_ = doubt[~certain]
    if len(all_):
        fresh = scan_all(x[all_], centroids, near)
        taken += len(all_) * len(centroids)
        for name in ("own", "upper", "near", "lower", "rest"):
            getattr(b, name)[all_] = getattr(fresh, name)
    return taken


def _chunk(ids: np.ndarray, x: np.ndarray, b: Bounds, measured: int) -> tuple:
    used = np.unique(b.own)
    sums = [[x[b.own == c].sum(axis=0).tolist(), int((b.own == c).sum())] for c in used]
    return ids.tobytes(), x.astype(np.int32).tobytes(), b.pack(), measured, used.tolist(), [n for _, n in sums], [t for t, _ in sums]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))]
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["ids", "vectors", "bounds", "measured", "centroid", "count", "total"])


def _whole(column: pa.Array, s: Settings) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(flat * s.scale).reshape(len(column), s.width)
    if np.abs(x).max(initial=0) >= MOST:
        raise ValueError(f"components beyond {MOST / s.scale:g} can't be clustered in 64-bit integers")
    return x.astype(np.int64)


def _kept(df: DataFrame, s: Settings) -> DataFrame:
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return df.where(F.coalesce((F.size("v") == s.width) & fine, F.lit(False)))


def cluster(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every vector that is kept.

    Kept are vectors of ``width`` components without nulls, NaNs or infinities; each component becomes floor(scale * x).
    The first centroids are the k kept rows with the smallest SHA-256 of "seed:id", null ids last, rows of one id in
    the order of their components; with fewer rows there are as many centroids. Repeated rows count and are returned each. A
    component from 2^27 / scale on raises. Ids are whole numbers. Further columns aren't read; without kept vectors the result is empty.
    """
    s, space, spark = settings, Workspace(df.sparkSession, "centroids"), df.sparkSession
    source = narrow(df, id=id_col, v=vector_col)
    kept = _kept(source.select("id", F.col("v").cast("array<double>").alias("v")), s)
    named = F.sha2(F.concat(F.lit(f"{s.seed}:"), F.col("id").cast("string")), 256)
    first = kept.orderBy(named.asc_nulls_last(), "v").limit(s.k).select("v").toArrow()
    centroids = _whole(first["v"].combine_chunks(), s) if first.num_rows else np.zeros((0, s.width), np.int64)
    k, near = len(centroids), max(0, min(s.near, len(centroids) - 1))
    kind = source.schema["id"].dataType.simpleString()
    if not k:
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    start = spark.sparkContext.broadcast(centroids)
    rows = kept.select(F.col("id").cast("bigint").alias("id"), "v")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, s.chunk):
                part = batch.slice(at, s.chunk)
                x = _whole(part.column("v"), s)
                ids = part.column("id")
                marked = np.stack([np.array(ids.fill_null(0)), np.array(ids.is_null()).astype(np.int64)])
                yield _batch([_chunk(marked, x, scan_all(x, start.value, near), len(x) * k)])

    state = space.save(rows.mapInArrow(released(begin), CHUNKS), "round-0")
    for turn in range(1, s.rounds + 1):
        before, centroids = centroids, _moved(state, centroids)
        ways = np.sqrt(((centroids - before) ** 2).sum(axis=1).astype(np.float64)) * (1 + 1e-12)
        shared = spark.sparkContext.broadcast((centroids, ways))

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            current, moved = shared.value
            for batch in batches:
                for ids, vectors, bounds in zip(*[batch.column(c).to_pylist() for c in ("ids", "vectors", "bounds")], strict=True):
                    marked = np.frombuffer(ids, np.int64).reshape(2, -1)
                    x = np.frombuffer(vectors, np.int32).reshape(-1, s.width).astype(np.int64)
                    b = Bounds.unpack(bounds, len(x), near)
                    taken = reassign(x, b, current, moved)
                    yield _batch([_chunk(marked, x, b, taken)])

        state = space.save(state.mapInArrow(released(step), CHUNKS), f"round-{turn}")
        space.drop(f"round-{turn - 1}")
    last = spark.sparkContext.broadcast(centroids)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors, bounds in zip(*[batch.column(c).to_pylist() for c in ("ids", "vectors", "bounds")], strict=True):
                marked = np.frombuffer(ids, np.int64).reshape(2, -1)
                x = np.frombuffer(vectors, np.int32).reshape(-1, s.width).astype(np.int64)
                own = Bounds.unpack(bounds, len(x), near).own
                yield pa.RecordBatch.from_arrays([pa.array(marked[0], mask=marked[1] == 1), pa.array(own), pa.array(_squares(x, last.value[own]))], names=["id", "cluster", "distance"])

    found = state.select("ids", "vectors", "bounds").mapInArrow(released(finish), "id bigint, cluster int, distance bigint")
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    of = {r.cluster: r.cluster_inertia for r in inertia}
    facts = spark.createDataFrame([(c, of.get(c, 0), sum(of.values()), marks[c]) for c in range(k)], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    out = found.join(F.broadcast(facts), "cluster")  # k rows
    return out.select(F.col("id").cast(kind).alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floors of the means; a centroid without vectors stays. k times width numbers reach the driver."""
    each = state.select(F.explode(F.arrays_zip("centroid", "count", "total")).alias("x"))
    sums = each.select(F.col("x.centroid").alias("c"), F.col("x.count").alias("n"), F.posexplode("x.total").alias("i", "t")).groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect()
    out = centroids.copy()
    for r in sums:
        out[r.c, r.i] = r.t // r.n
    return out
