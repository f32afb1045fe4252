"""Projective maps between matched points, for all groups at once and for groups of any size.

1. A bounded sample of each group's matches, the same in any partitioning, gives seeded hypotheses: maps of four
   matches, solved as one batch over groups and hypotheses. Those with the most sampled inliers go on.
2. All matches of a group vote for its hypotheses; votes are counted before they are shuffled.
3. The winner's inliers give the map of least algebraic error: normalised direct linear transform. Its normal matrix
   is made of 24 sums over inliers, taken in the frame of the sampled ones; the solver moves them to the frame of all.
"""

from __future__ import annotations

import functools
import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.pixels import square_to_quads
from lumenfold.sources.scratch import scratch


@dataclass(frozen=True)
class Settings:
    """``within``: an inlier's distance from where the map puts it; ``voted``: hypotheses a group that all matches vote for."""

    within: float = 3.0
    sample: int = 200
    hypotheses: int = 256
    voted: int = 6
    least: int = 4
    seed: int = 0


def four_point_maps(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Maps (... x 3 x 3) of four points to four (... x 4 x 2); NaN where there is none."""
    shape = source.shape[:-2]
    a, b = square_to_quads(source.reshape(-1, 4, 2)), square_to_quads(target.reshape(-1, 4, 2))
    det = np.linalg.det(np.nan_to_num(a))
    solvable = np.isfinite(a).all(axis=(1, 2)) & np.isfinite(b).all(axis=(1, 2)) & (np.abs(det) > 1e-12)
    out = np.full((len(a), 3, 3), np.nan)
    out[solvable] = b[solvable] @ np.linalg.inv(a[solvable])
    with np.errstate(all="ignore"):
        return (out / out[:, 2:, 2:]).reshape(*shape, 3, 3)


def _misses(maps: np.ndarray, points: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Distances (maps x points) between mapped points and their targets; NaN maps miss by infinity."""
    moved = maps.reshape(-1, 3) @ np.concatenate([points, np.ones((len(points), 1))], axis=1).T
    u, v, w = np.moveaxis(moved.reshape(-1, 3, len(points)), 1, 0)
    with np.errstate(all="ignore"):
        u, v = u / w - target[:, 0], v / w - target[:, 1]
        far = np.sqrt(u * u + v * v)
    return np.where(np.isfinite(far), far, np.inf)


def _frames(points: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Centre and factor to a mean squared distance of 2 from it (n x 3) of each row's chosen points."""
    share = inside / np.maximum(inside.sum(axis=1, keepdims=True), 1)
    centre = share @ points
    spread = (share * ((points[None] - centre[:, None]) ** 2).sum(axis=2)).sum(axis=1)
    return np.column_stack([centre, np.sqrt(2 / np.where(spread > 0, spread, 2))])


def _proposed(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """The ``voted`` best maps of each sample, and frames of their inliers."""
    for batch in batches:
        keys, maps, frames = [], [], []
        listed = batch.column("matches")
        ends = listed.offsets.to_numpy() - listed.offsets[0].as_py()
        flat = listed.flatten()
        whole = np.column_stack([pc.struct_field(flat, n).to_numpy(zero_copy_only=False) for n in "xyuv"])
        for group, start, end in zip(batch.column("key").to_pylist(), ends[:-1], ends[1:], strict=True):
            m = whole[start:end]
            if len(m) < 4:
                continue
            rng = np.random.default_rng([s.seed, zlib.crc32(group.encode())])
            # four different matches a hypothesis: the first places of a random order each
            chosen = np.argpartition(rng.random((s.hypotheses, len(m))), 3, axis=1)[:, :4]
            made = four_point_maps(m[chosen, :2], m[chosen, 2:])
            inside = _misses(made, m[:, :2], m[:, 2:]) <= s.within
            votes = inside.sum(axis=1)
            best = np.lexsort([np.arange(len(votes)), -votes])[: s.voted]
            best = best[np.isfinite(made[best]).all(axis=(1, 2))]
            if not len(best):
                continue
            keys.append(group)
            maps.append(made[best].reshape(-1, 9).tolist())
            frames.append(np.concatenate([_frames(m[:, :2], inside[best]), _frames(m[:, 2:], inside[best])], axis=1).tolist())
        numbers = pa.list_(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(maps, numbers), pa.array(frames, numbers)], names=["key", "maps", "frames"])


def _mapped(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    w = h[6] * x + h[7] * y + h[8]
    w = F.nullif(w, F.lit(0.0))
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def _miss(h: Column) -> Column:
    u, v = _mapped(h, F.col("x"), F.col("y"))
    return F.sqrt((u - F.col("u")) ** 2 + (v - F.col("v")) ** 2)


PRODUCTS = ("pp", "pq", "p", "qq", "q", "")  # of the points: the upper half of a symmetric matrix
WEIGHTS = ("", "r", "t", "w")  # each product by: 1, a target's two coordinates, the sum of their squares


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maps from sums over inliers in a frame near their own; the sums are moved to the inliers' own frame first."""
    upper = np.triu_indices(3)
    for batch in batches:
        n, one, zero = batch.num_rows, np.ones(batch.num_rows), np.zeros(batch.num_rows)
        cx, cy, kx, cu, cv, ku = batch.column("frame").flatten().to_numpy(zero_copy_only=False).reshape(n, 6).T
        matrix = {}
        for weight in WEIGHTS:
            m = np.zeros((n, 3, 3))
            m[:, upper[0], upper[1]] = np.stack([batch.column(f"n{weight}_{product}").to_numpy(zero_copy_only=False) for product in PRODUCTS], axis=1)
            matrix[weight] = m + np.triu(m, 1).transpose(0, 2, 1)
        frame = lambda cx, cy, k: np.stack([np.stack([k, zero, -k * cx], 1), np.stack([zero, k, -k * cy], 1), np.stack([zero, zero, one], 1)], 1)
        plain, r, t, w = (matrix[weight] for weight in WEIGHTS)
        with np.errstate(all="ignore"):
            count = plain[:, 2, 2]
            x, y, u, v = plain[:, 0, 2] / count, plain[:, 1, 2] / count, r[:, 2, 2] / count, t[:, 2, 2] / count
            k = np.sqrt(2 / ((plain[:, 0, 0] + plain[:, 1, 1]) / count - x * x - y * y))
            j = np.sqrt(2 / (w[:, 2, 2] / count - u * u - v * v))
            own = frame(x, y, k)
            moved = lambda m: own @ m @ own.transpose(0, 2, 1)
            u, v, j = (c[:, None, None] for c in (u, v, j))
            w = moved(j * j * (w - 2 * u * r - 2 * v * t + (u * u + v * v) * plain))
            r, t, plain = moved(j * (r - u * plain)), moved(j * (t - v * plain)), moved(plain)
            blank = np.zeros((n, 3, 3))
            normal = np.block([[plain, blank, -r], [blank, plain, -t], [-r, -t, w]])
            fine = np.isfinite(normal).all(axis=(1, 2))
            _, vectors = np.linalg.eigh(np.where(fine[:, None, None], normal, 0))
            h = vectors[:, :, 0].reshape(-1, 3, 3)
            source = own @ frame(cx, cy, kx)
            target = frame(u[:, 0, 0], v[:, 0, 0], j[:, 0, 0]) @ frame(cu, cv, ku)
            fine &= np.isfinite(source).all(axis=(1, 2)) & np.isfinite(target).all(axis=(1, 2))
            h = np.linalg.inv(np.where(fine[:, None, None], target, np.eye(3))) @ h @ source
            h = (h / h[:, 2:, 2:]).reshape(-1, 9)
        fine &= np.isfinite(h).all(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([row if ok else None for row, ok in zip(h.tolist(), fine, strict=True)], pa.list_(pa.float64()))], names=["key", "h"])


def fit_homographies(matches: DataFrame, group: str, x: Column, y: Column, u: Column, v: Column, settings: Settings = Settings()) -> DataFrame:
    """group, h (row-major, 1 at its end), matches, inliers, miss (root mean square over the inliers) of every group.

    x, y are mapped to u, v. Matches with a null or non-finite coordinate aren't counted; a null group is a group. A group
    of fewer than ``least`` matches or inliers, or whose points allow no map, has a null h and its other columns still:
    inliers 0 and miss null. Repeated matches count each. The same matches give the same map in any partitioning.
    """
    s, spark = settings, matches.sparkSession
    where = scratch(spark, "homographies")

    def save(df: DataFrame, name: str) -> DataFrame:
        """One row a group, of known size: no step is done twice, and small tables are sent instead of shuffling all matches."""
        df.write.parquet(f"{where}/{name}")
        return spark.read.schema(df.schema).parquet(f"{where}/{name}")

    kind = matches.schema[group].dataType
    rows = matches.select(F.col(group).alias("group"), *[c.cast("double").alias(n) for n, c in (("x", x), ("y", y), ("u", u), ("v", v))])
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit("")))
    # a filter doesn't share subexpressions: each coordinate, which may be a long expression, is named once
    whole = F.col("x") * 0.0 + F.col("y") * 0.0 + F.col("u") * 0.0 + F.col("v") * 0.0 == 0.0
    fine = rows.where(whole).select("key", "x", "y", "u", "v")
    sizes = save(rows.groupBy("key").agg(F.first("group").alias("group"), F.count_if(whole).alias("matches")), "sizes")
    # the sample: all matches of a small group, about ``sample`` of a large one, drawn by a hash of the match itself
    drawn = F.pmod(F.xxhash64(F.lit(s.seed), "x", "y", "u", "v"), F.lit(1 << 20)) * F.col("matches") < s.sample * (1 << 20)
    sampled = fine.join(sizes.select("key", "matches"), "key").where((F.col("matches") <= s.sample) | drawn)
    # repeated matches are drawn together; one of each will do for hypotheses, so a sample stays bounded
    listed = sampled.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("x", "y", "u", "v"))).alias("matches"))
    maps = save(listed.mapInArrow(lambda b: _proposed(b, s), "key string, maps array<array<double>>, frames array<array<double>>"), "maps")
    # a match meets its group once; hypotheses are told apart behind the join, in code short enough to be compiled
    voted = fine.join(maps.select("key", "maps"), "key").select("key", "x", "y", "u", "v", F.posexplode("maps").alias("number", "map"))
    votes = voted.where(_miss(F.col("map")) <= s.within).groupBy("key", "number").agg(F.count("*").alias("votes"))
    best = votes.groupBy("key").agg(F.max(F.struct("votes", (-F.col("number")).alias("order"))).alias("best")).where(F.col("best.votes") >= s.least)
    number = -F.col("best.order")
    winner = save(maps.join(best, "key").select("key", F.col("maps")[number].alias("map"), F.col("frames")[number].alias("frame")), "winner")
    inside = fine.join(winner, "key").where(_miss(F.col("map")) <= s.within)
    f = F.col("frame")
    inside = inside.select("key", *[((F.col(c) - f[i]) * f[k]).alias(n) for n, c, i, k in (("p", "x", 0, 2), ("q", "y", 1, 2), ("r", "u", 3, 5), ("t", "v", 4, 5))])
    inside = inside.withColumn("w", F.col("r") * F.col("r") + F.col("t") * F.col("t"))
    term = lambda names: functools.reduce(operator.mul, [F.col(n) for n in names], F.lit(1.0))
    summed = inside.groupBy("key").agg(*[F.sum(term(weight + product)).alias(f"n{weight}_{product}") for weight in WEIGHTS for product in PRODUCTS])
    summed = summed.join(winner.select("key", "frame"), "key")
    solved = save(summed.mapInArrow(_solved, "key string, h array<double>").where("h is not null"), "solved")
    scored = fine.join(solved, "key").select("key", _miss(F.col("h")).alias("miss")).where(F.col("miss") <= s.within)
    scored = scored.groupBy("key").agg(F.count("*").alias("inliers"), F.sqrt(F.avg(F.col("miss") * F.col("miss"))).alias("miss")).where(F.col("inliers") >= s.least)
    out = sizes.join(scored.join(solved, "key"), "key", "left")
    return out.select(F.col("group").cast(kind).alias(group), "h", "matches", F.coalesce("inliers", F.lit(0).cast("bigint")).alias("inliers"), "miss")
