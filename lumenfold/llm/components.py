"""Connected components of an edge table by alternating large and small stars, with no link on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame, space: Workspace, tag: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being the smallest node that it reaches, itself included.

    Each round is written to the shared folder, so that plans stay short and a lost executor costs one round. A
    node's neighbours are only ever joined and aggregated, never gathered, so a hub of any size is no single task's
    load. Null ends and self loops are ignored; an edge table without rows gives no rows. Should rounds not settle in
    ``rounds``, it raises.
    """
    current = space.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{tag}-0")
    before = _digest(current)
    for i in range(1, rounds + 1):
        after = space.save(_small_star(_large_star(current)), f"{tag}-{i}")
        digest = _digest(after)
        space.drop(f"{tag}-{i - 1}")
        current = after
        if digest == before:
            break
        before = digest
    else:
        raise RuntimeError(f"components don't settle within {rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
    return tuple(row)
