"""Retrieval evaluation and embedding quality on top of nearest-neighbour rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.relational import exact_percentiles

CUTS = (1, 3, 10)


def truth_ranks(found: DataFrame, queries: DataFrame, same: Column) -> DataFrame:
    """query_id, true_rank: the first rank at which ``same`` holds, or null; queries without neighbours are kept."""
    ranks = found.groupBy("query_id").agg(F.min(F.when(same, F.col("rank"))).alias("true_rank"))
    return queries.select(F.col("id").alias("query_id")).join(ranks, "query_id", "left")


def recall(ranks: DataFrame, by: list[str], cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """correct, total and accuracy at each cut; 0.0 for no queries at all."""
    sums = ranks.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col("true_rank") <= k).alias(f"c{k}") for k in cuts])
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("topk"), F.col(f"c{k}").alias("correct")) for k in cuts])).alias("x")
    stacked = sums.select(*by, "total", each).select(*by, "x.topk", "x.correct", "total")
    return stacked.withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0))


def top_lists(found: DataFrame) -> DataFrame:
    """query_id, top_ids, top_scores, best first."""
    rows = F.sort_array(F.collect_list(F.struct("rank", "id", "score")))
    return found.groupBy("query_id").agg(rows.alias("r")).select("query_id", F.col("r.id").alias("top_ids"), F.col("r.score").alias("top_scores"))


def percentile_profile(df: DataFrame, column: str, whole: bool) -> DataFrame:
    """Exact percentiles 0, 10, 25, 50, 75, 90, 100, interpolated; bit distances are cut to whole numbers."""
    at = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    values = exact_percentiles(df, [], column, at)
    pick = lambda i: F.col("p")[i].cast("bigint") if whole else F.round(F.col("p")[i], 6)
    return values.select(*[pick(i).alias(f"p{int(q * 100)}") for i, q in enumerate(at)])


def confounders(pairs: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n unordered pairs (id, other): each pair once, at its best place."""
    keyed = pairs.withColumns({"a": F.least("query_id", "id"), "b": F.greatest("query_id", "id")})
    once = keyed.groupBy("a", "b").agg(F.max("score").alias("score"))
    return once.orderBy(*order).limit(n)
