"""Upserts, first and last writes, deltas, resolution, splits: relational operators that have no name in Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_write(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the last by ``order`` (nulls first): upsert of a log. Partial aggregation, no sort of groups."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in df.columns])


def first_write(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in df.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, those of ``new`` in place of old ones with their keys; schemas may differ by columns."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return last_write(both, keys, ["__new"]).drop("__new")


def update_by_key(df: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Set columns where a change has a value; rows without a change stay."""
    new = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = df.join(new, keys, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def delete_by_key(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone, keys, "left_anti")


def where_all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """The conjunction of the conditions given; None is no condition."""
    given = [c for c in conditions if c is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def by_ids(df: DataFrame, key: str, ids: list, most: int = 1000) -> DataFrame:
    """Rows whose key is in a list: a filter for short lists, a semi join for long ones; nothing for none."""
    if len(ids) <= most:
        return df.where(F.col(key).isin(ids)) if ids else df.limit(0)
    kind = df.schema[key].dataType
    return df.join(df.sparkSession.createDataFrame([(i,) for i in ids], f"{key} {kind.simpleString()}"), key, "left_semi")


def public_fields(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def resolve(records: DataFrame, catalog: DataFrame, keys: list[str], record_id: str, card_id: str, art: str) -> DataFrame:
    """Each record's match in a catalog: not_found, resolved, ambiguous_same_art (several cards, one art) or ambiguous.

    Matches without art say nothing about it: several are of one art if those with art agree, ambiguous if none has any.
    The smallest card id stands for a group that is resolved.
    """
    art_of = F.nullif(F.col(art), F.lit(""))
    # the catalog is counted by key before the join, so that no record meets its candidates one by one
    grouped = catalog.groupBy(*keys).agg(F.count(card_id).alias("n"), F.countDistinct(art_of).alias("arts"), F.min(card_id).alias("first"))
    found = records.join(grouped, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("n") == 0, "not_found").when(F.col("n") == 1, "resolved").when(F.col("arts") == 1, "ambiguous_same_art").otherwise("ambiguous")
    return found.select(record_id, "n", status.alias("status"), F.when(status.isin("resolved", "ambiguous_same_art"), F.col("first")).alias(card_id))


def at_least(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows of groups of n rows or more."""
    kept = df.groupBy(*keys).count().where(F.col("count") >= n).select(*keys)
    return df.join(kept, keys, "left_semi")


def cache_diff(manifest: DataFrame, cache: DataFrame, key: str, stamp: str) -> DataFrame:
    """(reused, added, removed): what an incremental build keeps, computes and drops; a changed stamp counts as added."""
    m, c = manifest.select(key, F.col(stamp).alias("new")), cache.select(key, F.col(stamp).alias("old"))
    both = m.join(c, key, "full")
    return both.agg(
        F.count_if(F.col("new").isNotNull() & F.col("new").eqNullSafe(F.col("old"))).alias("reused"),
        F.count_if(F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("old"))).alias("added"),
        F.count_if(F.col("new").isNull()).alias("removed"),
    )


def running_before(df: DataFrame, key: str, order: str, amount: str, width: int = 1 << 16) -> DataFrame:
    """n and before: how many rows of the key come before a row, and their sum, in the order of a whole number.

    Ranges of ``width`` numbers are summed up first, so that a window holds one range of a key, or one row for each of a
    key's ranges, however many rows the key has. Rows with equal numbers must not repeat within a key.
    """
    part = F.floor(F.col(order) / width)
    ranges = df.groupBy(key, part.alias("__part")).agg(F.count("*").alias("__rows"), F.sum(amount).alias("__sum"))
    earlier = W.partitionBy(key).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.select(key, "__part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("__rows", "__sum")])
    inside = W.partitionBy(key, "__part").orderBy(order)
    ranked = df.withColumn("__part", part).select("*", (F.row_number().over(inside) - 1).alias("__nth"), F.coalesce(F.sum(amount).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__own"))
    found = ranked.join(starts, [key, "__part"])
    return found.select(*df.columns, (F.col("__rows") + F.col("__nth")).cast("bigint").alias("n"), (F.col("__sum") + F.col("__own")).cast("bigint").alias("before"))


def exact_percentiles(df: DataFrame, keys: list[str], column: str, at: list[float], accuracy: int = 10000) -> DataFrame:
    """keys, n, and p: the interpolated percentiles of a column in the order asked for; nulls and NaN don't count.

    Sketches of bounded size bracket each percentile; one pass then counts what lies below a bracket and each value within,
    about 8 / accuracy of a group's rows, of which a window adds up the counts. No task holds the values of a whole group,
    a group without values gives no row, and a bracket that misses its rank raises.
    """
    value, one = F.col("__v"), [F.lit(0).alias("__k")]
    named = [F.col(k) for k in keys] or one
    by = keys or ["__k"]
    rows = df.select(*named, F.col(column).cast("double").alias("__v")).where(value.isNotNull() & ~F.isnan(value))
    slack = 4 / accuracy
    edges = sorted({min(1.0, max(0.0, p + d)) for p in at for d in (-slack, slack)})
    marks = rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx(value, edges, accuracy).alias("__q"), F.min(value).alias("__min"), F.max(value).alias("__max"))
    edge = lambda p: F.col("__q")[edges.index(min(1.0, max(0.0, p)))]
    small = F.col("n") <= accuracy  # a sketch's ranks are too coarse for these
    span = lambda i, p: F.struct(F.lit(i).alias("i"), F.when(small | (p <= slack), F.col("__min")).otherwise(edge(p - slack)).alias("lo"), F.when(small | (p >= 1 - slack), F.col("__max")).otherwise(edge(p + slack)).alias("hi"), ((F.col("n") - 1) * p).alias("rank"))
    spans = marks.select(*[F.col(k).alias(f"__{k}") for k in by], "n", F.array(*[span(i, p) for i, p in enumerate(at)]).alias("__spans"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by])
    near = rows.join(spans, same).select(*by, "n", "__v", F.explode("__spans").alias("s")).where(value <= F.col("s.hi"))
    counts = near.groupBy(*by, "n", "s.i", "s.rank", F.when(value >= F.col("s.lo"), value).alias("__v")).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(W.partitionBy(*by, "i").orderBy(F.asc_nulls_first("__v")))
    held = lambda place: F.max(F.when((F.col("__upto") - F.col("__c") <= place) & (place < F.col("__upto")), value))
    low, high, part = held(F.floor("rank")), held(F.ceil("rank")), F.max(F.col("rank") - F.floor("rank"))
    found = counts.withColumn("__upto", upto).groupBy(*by, "n", "i").agg(low.alias("low"), high.alias("high"), part.alias("part"))
    missed = F.col("low").isNull() | F.col("high").isNull()
    exact = F.when(missed, F.raise_error(F.lit("a percentile lies outside its bracket")).cast("double")).otherwise((1 - F.col("part")) * F.col("low") + F.col("part") * F.col("high"))
    lists = found.select(*by, "n", F.struct("i", exact.alias("p")).alias("r")).groupBy(*by, "n").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return lists.select(*keys, "n", F.col("r.p").alias("p"))


def dense_index(df: DataFrame, column: str, name: str, folder: str, partitions: int | None = None) -> DataFrame:
    """(column, name): the distinct values that aren't null, numbered from 0 in their order.

    Values are sorted by ranges and written to ``folder``, each with its place in its range, so that a task holds one range
    only and a range lost is read again as it was; the ranges' sizes, one a range, give where each begins.
    """
    spark = df.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(count, column).withColumn("__range", F.spark_partition_id())
    ranged.write.mode("overwrite").parquet(folder)
    kept = spark.read.schema(ranged.schema).parquet(folder)
    sizes = kept.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__range", before.alias("__start"))
    inside = F.row_number().over(W.partitionBy("__range").orderBy(column)) - 1
    placed = kept.withColumn("__place", inside).join(F.broadcast(starts), "__range")  # a row a range
    return placed.select(column, (F.col("__start") + F.col("__place")).cast("bigint").alias(name))


def topk_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows a group; Spark prunes each partition to k rows before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint")).where(F.col(rank) <= k)
