"""Registering queries, and the fixture tables in the engine's terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.hashing import art_id
from lumenfold.sources import table

Query = Callable[[SparkSession, str], DataFrame]


def registrar(registry: dict[str, tuple[Query, str | None]]):
    """A decorator that files a query under its function's name, with the SQL that gives the same rows."""

    def query(sql: str | None):
        def add(f: Query) -> Query:
            registry[f.__name__] = (f, sql)
            return f

        return add

    return query


# The same fixtures for Spark and, as sub-selects, for SQL.
SET_SQL = "lower(replace(p_brand, 'Brand#', 'b'))"
CARDS = f"(SELECT p_partkey AS card_id, p_name AS name, {SET_SQL} AS set_code, p_type AS layout, p_size AS number, p_retailprice AS price, substr(sha1(p_name || '|' || p_type), 1, 16) AS art_id FROM part)"
FRAMES = "(SELECT l_orderkey AS video_id, l_partkey AS card_id, l_linenumber AS line, CAST(l_quantity AS BIGINT) AS matches, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) % 33 END AS dist, l_discount AS area, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)"
VIDEOS = "(SELECT o_orderkey AS video_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'error' END AS status, o_orderpriority AS channel, o_orderdate AS added FROM orders)"
RUNS = "(SELECT event_id AS seq, ts AS run_at, event_type AS variant, user_id % 5 AS dataset, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS topk, value AS accuracy FROM events)"


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("card_id"),
        F.col("p_name").alias("name"),
        F.lower(F.replace("p_brand", F.lit("Brand#"), F.lit("b"))).alias("set_code"),
        F.col("p_type").alias("layout"),
        F.col("p_size").alias("number"),
        F.col("p_retailprice").alias("price"),
        art_id(F.col("p_name"), F.col("p_type")).alias("art_id"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = F.col("l_quantity").cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("video_id"),
        F.col("l_partkey").alias("card_id"),
        F.col("l_linenumber").alias("line"),
        matches.alias("matches"),
        F.when(F.col("l_linenumber") % 5 != 0, matches % 33).alias("dist"),
        F.col("l_discount").alias("area"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("error")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), status.alias("status"), F.col("o_orderpriority").alias("channel"), F.col("o_orderdate").alias("added"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint") % 3
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").alias("run_at"), F.col("event_type").alias("variant"), (F.col("user_id") % 5).alias("dataset"), k.alias("topk"), F.col("value").alias("accuracy"))
