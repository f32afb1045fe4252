"""The fixture tables, read with Spark's own reader so that any path Spark can open will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
    "clicks", "sales", "sale_lines", "clients", "client_changes", "vendors", "items", "stamps",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; zone-less timestamps become UTC timestamps, which event-time operators need."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(zoneless) if zoneless else df


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, name) for name in names]
