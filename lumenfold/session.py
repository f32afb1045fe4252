"""Session construction and engine configuration."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class EngineConfig:
    """Roots and Spark settings; explicit arguments win over environment variables, which win over defaults."""

    data_root: str = field(default_factory=lambda: os.environ.get("LUMENFOLD_DATA", "/root/testdata/sf0.001"))
    shuffle_partitions: int | None = None
    extra: dict[str, str] = field(default_factory=dict)


def build_session(app: str = "lumenfold", master: str | None = None, config: EngineConfig | None = None) -> SparkSession:
    """A session with UTC, AQE (coalescing and skew joins) and Arrow; ``master`` is left to spark-submit unless given."""
    config = config or EngineConfig()
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if config.shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(config.shuffle_partitions)
    for key, value in (settings | config.extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
