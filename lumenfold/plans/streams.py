"""Streams over the shop's clicks, sunk exactly once."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.plans.base import registrar
from lumenfold.sources import table
from lumenfold.sources.scratch import scratch
from lumenfold.streaming.sink import OnceSink

REGISTRY: dict[str, tuple] = {}
query = registrar(REGISTRY)


@query("SELECT click_id, client_id, kind, value FROM clicks WHERE kind IS NOT NULL AND value >= 1")
def clicks_sunk_once(spark, sf_dir):
    """Clicks streamed file by file through a gate into the sink, by two runs on one checkpoint; the second finds nothing new."""
    schema = table(spark, sf_dir, "clicks").schema
    where = scratch(spark, "sink")
    sink = OnceSink(spark, f"{where}/sink")
    for _ in range(2):
        # a pattern, so that a single file will do as well as a folder
        clicks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/clicks.parque[t]")
        kept = clicks.where(F.col("kind").isNotNull() & (F.col("value") >= 1)).select("click_id", "client_id", "kind", "value")
        sink.start(kept, f"{where}/checkpoint").awaitTermination()
    return sink.read(kept.schema)
