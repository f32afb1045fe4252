"""Shared pieces of the training-data operators: scratch tables, input sizes, batches bounded in bytes."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SWEPT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode without it a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = tempfile.mkdtemp(prefix="lumenfold-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


class Workspace:
    """Written tables in the shared folder, which cut lineage and outlive lost executors.

    Tables are removed by ``drop`` or, as lazy results may still read them, when the driver's Python ends. ``tight``:
    tables are compressed further, and a write's shuffle files go when it ends instead of with the driver's garbage.
    """

    def __init__(self, spark: SparkSession, tag: str, tight: bool = False):
        self.spark, self.tight = spark, tight
        self.root = f"{shared_dir(spark).rstrip('/')}/lumenfold-{tag}-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)
        release()  # what operators before have left in the driver, the JVM's part that Python held on to included

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        if self.tight:
            before = self.spark.conf.get(SWEPT)
            self.spark.conf.set(SWEPT, "true")
            try:
                df.write.mode("overwrite").option("compression", "zstd").parquet(path)
            finally:
                self.spark.conf.set(SWEPT, before)
        else:
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of all texts, for numbers of blocks that follow the input."""
    return df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0


def blocks_for(total: int, each: int, least: int = 1) -> int:
    return max(least, -(-total // each))


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def bounded(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            n = n or 0
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


@functools.cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give memory that isn't used any more back to the system; workers are kept for other tasks and operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


# What this worker has kept for later tasks of an operator, to be dropped when another operator's begins.
KEPT: dict[str, Callable[[], None]] = {}


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with the task's memory given back at its end, and what other operators kept at its start."""
    name = run.__module__

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for other in [k for k in KEPT if k != name]:
            KEPT.pop(other)()
        try:
            yield from run(batches)
        finally:
            release()

    return running


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under internal names, so that further columns can't clash: narrow(df, id="doc_id")."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])
