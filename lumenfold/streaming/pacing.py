"""Pacing of frames: at most so many a second, at most one in flight, and frames that come meanwhile are dropped."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Pacer:
    """Gate in front of a slow consumer: ``offer`` sends a frame, or drops it while one is in flight or it comes too early."""

    def __init__(self, send: Callable[[Any], None], rate: float = 3.0):
        self.send, self.gap_ms = send, 1000 / rate
        self.busy, self.last, self.dropped, self.lock = False, None, 0, threading.Lock()

    def offer(self, at_ms: float, frame: Any) -> bool:
        with self.lock:
            if self.busy or self.last is not None and at_ms - self.last < self.gap_ms:
                self.dropped += 1
                return False
            self.busy, self.last = True, at_ms
        try:
            self.send(frame)
        finally:
            with self.lock:
                self.busy = False
        return True


def paced(df: DataFrame, key: str, at_ms: str, took_ms: str, every_ms: int) -> DataFrame:
    """The same over a recorded table: frames that would have been sent, for each key in order of time.

    A frame is dropped if it comes less than ``every_ms`` after the last one sent, or before that one, which takes
    ``took_ms``, was done. Sorted partitions are streamed; the state is two numbers. Null times are dropped.
    """
    source = df.select(F.col(key).cast("bigint").alias("key"), F.col(at_ms).cast("bigint").alias("at"), F.coalesce(F.col(took_ms).cast("bigint"), F.lit(0)).alias("took")).where("at is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, free = object(), 0
        for batch in batches:
            kept = []
            for k, at, took in zip(*(batch.column(n).to_pylist() for n in ("key", "at", "took")), strict=True):
                if k != current:
                    current, free = k, at
                kept.append(at >= free)
                if at >= free:
                    free = at + max(took, every_ms)
            yield batch.filter(pa.array(kept, pa.bool_()))

    dealt = source.repartition("key").sortWithinPartitions("key", "at", "took")
    return dealt.mapInArrow(run, "key bigint, at bigint, took bigint").toDF(key, at_ms, took_ms)
