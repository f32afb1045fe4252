"""Operators that need order or outside code: greedy frame sampling, per-row retries, zip entries."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_frames(df: DataFrame, key: str, at_ms: str, every_ms: int) -> DataFrame:
    """Frames at least ``every_ms`` after the last one kept, for each key in order of time; the first is always kept.

    Sorted partitions are streamed; the state is one number. Frames with equal times count once.
    """
    source = df.select(F.col(key).cast("bigint").alias("key"), F.col(at_ms).cast("bigint").alias("at")).where("at is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = object(), 0
        for batch in batches:
            kept = []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("at").to_pylist(), strict=True):
                keep = k != current or t - last >= every_ms
                if keep:
                    current, last = k, t
                kept.append(keep)
            yield batch.filter(pa.array(kept, pa.bool_()))

    dealt = source.repartition("key").sortWithinPartitions("key", "at")
    return dealt.mapInArrow(run, "key bigint, at bigint").select(F.col("key").alias(key), F.col("at").alias(at_ms))


def _labelled(texts: list[str], classify: Callable[[list[str]], list[str]], refused: str) -> list[str]:
    """Labels in the order of ``texts``. Spans that wait for a label lie on a stack; one that fails is parted in two."""
    out, waiting = [refused] * len(texts), [range(len(texts))]
    while waiting:
        span = waiting.pop()
        if not span:
            continue
        try:
            found = list(classify(texts[span.start : span.stop]))
        except Exception:  # noqa: BLE001  the classifier is the caller's
            found = []
        if len(found) == len(span):
            out[span.start : span.stop] = found
        elif len(span) > 1:
            cut = span.start + len(span) // 2
            waiting += [range(span.start, cut), range(cut, span.stop)]
    return out


def classify_rows(df: DataFrame, text_col: str, classify: Callable[[list[str]], list[str]], refused: str = "refused") -> DataFrame:
    """Exactly one label a row, whatever the classifier does with a batch; rows that fail alone get ``refused``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(label=_labelled(frame[text_col].fillna("").tolist(), classify, refused))

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", label string"
    return df.mapInPandas(run, schema)


def zip_entries(archives: DataFrame, suffix: str = ".jpg", skip: str = "__MACOSX") -> DataFrame:
    """(path, name, size, content) of entries of zip files read with Spark's binaryFile source."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for entry in z.infolist():
                        if entry.filename.lower().endswith(suffix) and skip not in entry.filename:
                            yield pd.DataFrame({"path": [path], "name": [entry.filename], "size": [entry.file_size], "content": [z.read(entry)]})

    return archives.select("path", "content").mapInPandas(run, "path string, name string, size bigint, content binary")
