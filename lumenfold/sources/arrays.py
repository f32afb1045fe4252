"""NumPy archives of embeddings as tables, and back: galleries and caches with a fingerprint."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.sources.files import _filesystem

ROWS = "file string, position bigint, id string, path string, embedding array<float>, fingerprint string"


def read_npz(spark: SparkSession, path: str, ids: str = "card_ids", vectors: str = "embeddings", batch: int = 4096) -> DataFrame:
    """file, position, id, path, embedding, fingerprint for each vector of one or more archives.

    An archive is read by one task and streamed in batches. Keys that an archive lacks (ids, paths, fingerprint) give
    nulls; pickled arrays are refused, as they run code when loaded; a broken archive or one without vectors gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for name, content in zip(part.column("path").to_pylist(), part.column("content").to_pylist(), strict=True):
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as held:
                        found = {k: held[k] for k in (ids, vectors, "paths", "fingerprint") if k in held.files}
                except (ValueError, OSError, KeyError, EOFError):
                    continue
                if vectors not in found or found[vectors].ndim != 2:
                    continue
                rows = found[vectors].astype(np.float32)
                mark = str(found["fingerprint"]) if "fingerprint" in found else None
                texts = {k: found[k].astype(str).tolist() if k in found and len(found[k]) == len(rows) else [None] * len(rows) for k in (ids, "paths")}
                for at in range(0, len(rows), batch):
                    some = rows[at : at + batch]
                    n, width = some.shape
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(some.reshape(-1), pa.float32()))
                    columns = [pa.array([name] * n), pa.array(np.arange(at, at + n)), pa.array(texts[ids][at : at + batch], pa.string()), pa.array(texts["paths"][at : at + batch], pa.string()), flat, pa.array([mark] * n, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "position", "id", "path", "embedding", "fingerprint"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ROWS)


def _archive(rows: pa.Table, fingerprint: str) -> bytes:
    """Columns id and v as one compressed archive; the vectors' own buffer is taken as it is."""
    flat = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    data = io.BytesIO()
    np.savez_compressed(data, embeddings=flat.astype(np.float32, copy=False).reshape(rows.num_rows, -1), card_ids=np.array(rows["id"].to_pylist(), np.str_), fingerprint=np.str_(fingerprint))
    return data.getvalue()


def _named(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where("id is not null and v is not null")


def write_npz(df: DataFrame, path: str, id_col: str, vector_col: str, fingerprint: str = "", most: int = 1 << 20) -> None:
    """One compressed archive for tools outside: ids and vectors in the order of ids, and a fingerprint.

    An archive is one file in one process, so a table of more than ``most`` rows is refused; ``write_npz_parts`` takes those.
    """
    rows = _named(df, id_col, vector_col).limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError(f"more than {most} vectors for an archive")
    fs, where = _filesystem(df.sparkSession, path)
    out = fs.create(where, True)
    try:
        out.write(_archive(rows.sort_by("id"), fingerprint))
    finally:
        out.close()


def write_npz_parts(df: DataFrame, folder: str, id_col: str, vector_col: str, fingerprint: str = "", partitions: int = 200, rows: int = 1 << 16) -> DataFrame:
    """Archives of at most ``rows`` vectors below a folder, written by the tasks; (file, n) of each.

    The names' order is the order of ids. A task holds one archive's rows; a lost one writes the same files again, and a
    file has its name only once it is whole. Repeated ids are kept; the folder, a path or URI that Arrow knows, should be new.
    """
    schema = pa.schema([("file", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as stores
        from pyspark import TaskContext

        own = TaskContext.get()
        store, root = stores.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        held, size, made = [], 0, 0

        def write(part: pa.Table) -> pa.RecordBatch:
            name = f"part-{own.partitionId():05d}-{made:05d}.npz"
            draft = f"{root}/.{name}.{own.taskAttemptId()}"
            with store.open_output_stream(draft) as out:
                out.write(_archive(part, fingerprint))
            store.move(draft, f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"file": [f"{folder.rstrip('/')}/{name}"], "n": [part.num_rows]}, schema=schema)

        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            while size >= rows:
                whole = pa.Table.from_batches(held)
                yield write(whole.slice(0, rows))
                made += 1
                held, size = whole.slice(rows).to_batches(), size - rows
        if size:
            yield write(pa.Table.from_batches(held))

    ordered = _named(df, id_col, vector_col).repartitionByRange(partitions, "id").sortWithinPartitions("id")
    done = ordered.mapInArrow(run, "file string, n bigint").toArrow()  # a row a file
    return df.sparkSession.createDataFrame(done.sort_by("file"), "file string, n bigint")


def usable_cache(cache: DataFrame, fingerprint: str, paths: DataFrame) -> DataFrame:
    """Cached vectors that still hold: made under this fingerprint, of a path that is still in the manifest."""
    return cache.where(F.col("fingerprint") == fingerprint).join(paths.select("path").distinct(), "path", "left_semi")
