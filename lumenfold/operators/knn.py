"""Exact nearest-neighbour search, batch against batch, by blocks.

Queries of a checked size go to every task, and the gallery is read where it lies: nothing but each task's best k a query
is shuffled. More queries than that are dealt into blocks, as the gallery is; each pair of blocks meets in one task. Blocks
hold a number of bytes, and bit vectors travel as bits, so that rows are copied as seldom as memory allows. Products are
made of slices of both sides; no row of a pair table is ever made, and what leaves a task is k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.vectors import EPSILON
from lumenfold.operators.relational import topk_per_group

BLOCK_BYTES = 16 << 20  # of vectors in a block
SENT_BYTES = 32 << 20  # of queries up to which they go to every task
ASKED, READ = 256, 8192  # rows of both sides in one product


def _ready(m: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as their products want them: of unit length, signs as 1 and -1, or as they are."""
    if metric == "hamming":
        return np.where(m > 0, np.float32(1), np.float32(-1))
    if metric == "dot":
        return m
    return m / (np.sqrt((m * m).sum(axis=1, keepdims=True)) + EPSILON)


def _scores(q: np.ndarray, g: np.ndarray, metric: str) -> np.ndarray:
    found = (q @ g.T).astype(np.float64, copy=False)
    return (found - q.shape[1]) / 2 if metric == "hamming" else np.round(found, 12)


def similarity(queries: np.ndarray, gallery: np.ndarray, metric: str) -> np.ndarray:
    """Scores, larger is better: cosine with norm + epsilon, raw dot product, or negative Hamming distance of signs."""
    return _scores(_ready(queries, metric), _ready(gallery, metric), metric)


def _matrix(column: pa.Array, metric: str) -> np.ndarray:
    """Rows of an array column, or of packed bits, ready for products; null components are NaN."""
    n = len(column)
    if pa.types.is_binary(column.type):
        flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
        return np.unpackbits(flat.reshape(n, -1), axis=1).astype(np.float32) * np.float32(2) - np.float32(1)
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    if n and (len(flat) % n or pc.min(pc.list_value_length(column)).as_py() * n != len(flat)):
        raise ValueError("vectors of different lengths")
    return _ready(flat.reshape(n, -1), metric)


def _as_bits(rows: pa.Table, vector: str) -> pa.Table:
    bits = np.packbits(_matrix(rows[vector].combine_chunks(), "hamming") > 0, axis=1) if len(rows) else []
    return rows.set_column(rows.schema.get_field_index(vector), vector, pa.array([row.tobytes() for row in bits], pa.binary()))


def _packed(df: DataFrame, vector: str) -> DataFrame:
    """The vector's signs as bits, the last byte filled up with zeros."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _as_bits(pa.Table.from_batches([batch]), vector).to_batches()

    schema = ", ".join(f"`{f.name}` {'binary' if f.name == vector else f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, schema)


def _best(scores: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k largest scores from its floor on, best first, ties from the left; none of minus infinity."""
    n = scores.shape[1]
    least = np.maximum(np.partition(scores, n - k, axis=1)[:, n - k] if n > k else -np.inf, floor)
    row, at = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    order = np.lexsort((at, -scores[row, at], row))
    row, at = row[order], at[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], at[keep]


class _Search:
    """The best k of all rows seen so far, for each of a block of queries."""

    def __init__(self, asked: pa.Table, k: int, metric: str, exclude: str):
        self.k, self.metric, self.exclude = k, metric, exclude
        self.asked = asked.select(["q_id", "q_class"]).combine_chunks()
        self.vectors = _matrix(asked["q_vector"].combine_chunks(), metric)
        self.known = [pc.unique(asked[c]) for c in ("q_id", "q_class")]
        self.codes = [self._codes(asked[c], i) for i, c in enumerate(("q_id", "q_class"))]
        self.floor = np.full(len(self.vectors), -np.inf)
        self.found: list[pa.Table] = []
        self.rows = 0

    def _codes(self, column: pa.Array | pa.ChunkedArray, i: int) -> np.ndarray:
        """Places among the queries' values, of which null is one; -1 for others."""
        return pc.fill_null(pc.index_in(column, value_set=self.known[i]), -1).to_numpy()

    def add(self, rows: pa.Table) -> None:
        rows = rows.take(pc.sort_indices(rows["g_id"])).combine_chunks()
        for at in range(0, len(rows), READ):
            part = rows.slice(at, READ)
            matrix = _matrix(part["g_vector"].combine_chunks(), self.metric)
            ids, classes = self._codes(part["g_id"], 0), self._codes(part["g_class"], 1)
            for start in range(0, len(self.vectors), ASKED):
                some = slice(start, start + ASKED)
                scores = _scores(self.vectors[some], matrix, self.metric)
                own, same = ids[None] == self.codes[0][some, None], classes[None] == self.codes[1][some, None]
                out = {"self": own, "class": same, "others": ~same | own}.get(self.exclude)
                if out is not None:
                    scores[out] = -np.inf
                query, column = _best(scores, self.k, self.floor[some])
                if len(query):
                    near = part.select(["g_id", "g_class"]).take(pa.array(column))
                    self.found.append(pa.table({"query": query + start, "id": near["g_id"], "class": near["g_class"], "score": scores[query, column]}))
                    self.rows += len(query)
            if self.rows > 4 * self.k * len(self.vectors):
                self._merge()

    def _merge(self) -> None:
        if not self.found:
            return
        both = pa.concat_tables(self.found).sort_by([("query", "ascending"), ("score", "descending"), ("id", "ascending")])
        query = both["query"].to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.k - 1
        self.floor[query[last]] = both["score"].to_numpy()[last]
        self.found = [both.filter(pa.array(place < self.k))]
        self.rows = len(self.found[0])

    def result(self, schema: pa.Schema) -> pa.Table:
        self._merge()
        if not self.found:
            return schema.empty_table()
        near = self.found[0]
        own = self.asked.take(near["query"])
        return pa.Table.from_arrays([own["q_id"], own["q_class"], near["id"], near["class"], near["score"]], names=schema.names).cast(schema)


def nearest(queries: DataFrame, gallery: DataFrame, *, k: int = 10, metric: str = "cosine", exclude: str = "self", block: int | None = None, send: int = SENT_BYTES) -> DataFrame:
    """query_id, rank (from 1), id, class, query_class, score: the best k of the gallery for each query.

    Both sides have id, vector (array) and class columns. ``exclude``: nothing, "self" (the same id), "class" (the same
    class, null being one) or "others" (other classes and the same id). Ties go to the smaller id. Scores are rounded to 12
    places, so that they don't depend on the order of additions. Fewer than k candidates give fewer rows; rows with a null
    vector are no candidates. Queries of at most ``send`` bytes go to every task; else both sides meet in blocks of
    ``block`` rows (by default of BLOCK_BYTES). The queries are counted while the plan is built, and of blocks the gallery.
    """
    # names of their own: both sides may come from one table
    left, right = (df.where("vector is not null").select(*[F.col(c).alias(f"{side}_{c}") for c in ("id", "vector", "class")]) for side, df in (("q", queries), ("g", gallery)))
    sizes = left.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("q_vector")), F.lit(1)).alias("width")).first()
    each = (sizes["width"] + 7) // 8 if metric == "hamming" else 8 * max(1, sizes["width"])
    kinds = {c: left.schema[f"q_{c}"].dataType.simpleString() for c in ("id", "class")}
    fields = f"query_id {kinds['id']}, query_class {kinds['class']}, id {kinds['id']}, class {kinds['class']}, score double"
    if metric == "hamming":
        left = _packed(left, "q_vector")
    if sizes["n"] * max(each, 64) <= send:
        found = _against_all(left, right, k, metric, exclude, fields)
    else:
        block = block or max(1024, BLOCK_BYTES // max(1, each))
        found = _by_blocks(left, _packed(right, "g_vector") if metric == "hamming" else right, k, metric, exclude, fields, block, sizes["n"])
    return topk_per_group(found, ["query_id"], [F.desc("score"), F.col("id")], k)


def _arrow(fields: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(fields))


def _against_all(left: DataFrame, right: DataFrame, k: int, metric: str, exclude: str, fields: str) -> DataFrame:
    """Queries in every task; the gallery isn't shuffled."""
    asked = left.toArrow()
    if not len(asked):
        return left.sparkSession.createDataFrame([], fields)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, asked.schema) as stream:
        stream.write_table(asked)
    shared, schema = left.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes()), _arrow(fields)
    # signs of the gallery are filled up as those of the queries are
    bits = metric == "hamming"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = None
        for batch in batches:
            search = search or _Search(pa.ipc.open_stream(shared.value).read_all(), k, metric, exclude)
            rows = pa.Table.from_batches([batch])
            search.add(_as_bits(rows, "g_vector") if bits else rows)
        if search:
            yield from search.result(schema).to_batches()

    return right.mapInArrow(run, fields)


def _by_blocks(left: DataFrame, right: DataFrame, k: int, metric: str, exclude: str, fields: str, block: int, asked: int) -> DataFrame:
    """Each block of queries beside each block of the gallery."""
    bq, bg = max(1, -(-asked // block)), max(1, -(-right.count() // block))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumn("q_bq", deal("q_id", bq)).withColumn("q_bg", spread(bg))
    right = right.withColumn("g_bg", deal("g_id", bg)).withColumn("g_bq", spread(bq))
    schema = _arrow(fields)

    def meet(q: pa.Table, g: pa.Table) -> pa.Table:
        if not len(q) or not len(g):
            return schema.empty_table()
        search = _Search(q, k, metric, exclude)
        search.add(g)
        return search.result(schema)

    return left.groupBy("q_bq", "q_bg").cogroup(right.groupBy("g_bq", "g_bg")).applyInArrow(meet, fields)
