"""Services and catalogs as Spark data sources: a task asks for a page, a batch of keys or a range of rows itself.

Rows go from the service to the executors; the driver sees counts and bounds only. A client is any object with the
methods named here that can be pickled; tests use fakes.
"""

from __future__ import annotations

import random
import sqlite3
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from lumenfold.sources.adapters import Busy, IdLookup, Pages


@dataclass(frozen=True)
class Patience:
    """How a busy service is asked again: pauses double, and each is drawn anew between half and all of it."""

    tries: int = 4
    pause: float = 1.0
    most: float = 60.0

    def __call__(self, ask: Callable[[], object]) -> object:
        for turn in range(self.tries):
            try:
                return ask()
            except Busy:
                if turn + 1 == self.tries:
                    raise
                time.sleep(min(self.most, self.pause * 2**turn) * random.uniform(0.5, 1))


def _register(spark: SparkSession, base: type[DataSource], **given: object) -> str:
    """A data source of its own name for a client, which goes to the tasks with it."""
    name = f"{base.kind}_{uuid.uuid4().hex[:12]}"
    made = type(base.__name__, (base,), {**given, "name": classmethod(lambda cls: name)})
    spark.dataSource.register(made)
    return name


# --- paged listings ---------------------------------------------------------------------------------------------------


@dataclass
class _PageRange(InputPartition):
    first: int
    step: int
    last: int | None


class _PageReader(DataSourceReader):
    def __init__(self, client: Pages, schema: StructType, patience: Patience, first: int, ways: int):
        self.client, self.schema, self.patience, self.first, self.ways = client, schema, patience, first, ways

    def partitions(self) -> Sequence[InputPartition]:
        rows, total = self.patience(lambda: self.client.page(self.first))
        if total is None or not rows:  # pages are taken in turns, each turn until its first empty page
            return [_PageRange(self.first + i, self.ways, None) for i in range(self.ways)]
        last = self.first + -(-total // len(rows)) - 1
        return [_PageRange(page, 1, page) for page in range(self.first, last + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = [f.name for f in self.schema]
        number = partition.first
        while partition.last is None or number <= partition.last:
            rows, _ = self.patience(lambda number=number: self.client.page(number))
            if not rows:
                return
            yield from (tuple(r.get(n) for n in names) for r in rows)
            number += partition.step


class _PagedSource(DataSource):
    kind = "pages"
    client: Pages
    patience: Patience
    first: int
    ways: int

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PageReader(self.client, schema, self.patience, self.first, self.ways)


def read_paged(spark: SparkSession, client: Pages, schema: str, first: int = 1, ways: int = 8, patience: Patience = Patience()) -> DataFrame:
    """All rows of a listing as a table. What a row lacks is null, what the schema lacks is left out.

    The first page is asked for its length and for the total. With a total, a task is a page: every page but the last has
    the first one's length. Without one, ``ways`` tasks take pages in turns until each meets an empty one. A service
    that stays busy fails the task, which Spark tries again, and then the query: a listing is whole or not there.
    """
    return spark.read.format(_register(spark, _PagedSource, client=client, patience=patience, first=first, ways=ways)).schema(schema).load()


# --- ids of keys ------------------------------------------------------------------------------------------------------

FOUND, NONE, UNAVAILABLE = "found", "none", "unavailable"


def look_up_ids(keys: DataFrame, key_col: str, client: IdLookup, batch: int = 10, patience: Patience = Patience()) -> DataFrame:
    """(key, id, status) of every different key that isn't null, asked for in the tasks, in batches.

    status: found; none, if the service knows no id; unavailable, if it stayed busy or its reply wasn't as long as the
    batch, so that those keys can be asked for again. A key of many rows is asked for once: join the result to them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            names = part.column(0).to_pylist()
            for at in range(0, len(names), batch):
                some = names[at : at + batch]
                try:
                    found = list(patience(lambda some=some: client.ids(some)))
                except Busy:
                    found = []
                answered = len(found) == len(some)
                found = found if answered else [None] * len(some)
                status = [UNAVAILABLE if not answered else NONE if i is None else FOUND for i in found]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(found, pa.string()), pa.array(status)], names=["key", "id", "status"])

    return keys.select(F.col(key_col).cast("string").alias("key")).where("key is not null").distinct().mapInArrow(run, "key string, id string, status string")


# --- SQLite -----------------------------------------------------------------------------------------------------------

FITTING = {LongType: ("integer",), DoubleType: ("integer", "real"), StringType: ("text",)}
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _kind(declared: str) -> object:
    """The type that SQLite's affinity rules give a declared type."""
    d = declared.upper()
    if "INT" in d:
        return LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return StringType()
    if "BLOB" in d:
        return BinaryType()
    return DoubleType() if any(x in d for x in ("REAL", "FLOA", "DOUB")) else StringType()


@dataclass
class _Rows(InputPartition):
    where: str
    values: tuple = ()


@dataclass
class _SqliteReader(DataSourceReader):
    path: str
    table: str
    schema: StructType
    ways: int
    by: str | None
    pushed: list[tuple[str, tuple]] = field(default_factory=list)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on columns of the type that their declaration says go to SQLite, and stay with Spark too.

        There they keep at least the rows that Spark keeps: collations are BINARY, and values that don't fit their
        column, which may be null or another text to Spark, are let through where they could pass.
        """
        con = _connect(self.path)
        try:
            declared = {name: _kind(kind or "ANY") for _, name, kind, *_ in con.execute(f"PRAGMA table_info({_quoted(self.table)})") if kind}
        finally:
            con.close()
        fits = {f.name: FITTING.get(type(f.dataType)) for f in self.schema if declared.get(f.name) == f.dataType}
        known = lambda v: isinstance(v, (int, float, str)) and not isinstance(v, bool) and v == v
        for f in filters:
            yield f
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if not fits.get(column):
                continue
            name = f"{_quoted(column)} COLLATE BINARY"
            # blobs come last in SQLite's order; Spark reads those of a text column as texts
            blob = f" OR {name} >= x''" if "text" in fits[column] else ""
            if type(f) in COMPARED and known(f.value):
                self.pushed.append((f"{name} {COMPARED[type(f)]} ?{blob}", (f.value,)))
            elif isinstance(f, In) and 0 < len(f.value) <= 500 and all(known(v) for v in f.value):
                self.pushed.append((f"{name} IN ({', '.join('?' * len(f.value))}){blob}", tuple(f.value)))
            elif isinstance(f, IsNull):
                self.pushed.append((f"{name} IS NULL OR typeof({_quoted(column)}) NOT IN ({', '.join(map(repr, fits[column]))})", ()))
            elif isinstance(f, IsNotNull):
                self.pushed.append((f"{name} IS NOT NULL", ()))

    def _condition(self) -> tuple[str, tuple]:
        return " AND ".join(f"({c})" for c, _ in self.pushed) or "1", tuple(v for _, values in self.pushed for v in values)

    def partitions(self) -> Sequence[InputPartition]:
        """Ranges of a whole-number column: the one named, or the row id; tables and views without either are one part."""
        condition, values = self._condition()
        con = _connect(self.path)
        try:
            column = _quoted(self.by) if self.by else "rowid" if _has_rowid(con, self.table) else None
            if column is None:
                return [_Rows(condition, values)]
            low, high = con.execute(f"SELECT min({column}), max({column}) FROM {_quoted(self.table)} WHERE {condition}", values).fetchone()
        finally:
            con.close()
        if low is None:
            return [_Rows(f"({condition}) AND {column} IS NULL", values)] if self.by else [_Rows("0")]
        if not isinstance(low, int) or not isinstance(high, int):
            raise ValueError(f"{self.by} doesn't hold whole numbers")
        step = max(1, -(-(high - low + 1) // self.ways))
        parts = [_Rows(f"({condition}) AND {column} >= ? AND {column} < ?", (*values, at, at + step)) for at in range(low, high + 1, step)]
        # values that aren't numbers, and nulls, lie in no range
        return parts + [_Rows(f"({condition}) AND typeof({column}) <> 'integer'", values)] if self.by else parts

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        cast = [_CASTS.get(type(f.dataType), lambda v: v) for f in self.schema]
        con = _connect(self.path)
        try:
            found = con.execute(f"SELECT {', '.join(_quoted(f.name) for f in self.schema) or '1'} FROM {_quoted(self.table)} WHERE {partition.where}", partition.values)
            while rows := found.fetchmany(10_000):
                yield from (tuple(None if v is None else c(v) for c, v in zip(cast, r, strict=False)) for r in rows)
        finally:
            con.close()


def _whole(v: object) -> int | None:
    return v if isinstance(v, int) else int(v) if isinstance(v, float) and v.is_integer() else None


_CASTS = {
    LongType: _whole, BooleanType: bool, BinaryType: lambda v: v if isinstance(v, bytes) else str(v).encode(),
    DoubleType: lambda v: float(v) if isinstance(v, int | float) else None,
    StringType: lambda v: v if isinstance(v, str) else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v),
}


def _has_rowid(con: sqlite3.Connection, table: str) -> bool:
    kind = con.execute("SELECT type FROM sqlite_master WHERE name = ? COLLATE NOCASE", (table,)).fetchone()
    if not kind or kind[0] != "table":
        return False
    try:
        con.execute(f"SELECT rowid FROM {_quoted(table)} LIMIT 0")
    except sqlite3.OperationalError:
        return False
    return True


class SqliteSource(DataSource):
    """Format ``sqlite``: options path, table, partitions (8) and partitionColumn."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        con = _connect(self.options["path"])
        try:
            columns = con.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        finally:
            con.close()
        if not columns:
            raise ValueError(f"no table or view {self.options['table']}")
        return StructType([StructField(name, _kind(declared or "")) for _, name, declared, *_ in columns])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(self.options["path"], self.options["table"], schema, int(self.options.get("partitions", 8)), self.options.get("partitioncolumn"))


def scan_sqlite(spark: SparkSession, path: str, table: str, schema: str | None = None, partitions: int = 8, partition_column: str | None = None) -> DataFrame:
    """A table or view of a file that driver and executors see under one name, read only, a task for each range of row ids.

    Only the schema's columns are selected; without a schema, all, by their declared types. Comparisons, IN lists and
    null tests of a filter are decided by SQLite, so an index or the row id serves them. A view, or a table without row ids,
    is read in ranges of ``partition_column`` (whole numbers); without one, by one task. A value that doesn't fit
    its column's type is null. A missing file, table or column raises.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite").options(path=path, table=table, partitions=partitions)
    reader = reader.option("partitionColumn", partition_column) if partition_column else reader
    return (reader.schema(schema) if schema else reader).load()
