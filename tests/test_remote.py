"""Data sources over fakes and SQLite files; rows are counted where they are read."""

import os
import sqlite3
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lumenfold.sources import remote
from lumenfold.sources.adapters import Busy
from lumenfold.sources.remote import Patience, look_up_ids, read_paged, scan_sqlite

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't see the tests' folder
SOON = Patience(tries=3, pause=0.001)


class Listing:
    """Rows in pages; notes who asked for which, and is busy the first time that a page is asked for."""

    def __init__(self, rows, size, total, log):
        self.rows, self.size, self.total, self.log = rows, size, total, log

    def page(self, number):
        mark = f"{self.log}/{number}"
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise Busy
        with open(mark, "a") as f:
            f.write(f"{os.getpid()}\n")
        at = (number - 1) * self.size
        return self.rows[at : at + self.size], self.total


@pytest.mark.parametrize("total", [None, 95])
def test_paged_listing(spark, tmp_path, total):
    rows = [{"id": i, "name": f"n{i}", "more": 1} if i % 7 else {"id": i} for i in range(95)]
    df = read_paged(spark, Listing(rows, 10, total, str(tmp_path)), "id long, name string", ways=3, patience=SOON)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(((r["id"], r.get("name")) for r in rows), key=str)
    assert df.rdd.getNumPartitions() == (10 if total else 3)
    asked = {p for n in range(2, 11) for p in open(tmp_path / str(n)).read().split()}
    assert str(os.getpid()) not in asked  # the driver asks for the first page only
    assert read_paged(spark, Listing([], 10, 0 if total else None, str(tmp_path)), "id long", patience=SOON).collect() == []


class AlwaysBusy:
    def page(self, number):
        raise Busy


def test_busy_listing_fails(spark):
    with pytest.raises(Exception, match="Busy"):
        read_paged(spark, AlwaysBusy(), "id long", patience=SOON).collect()


class Ids:
    def ids(self, keys):
        assert len(keys) <= 4
        if any(k.startswith("busy") for k in keys):
            raise Busy
        return [f"id-{k}" if int(k[1:]) % 3 else None for k in keys][: 1 if "k13" in keys else None]


def test_ids_and_their_status(spark):
    keys = spark.createDataFrame([(f"k{i}", i) for i in range(40)] * 2 + [(None, 0), ("busy", 1)], "key string, id int").repartition(3)
    got = {r.key: (r.id, r.status) for r in look_up_ids(keys, "key", Ids(), batch=4, patience=SOON).collect()}
    assert len(got) == 41 and got["busy"] == (None, "unavailable")
    out = {k: v for k, v in got.items() if v[1] == "unavailable"}
    assert "k13" in out and len(out) <= 8  # with what shared their batches
    assert all(v == ((f"id-{k}", "found") if int(k[1:]) % 3 else (None, "none")) for k, v in got.items() if k not in out)
    assert look_up_ids(keys.limit(0), "key", Ids()).collect() == []


@pytest.fixture
def catalog(tmp_path):
    path = str(tmp_path / "cards.db")
    with sqlite3.connect(path) as con:
        con.execute('CREATE TABLE "my cards" (id TEXT COLLATE NOCASE, n INTEGER, price REAL, data BLOB, any)')
        con.executemany('INSERT INTO "my cards" VALUES (?, ?, ?, ?, ?)', [(f"Card{i}" if i % 9 else None, i, i / 4, b"x%d" % i, "t" if i % 2 else i) for i in range(500)])
        con.execute('INSERT INTO "my cards" VALUES (\'odd\', \'text\', \'none\', NULL, 1.5)')
        con.execute('INSERT INTO "my cards" VALUES (?, 1000, 250, NULL, NULL)', (b"Card3",))
        con.execute('DELETE FROM "my cards" WHERE n BETWEEN 100 AND 199')
        con.execute('CREATE VIEW cheap AS SELECT id, n, price * 2 AS twice FROM "my cards" WHERE price < 60')
        con.execute("CREATE TABLE sets (code TEXT PRIMARY KEY, n INTEGER) WITHOUT ROWID")
        con.executemany("INSERT INTO sets VALUES (?, ?)", [(f"s{i}", i if i % 5 else None) for i in range(50)])
        con.execute("CREATE TABLE none (id TEXT)")
    return path


def test_sqlite_tables(spark, catalog):
    df = scan_sqlite(spark, catalog, "my cards", partitions=7)
    assert df.dtypes == [("id", "string"), ("n", "bigint"), ("price", "double"), ("data", "binary"), ("any", "string")]
    rows = {r.n: r for r in df.collect()}
    assert len(rows) == 402 and rows[7][:3] == ("Card7", 7, 1.75) and bytes(rows[7].data) == b"x7" and rows[8].any == "8" and rows[None].price is None
    assert df.rdd.getNumPartitions() == 7
    assert scan_sqlite(spark, catalog, "none").collect() == []
    narrow = scan_sqlite(spark, catalog, "my cards", "price double")
    assert narrow.agg(F.sum("price")).first()[0] == sum(i / 4 for i in range(500) if not 100 <= i < 200) + 250
    for wrong in ("absent", "my cards; x"):
        with pytest.raises(Exception, match="no table"):
            scan_sqlite(spark, catalog, wrong)


def test_sqlite_views_and_tables_without_row_ids(spark, catalog):
    view = scan_sqlite(spark, catalog, "cheap", "id string, n bigint, twice double", partition_column="n", partitions=5)
    assert sorted(r.n for r in view.collect()) == [*range(100), *range(200, 240)] and view.rdd.getNumPartitions() == 6
    assert scan_sqlite(spark, catalog, "cheap", "n bigint").count() == 140
    sets = scan_sqlite(spark, catalog, "sets", partition_column="n", partitions=4)
    assert sorted(r.code for r in sets.collect()) == sorted(f"s{i}" for i in range(50))  # nulls too
    assert scan_sqlite(spark, catalog, "sets").where("n is null").count() == 10


@pytest.mark.parametrize("condition", ["n = 7", "n in (3, 250, 9999)", "n >= 490 and price < 124", "id = 'Card3'", "id = 'card3'", "id > 'Card48'", "id is null", "id is not null and n <= 4", "n <=> null", "price = 3", "any = '8'", "n = 1 or n = 2"])
def test_sqlite_filters_equal_spark(spark, catalog, condition):
    df = scan_sqlite(spark, catalog, "my cards")
    whole = spark.createDataFrame(df.collect(), df.schema)
    key = lambda frame: sorted(map(str, frame.where(condition).collect()))
    assert key(df) == key(whole)


def test_filters_reach_sqlite(catalog):
    reader = remote._SqliteReader(catalog, "my cards", remote.SqliteSource({"path": catalog, "table": "my cards"}).schema(), 4, None)
    kept = list(reader.pushFilters([remote.EqualTo(("n",), 300), remote.In(("price",), (75.0, 76.0))]))
    assert len(kept) == 2 and reader._condition()[1] == (300, 75.0, 76.0) and '"n" COLLATE BINARY = ?' in reader._condition()[0]
    parts = reader.partitions()
    got = [r[:2] for p in parts for r in reader.read(p)]
    assert got == [("Card300", 300)]
    with sqlite3.connect(catalog) as con:
        con.execute('CREATE INDEX by_id ON "my cards" (id COLLATE BINARY)')
        plan = con.execute(f'EXPLAIN QUERY PLAN SELECT n FROM "my cards" WHERE {_by_id(catalog)}', ("Card3",)).fetchall()
    assert "by_id" in str(plan) and "SCAN" not in str(plan)


def _by_id(catalog):
    reader = remote._SqliteReader(catalog, "my cards", remote.SqliteSource({"path": catalog, "table": "my cards"}).schema(), 4, None)
    list(reader.pushFilters([remote.EqualTo(("id",), "Card3")]))
    return reader._condition()[0]
