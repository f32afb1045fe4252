"""The scan state machine: fixed replays, the batch fold, and the stream."""

import random

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import wiki
from lumenfold.operators import sequential
from lumenfold.streaming import pacing, scan
from lumenfold.streaming import sink as sink_module

REPLAYS = [
    ("AAA", 3, ["A"]),
    ("AA-AA", 3, ["A"]),
    ("AABBB", 3, ["B"]),
    ("AAABBAB", 3, ["A", "B"]),
    ("---", 3, []),
    ("AA", 1, ["A"]),
    ("A", 1, []),
    ("AAAA", 3, ["A"]),
]


@pytest.mark.parametrize(("events", "fill_at", "want"), REPLAYS)
def test_replays(events, fill_at, want):
    bucket, rules = scan.ScanBucket(), scan.Rules(fill_at=fill_at)
    found = [bucket.push(rules, i * 100, e != "-", e if e != "-" else None) for i, e in enumerate(events)]
    assert [f for f in found if f] == want


def test_cooldown():
    bucket, rules = scan.ScanBucket(), scan.Rules()
    at = [0, 1, 2, 3000, 3001, 4002, 4003, 4004]
    assert [bucket.push(rules, t, True, "A") for t in at] == [None, None, "A", None, None, None, None, "A"]


def scans(spark, n=600):
    rng = random.Random(3)
    rows = [(rng.randrange(4), i * 500, i, rng.random() < 0.8, rng.choice(["A", "A", "A", "B", None])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "session long, at_ms long, seq long, present boolean, card_id string")


def folded(rows, rules):
    return sorted(scan._fold(sorted(rows, key=lambda r: r[:3]), rules))


def test_batch_is_the_fold(spark):
    rows, df = scans(spark)
    want = folded(rows, scan.Rules())
    assert sorted(map(tuple, scan.confirm_batch(df).collect())) == want and len(want) > 5
    assert scan.confirm_batch(df.limit(0)).collect() == []


def test_stream_is_the_batch(spark, tmp_path):
    rows, df = scans(spark, 200)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(4):  # four files in the order of time: a micro-batch each
        df.where(F.col("seq").between(part * 50, part * 50 + 49)).coalesce(1).write.mode("append").parquet(source)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = scan.confirm_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == folded(rows, scan.Rules())


def test_sampling_and_retries(spark):
    rows = [(k, t) for k in (1, 2) for t in (0, 0, 10, 95, 100, 199, 205, 400)]
    got = sequential.sample_frames(spark.createDataFrame(rows, "k long, t long"), "k", "t", 100).collect()
    assert sorted(map(tuple, got)) == [(k, t) for k in (1, 2) for t in (0, 100, 205, 400)]

    def classify(texts):
        if "bad" in texts:
            raise ValueError
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bad", "c", None, "bad", "d"])], "i long, text string")
    labels = {r.i: r.label for r in sequential.classify_rows(df, "text", classify).collect()}
    assert labels == {0: "A", 1: "refused", 2: "C", 3: "", 4: "refused", 5: "D"}


def test_every_row_gets_one_label_in_place():
    calls = []

    def classify(texts):
        calls.append(len(texts))
        return texts if "x" not in texts else texts[1:]

    texts = [*"abcxdefgx"]
    assert sequential._labelled(texts, classify, "no") == [*"abc", "no", *"defg", "no"]
    assert sequential._labelled([], classify, "no") == [] and calls[0] == 9 and calls.count(9) == 1


def test_wiki_pages(spark):
    page = "!AAA<br>x\r\n! no\n!B2<br>\n|-\n|1\n|{{card|One|x}}\n|{{cell|tick}}||\n|-\n|{{card|Two}}\n|\nhas {{cell|tick}}\n|-\n| {{cell|tick}}\n|-\n|{{card|Three}}\n| || || {{cell|tick}}\n|}"
    entries = "|-\n| MKM \n| x\n|{{card| One |a}}\n|-\n| two words\n|{{card|No}}\n|-\n|m\n|-\n|otj\n|{{card|A}}{{card|B}}"
    rows = [(page, entries), (None, None), ("", "")]
    got = spark.createDataFrame(rows, "page string, entries string").select(wiki.tick_matrix(F.col("page")).alias("t"), wiki.row_entries(F.col("entries")).alias("e")).collect()
    assert [tuple(x) for x in got[0].t] == [("aaa", "One"), ("b2", "Two")]
    assert [tuple(x) for x in got[0].e] == [("mkm", "One"), ("otj", "A")]
    assert not got[1].t and not got[1].e and not got[2].t and not got[2].e


def test_rules_change_without_losing_state(spark, tmp_path):
    """A side input of rules that changes between micro-batches: two hits under the old rules count under the new ones."""
    schema = "session long, at_ms long, seq long, present boolean, card_id string, fill_at int, drain int, cooldown_ms int"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n, fill_at in enumerate((5, 5, 3)):
        spark.createDataFrame([(1, 10 * n, n, True, "a", fill_at, 1, 100)], schema).coalesce(1).write.mode("append").parquet(source)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = scan.confirm_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [(1, "a", 20, 2)]


def test_pacing(spark):
    sent = []
    pacer = pacing.Pacer(sent.append, rate=10)
    assert [pacer.offer(t, t) for t in (0, 50, 99, 100, 250, 260)] == [True, False, False, True, True, False]
    assert sent == [0, 100, 250] and pacer.dropped == 3
    inner = pacing.Pacer(lambda f: sent.append(inner.offer(10_000, "again")), rate=10)
    assert inner.offer(0, "x") and sent[-1] is False and inner.offer(20_000, "y")
    rows = [(1, t, took) for t, took in ((0, 10), (50, 0), (100, 500), (300, 0), (600, None), (650, 1), (700, 1))] + [(2, 5, 0), (2, None, 0)]
    got = pacing.paced(spark.createDataFrame(rows, "k long, t long, took long"), "k", "t", "took", 100).collect()
    assert sorted((r.k, r.t) for r in got) == [(1, 0), (1, 100), (1, 600), (1, 700), (2, 5)]


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_killed_stream_sinks_every_batch_once(spark, tmp_path, rocks, monkeypatch):
    """Killed between write and commit, and between the commit and Spark's own, then restarted: equals the batch fold."""
    rows, df = scans(spark, 200)
    sure = df.withColumn("confidence", F.when(F.col("seq") % 11 == 0, 0.2).when(F.col("seq") % 13 > 0, 0.9))
    folder = str(tmp_path / "in")
    for part in range(4):
        sure.where(F.col("seq").between(part * 50, part * 50 + 49)).coalesce(1).write.mode("append").parquet(folder)
    source = lambda: spark.readStream.schema(sure.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    sink = sink_module.OnceSink(spark, str(tmp_path / "out"))
    commit, deaths = sink_module.OnceSink._commit, []

    def dying(self, name, content):
        if not deaths:  # rows are written, the commit isn't
            deaths.append(name)
            raise RuntimeError("killed")
        commit(self, name, content)
        if len(deaths) == 1 and content["batch"] == 2:  # committed, but Spark doesn't know
            deaths.append(name)
            raise RuntimeError("killed")

    monkeypatch.setattr(sink_module.OnceSink, "_commit", dying)
    for ends in ("killed", "killed", None):
        q = sink_module.confirm_once(source(), sink, str(tmp_path / "state"), least=0.5)
        try:
            q.awaitTermination(180)
        except Exception as e:  # noqa: BLE001
            assert ends and ends in str(e)
        assert bool(q.exception()) == bool(ends)
    assert len(deaths) == 2 and deaths[1].endswith("0000000002")
    gate = lambda r: (*r[:3], r[3] and r[2] % 11 > 0 and r[2] % 13 > 0, r[4])
    want = folded(list(map(gate, rows)), scan.Rules())
    read = lambda: sorted(map(tuple, sink.read(scan.CONFIRMED).collect()))
    assert read() == want and len(want) > 3
    names = lambda d: sorted(p.name for p in (tmp_path / "out" / d).iterdir() if not p.name.startswith("."))
    assert len(names("data")) == 5 and len(names("commits")) == 4  # one folder has no commit
    sink.compact(scan.CONFIRMED)
    assert read() == want and len(names("data")) == 2 and not names("commits")
    sink.compact(scan.CONFIRMED)
    # more input after the compaction; batches that the snapshot holds aren't taken again
    more = spark.createDataFrame([(99, i, 1000 + i, True, "Z", 0.9) for i in range(3)], sure.schema)
    more.coalesce(1).write.mode("append").parquet(folder)
    q = sink_module.confirm_once(source(), sink, str(tmp_path / "state"), least=0.5)
    q.awaitTermination(180)
    assert read() == sorted([*want, (99, "Z", 2, 1002)])


def test_second_writer_of_a_batch_doesnt_count(spark, tmp_path):
    sink = sink_module.OnceSink(spark, str(tmp_path / "out"))
    assert sink.read("id bigint").collect() == []
    one, other = spark.range(3), spark.range(10, 12)
    sink.take(one, 0)
    sink._commit(sink._entry("none", 0), {"query": "none", "batch": 0, "folder": "data/other"})  # came too late
    sink.take(other, 0)
    sink.take(other, 1)
    assert sorted(r.id for r in sink.read("id bigint").collect()) == [0, 1, 2, 10, 11]


def test_gate(spark):
    df = spark.createDataFrame([(1, True, 0.4), (2, True, 0.5), (3, True, None), (4, False, 0.9), (5, None, 0.9)], "n int, present boolean, c double")
    kept = lambda least: [r.n for r in sink_module.gated(df, F.col("present"), F.col("c"), least).where("present").collect()]
    assert kept(0.5) == [2] and kept(0) == [1, 2, 3]
