"""Sources and sinks: round trips with explicit schemas, and registry wiring."""

import io
import json
import subprocess
import sys
import zipfile
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import jobs, sequential
from lumenfold.sources import adapters, arrays, files

CARD = "id string, name string, image_uris struct<png:string>, card_faces array<struct<image_uris:struct<png:string>>>"


def test_bulk_json_with_face_fallback(spark, tmp_path):
    path = tmp_path / "cards.json"
    path.write_text('[{"id": "A", "name": "x", "image_uris": {"png": "f.png"}}, {"id": "B", "name": "y", "card_faces": [{"image_uris": {"png": "g.png"}}]}, {"id": "C", "name": "z", "image_uris": null}]')
    cards = files.read_json_array(spark, str(path), CARD)
    front = F.coalesce("image_uris.png", F.get("card_faces", F.lit(0)).getField("image_uris").getField("png"), F.lit(""))
    assert {r.id: r.f for r in cards.select("id", front.alias("f")).collect()} == {"A": "f.png", "B": "g.png", "C": ""}


def test_tolerant_json_lines_and_missing_csv(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"k": 1, "v": "a"}\n\n{broken\n{"k": 1, "v": "b"}\n')
    assert sorted(r.v for r in files.read_json_lines(spark, str(path), "k int, v string").collect()) == ["a", "b"]
    assert files.read_csv(spark, str(tmp_path / "none.csv"), "a int, b string").collect() == []


def test_manifest_round_trip_and_append(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"\nc', "train"), (2, "d", "val")], "id int, name string, split string")
    where = str(tmp_path / "m.csv")
    files.write_csv(df, where, ["id", "name", "split"])
    back = files.read_csv(spark, where, "id int, name string, split string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    files.write_csv(df, where, ["id", "name", "split"], mode="append")
    assert files.read_csv(spark, where, "id int, name string, split string").count() == 4


def test_file_listing_and_zip_entries(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "One.jpg").write_bytes(b"1")
    (tmp_path / "a" / "two.png").write_bytes(b"22")
    listed = files.list_files(spark, str(tmp_path / "a"), "*.jpg").collect()
    assert [(r.stem, r.length) for r in listed] == [("One", 1)]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name in ("x/1.jpg", "__MACOSX/1.jpg", "x/2.txt", "3.JPG"):
            z.writestr(name, name)
    (tmp_path / "z.zip").write_bytes(data.getvalue())
    found = sequential.zip_entries(spark.read.format("binaryFile").load(str(tmp_path / "z.zip"))).collect()
    assert sorted((r.name, bytes(r.content).decode()) for r in found) == [("3.JPG", "3.JPG"), ("x/1.jpg", "x/1.jpg")]


def test_tables_are_replaced_as_a_whole(spark, tmp_path):
    where = str(tmp_path / "table")
    for n in (3, 5, 7):
        files.replace_table(spark.range(n), where)
        held = files.read_table(spark, where)
        assert held.count() == n
    broken = spark.range(4).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        files.replace_table(broken, where)
    assert files.read_table(spark, where).count() == 7
    files.replace_table(spark.range(1), where)
    assert held.count() == 7  # the version before stays for those that read it
    assert len([p for p in (tmp_path / "table").iterdir() if p.is_dir()]) == 2
    with pytest.raises(FileNotFoundError):
        files.read_table(spark, str(tmp_path / "none"))


def test_documents_lines_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b", None), (2, 'q"', 0.5)], "id int, name string, score double")
    where = str(tmp_path / "rows.json")
    for _ in range(2):
        files.write_json_document(df.orderBy("id"), where)
    assert json.loads(Path(where).read_text()) == [{"id": 1, "name": "a|b", "score": None}, {"id": 2, "name": 'q"', "score": 0.5}]
    files.write_json_document(df.limit(0), where)
    assert json.loads(Path(where).read_text()) == []
    with pytest.raises(ValueError):
        files.write_json_document(df, where, most=1)
    lines = str(tmp_path / "lines")
    files.write_json_lines(df, lines)
    files.write_json_lines(df, lines, mode="append")
    assert files.read_json_lines(spark, lines, "id int, name string, score double").count() == 4
    report = str(tmp_path / "report.md")
    files.write_report(spark, report, "Runs", {"Best": df.orderBy("id"), "Note": "none"})
    assert Path(report).read_text() == "# Runs\n\n## Best\n\n| id | name | score |\n|-|-|-|\n| 1 | a\\|b |  |\n| 2 | q\" | 0.5 |\n\n## Note\n\nnone\n"


def test_id_sets_and_rows_in_order(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"id": "A", "x": 1}, {"id": " a"}, {"id": ""}, {"x": 2}, {"id": "B"}]')
    assert sorted(r.id for r in files.read_id_set(spark, str(tmp_path / "d.json")).collect()) == ["a", "b"]
    (tmp_path / "m.csv").write_text('card_id,n\n' + "".join(f'"c,{i}",{i}\r\n' for i in range(50)))
    got = files.read_rows(spark, str(tmp_path / "m.csv"), "card_id string, n int").collect()
    assert [(r.row_idx, r.card_id, r.n) for r in got] == [(i, f"c,{i}", i) for i in range(50)]


def test_rows_in_order_over_many_blocks(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("card_id,n\n" + "".join(f"{name}{i},{i}\n" + ("\n" if i == 700 else "") for i in range(1500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = files.read_rows(spark, str(tmp_path / "*.csv"), "card_id string, n int")
        assert sorted((r.card_id[0], r.row_idx, r.n) for r in got.collect()) == sorted((name, i + (i > 700), i) for name in "ab" for i in range(1500))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_archives_in_parts(spark, tmp_path):
    df = spark.range(1000).select(F.format_string("k%04d", 999 - F.col("id")).alias("id"), F.array(F.col("id"), F.lit(0.5)).alias("v")).unionByName(spark.createDataFrame([(None, [1.0, 2.0]), ("n", None)], "id string, v array<double>"))
    where = str(tmp_path / "parts")
    made = arrays.write_npz_parts(df, where, "id", "v", fingerprint="f1", partitions=3, rows=128).collect()
    assert sum(r.n for r in made) == 1000 and max(r.n for r in made) == 128
    got = arrays.read_npz(spark, f"{where}/*.npz").orderBy("file", "position").collect()
    assert [(r.id, list(r.embedding), r.fingerprint) for r in got] == [(f"k{i:04d}", [999.0 - i, 0.5], "f1") for i in range(1000)]
    assert arrays.write_npz_parts(df.limit(0), str(tmp_path / "none"), "id", "v").count() == 0


def test_parents_and_freshness(spark, tmp_path):
    for name in ("b/1", "a", "cache/x"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "summary.csv").write_text("x")
    assert [r.parent.rsplit(tmp_path.name)[-1] for r in files.distinct_parents(spark, str(tmp_path), "summary.csv").collect()] == ["/a", "/b/1"]
    times = "key string, modified timestamp"
    ins = spark.sql("SELECT * FROM VALUES ('old', timestamp'2024-01-02'), ('same', timestamp'2024-01-01'), ('fresh', timestamp'2024-01-01'), ('none', timestamp'2024-01-01') t(key, modified)")
    outs = spark.sql("SELECT * FROM VALUES ('old', timestamp'2024-01-01'), ('same', timestamp'2024-01-01'), ('fresh', timestamp'2024-01-03') t(key, modified)")
    assert sorted(r.key for r in files.stale_outputs(ins, outs, "key").collect()) == ["none", "old"]
    assert files.stale_outputs(spark.createDataFrame([], times), outs, "key").collect() == []


def test_unfinished_parts_are_built_again(spark, tmp_path):
    root, schema, built = str(tmp_path / "parts"), "id bigint, v bigint", []

    def build(items):
        built.append(sorted(r.id for r in items.collect()))
        return items.select("id", (F.col("id") * 2).alias("v"))

    assert files.read_parts(spark, root, schema).collect() == []
    files.write_part(build(spark.range(3)), root, 0)
    files.write_part(spark.range(9, 10).select("id", "id").toDF("id", "v"), root, 7)
    (tmp_path / "parts" / "part_000007" / "_SUCCESS").unlink()
    assert files.build_rest(spark.range(5), root, schema, "id", build, part=1).count() == 5
    assert built == [[0, 1, 2], [3, 4]]
    files.merge_parts(spark, root, schema, str(tmp_path / "whole"))
    assert sorted(map(tuple, files.read_table(spark, str(tmp_path / "whole")).collect())) == [(i, 2 * i) for i in range(5)]


def test_archives_of_vectors(spark, tmp_path):
    df = spark.createDataFrame([("b", [0.5, 1.0], 1), ("a", [1.0, 2.0], 1), (None, [1.0, 1.0], 1)], "id string, v array<float>, x int")
    where = str(tmp_path / "g.npz")
    arrays.write_npz(df, where, "id", "v", fingerprint="f1")
    got = arrays.read_npz(spark, where).orderBy("position").collect()
    assert [(r.position, r.id, list(r.embedding), r.fingerprint, r.path) for r in got] == [(0, "a", [1.0, 2.0], "f1", None), (1, "b", [0.5, 1.0], "f1", None)]
    (tmp_path / "bad.npz").write_bytes(b"no archive")
    np.savez(tmp_path / "bare.npz", other=np.zeros(3))
    np.savez(tmp_path / "cache.npz", embeddings=np.ones((2, 3)), fingerprint="f2", paths=np.array(["p", "gone"]))
    np.savez(tmp_path / "pickled.npz", embeddings=np.ones((1, 3)), card_ids=np.array([{}], object))
    found = arrays.read_npz(spark, str(tmp_path / "*.npz"))
    assert found.count() == 4
    paths = spark.createDataFrame([("p",), ("q",)], "path string")
    assert [r.path for r in arrays.usable_cache(found, "f2", paths).collect()] == ["p"] and arrays.usable_cache(found, "f1", paths).collect() == []
    with pytest.raises(ValueError):
        arrays.write_npz(df, where, "id", "v", most=1)


def test_claims_and_progress(spark, tmp_path):
    claims = jobs.Claims(spark, str(tmp_path / "claims"))
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda n: claims.take("v/1", f"w{n}"), range(8)))
    assert sum(won) == 1 and claims.owner("v/1") == f"w{won.index(True)}"
    assert not claims.give_back("v/1", "other") and claims.give_back("v/1", f"w{won.index(True)}") and claims.take("v/1", "again")
    now = [0.0]
    leased = jobs.Claims(spark, str(tmp_path / "leased"), lease=60, clock=lambda: now[0])
    assert leased.take("x", "dead") and not leased.take("x", "other")
    now[0] = 50.0
    assert leased.take("x", "dead") and [r["item"] for r in leased.held().collect()] == ["x"]  # renewed
    now[0] = 109.0
    assert leased.owner("x") == "dead" and not leased.take("x", "other")
    now[0] = 111.0
    assert leased.owner("x") is None and leased.held().collect() == []
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda n: leased.take("x", f"w{n}"), range(8))) == 1
    assert not leased.give_back("x", "dead")
    waiting = spark.createDataFrame([(f"i{n}", n // 2) for n in range(6)], "id string, added int")
    taken = [claims.next(waiting, "id", "added", "me", at_once=2) for _ in range(7)]
    assert taken == ["i5", "i4", "i3", "i2", "i1", "i0", None]

    done, path = [], str(tmp_path / "progress.json")

    def work(item):
        if item == "c" and len(done) < 3:
            done.append("failed")
            raise RuntimeError
        done.append(item)
        return item.upper()

    with pytest.raises(RuntimeError):
        jobs.run_resumable(spark, path, "abcd", work, every=2)
    assert jobs.run_resumable(spark, path, "abcd", work) == {"a": "A", "b": "B", "c": "C", "d": "D"}
    assert done == ["a", "b", "failed", "c", "d"]


def test_newest_of_kinds(spark):
    rows = [("all", "x", "2024-01-01"), ("all", "y", "2024-01-02"), ("all", "z", None), ("art", "a", None), ("other", "o", "2024-01-01")]
    got = adapters.newest_of_kinds(spark.createDataFrame(rows, "type string, uri string, updated_at string"), "all", "art", "none").collect()
    assert sorted(map(tuple, got)) == [("all", "y", "2024-01-02"), ("art", "a", None)]


def test_download_decisions(spark):
    rows = [(e, f, c, n) for e in (True, False) for f in (True, False) for c in (True, False) for n in ("old", "new", None)]
    df = spark.createDataFrame(rows, "e boolean, f boolean, c boolean, n string")
    remote = F.when(F.col("n") == "new", F.lit("2024-02-02").cast("timestamp")).when(F.col("n") == "old", F.lit("2024-01-01").cast("timestamp"))
    decided = df.select("*", adapters.download_decision(F.col("e"), F.col("f"), F.col("c"), F.lit("2024-01-31").cast("timestamp"), remote).alias("d")).collect()
    for r in decided:
        assert (r.d == "fetch") == (not r.e or r.f or (r.c and r.n != "old"))
    assert adapters.http_date("Tue, 02 Jan 2024 03:04:05 GMT").isoformat() == "2024-01-02T03:04:05+00:00" and adapters.http_date("soon") is adapters.http_date(None) is None
    zone = spark.conf.get("spark.sql.session.timeZone")
    for name in ("America/New_York", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", name)
        try:
            abroad = spark.createDataFrame([("Tue, 02 Jan 2024 03:04:05 GMT",)], "t string").select(F.unix_timestamp(adapters.http_timestamp(F.col("t"))).alias("t")).first().t
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)
        assert abroad == 1704164645
    at = spark.createDataFrame([("Tue, 02 Jan 2024 03:04:05 GMT",), ("soon",), (None,)], "t string").select(adapters.http_timestamp(F.col("t")).cast("string").alias("t")).collect()
    assert [r.t for r in at] == ["2024-01-02 03:04:05", None, None]


def test_models_and_media(spark):
    class Model:
        width = 2

        def vectors(self, pictures):
            if b"bad" in pictures:
                raise ValueError
            return np.array([[len(p), 0] for p in pictures], float)

    class Reader:
        def frames(self, content, key_only):
            return ((10 * i, bytes([b])) for i, b in enumerate(content) if not key_only or i % 2 == 0)

    class Tool:
        def edit(self, picture, numbers):
            return picture * int(numbers[0])

    df = spark.createDataFrame([(1, b"abc", [2.0]), (2, b"bad", None), (3, None, [1.0]), (4, b"z", [3.0])], "id int, data binary, n array<double>")
    assert {r.id: r.vector for r in adapters.vectors_of(df, "id", "data", Model(), normalise=True).collect()} == {1: [1.0, 0.0], 2: None, 3: None, 4: [1.0, 0.0]}
    assert sorted((r.id, r.at_ms, bytes(r.picture)) for r in adapters.frames_of(df, "id", "data", Reader(), key_only=True).collect()) == [(1, 0, b"a"), (1, 20, b"c"), (2, 0, b"b"), (2, 20, b"d"), (4, 0, b"z")]
    assert {r.id: r.data and bytes(r.data) for r in adapters.edited(df, "data", "n", Tool()).collect()} == {1: b"abcabc", 2: None, 3: None, 4: b"zzz"}


@pytest.mark.parametrize("without", [("lumenfold/llm", "corpus_pipeline.py"), ()])
def test_entry_imports_without_the_training_data_package(tmp_path, without):
    root = Path(__file__).parent.parent
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') for n in e.queries()), 'pipeline' in e.queries(), set(e.oracle_sql()) <= set(e.queries()))"
    for p in root.iterdir():
        if p.name in ("lumenfold", "__spark_entry__.py", "corpus_pipeline.py") and p.name not in without:
            (tmp_path / p.name).symlink_to(p) if p.name != "lumenfold" else (tmp_path / p.name).mkdir()
    for p in (root / "lumenfold").iterdir():
        if f"lumenfold/{p.name}" not in without:
            (tmp_path / "lumenfold" / p.name).symlink_to(p)
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    total, ops, pipeline, subset = said.stdout.split()
    present = not without and (root / "lumenfold/llm").exists()
    assert int(total) > 130 and int(ops) == 13 * present and (pipeline == "True") == present and subset == "True"
