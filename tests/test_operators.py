"""Relational operators and nearest neighbours on constructed rows with nulls, ties and clashes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import hashing, strings, vectors
from lumenfold.operators import knn
from lumenfold.operators import relational as R


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_update_delete(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id int, v string, w string")
    new = spark.createDataFrame([(2, None), (3, "c")], "id int, v string")
    assert got(R.upsert(old, new, ["id"])) == [(1, "a", None), (2, None, None), (3, "c", None)]
    assert got(R.update_by_key(old, new.where("id = 2"), ["id"], ["v"])) == [(1, "a", None), (2, "b", "x")]
    assert got(R.delete_by_key(old, new, ["id"])) == [(1, "a", None)]


def test_resolution_statuses(spark):
    catalog = spark.createDataFrame([("n", "s", 1, "a"), ("m", "s", 2, "a"), ("m", "s", 3, "a"), ("k", "s", 4, "a"), ("k", "s", 5, "b"), ("e", "s", 6, ""), ("e", "s", 7, None), ("p", "s", 8, "a"), ("p", "s", 9, "")], "name string, code string, card int, art string")
    records = spark.createDataFrame([(1, "n", "s"), (2, "m", "s"), (3, "k", "s"), (4, "e", "s"), (5, "z", "s"), (6, None, "s"), (7, "p", "s")], "rec int, name string, code string")
    assert got(R.resolve(records, catalog, ["name", "code"], "rec", "card", "art")) == [(1, 1, "resolved", 1), (2, 2, "ambiguous_same_art", 2), (3, 2, "ambiguous", None), (4, 2, "ambiguous", None), (5, 0, "not_found", None), (6, 0, "not_found", None), (7, 2, "ambiguous_same_art", 8)]


def test_short_and_long_id_lists(spark):
    df = spark.range(50)
    assert R.by_ids(df, "id", []).count() == 0
    assert R.by_ids(df, "id", [3, 4]).count() == R.by_ids(df, "id", [3, 4], most=1).count() == 2


def test_split_is_stable(spark):
    row = spark.range(1).select(hashing.split_of(F.lit("abc"), "7").alias("s"), hashing.hash_fraction(F.lit("abc"), "7").alias("f")).first()
    import hashlib

    want = int(hashlib.sha256(b"7:abc").hexdigest()[:8], 16) / 0xFFFFFFFF
    assert row.f == want and row.s == ("train" if want < 0.8 else "val" if want < 0.9 else "test")


def test_hex_and_bits(spark):
    df = spark.createDataFrame([("ab",), (" 0123456789abcdef0 ",)], "h string")
    assert [r.x for r in df.select(vectors.hex_canonical(F.col("h"), F.lit(16)).alias("x")).collect()] == ["0" * 14 + "ab", "123456789abcdef0"]
    row = spark.range(1).select(vectors.hex_words(F.lit("f" * 16 + "0" * 15 + "1"), 32).alias("w")).first()
    assert row.w == [-1, 1]
    with pytest.raises(Exception, match="more than 2 bits"):
        spark.range(1).select(vectors.pack_bits(F.array(F.lit(1), F.lit(1), F.lit(1)), 2)).collect()


def test_slugs_and_ids(spark):
    row = spark.range(1).select(strings.extract_uuid(F.lit("x_ABCDEF01-0000-4000-8000-00000000000A.jpg")).alias("u"), strings.extract_uuid(F.lit("none")).alias("n"), strings.video_slug(F.lit("v1"), F.lit("Opening a *NEW* box, again & again today")).alias("s"), strings.parse_price(F.lit("n/a")).alias("p")).first()
    assert tuple(row) == ("abcdef01-0000-4000-8000-00000000000a", None, "v1_opening-new-box-again", None)


@pytest.mark.parametrize("metric", ["cosine", "dot", "hamming"])
@pytest.mark.parametrize("exclude", ["none", "self", "class", "others"])
@pytest.mark.parametrize("send", [0, 1 << 20])
def test_nearest_by_blocks(spark, metric, exclude, send):
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((60, 16)), 1)
    x[7] = x[3]
    x[9] = 0
    classes = [None if i % 11 == 0 else i % 4 for i in range(60)]
    df = spark.createDataFrame([(i, x[i].tolist(), classes[i]) for i in range(60)] + [(99, None, 1)], "id long, vector array<double>, class int")
    asked = df.where("id % 5 = 0")
    near = {}
    for r in sorted(knn.nearest(asked, df, k=4, metric=metric, exclude=exclude, block=13, send=send).collect(), key=lambda r: (r.query_id, r["rank"])):
        near.setdefault(r.query_id, []).append(r.id)
    for q in range(0, 60, 5):
        scores = np.round(knn.similarity(x[q : q + 1], x, metric)[0], 12)
        allowed = [i for i in range(60) if {"none": True, "self": i != q, "class": classes[i] != classes[q], "others": i != q and classes[i] == classes[q]}[exclude]]
        assert near[q] == sorted(allowed, key=lambda i: (-scores[i], i))[:4]


@pytest.mark.parametrize("send", [0, 1 << 20])
def test_nearest_edges(spark, send):
    df = spark.createDataFrame([("b", [1.0, 0.0, 2.0], None), ("a", [1.0, 0.0, 2.0], "x"), ("c", [1.0, 0.0, 2.0], "x"), (None, [0.0, 1.0, 0.0], "x")], "id string, vector array<float>, class string")
    got = knn.nearest(df.where("id = 'c'"), df, k=2, metric="hamming", send=send).orderBy("rank").collect()
    assert [(r.query_id, r.id, r["class"], r.score) for r in got] == [("c", "a", "x", 0.0), ("c", "b", None, 0.0)]
    assert knn.nearest(df.limit(0), df, send=send).count() == 0 == knn.nearest(df, df.limit(0), send=send).count()
    ragged = df.unionByName(spark.createDataFrame([("d", [1.0], "x")], df.schema))
    with pytest.raises(Exception, match="different lengths"):
        knn.nearest(ragged, ragged, send=send).collect()


def test_exact_percentiles(spark):
    rng = np.random.default_rng(8)
    hot = np.concatenate([rng.standard_normal(9000), np.full(4000, 0.25), rng.integers(0, 5, 500)])
    values = {"hot": hot, "few": np.array([3.0, 1.0, 2.0]), None: np.array([7.0]), "wide": np.exp(rng.standard_normal(5000) * 20)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("hot", None), ("few", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    at = [0.0, 0.001, 0.1, 0.5, 0.9, 0.999, 1.0]
    for accuracy in (50, 1000, 10000):
        got = {r.k: (r.n, r.p) for r in R.exact_percentiles(df, ["k"], "v", at, accuracy).collect()}
        assert set(got) == set(values)
        for k, vs in values.items():
            assert got[k][0] == len(vs)
            assert np.allclose(got[k][1], np.quantile(vs, at), rtol=1e-9)
    whole = R.exact_percentiles(df.where("k = 'hot'"), [], "v", [0.5], 100).collect()
    assert [(r.n, r.p) for r in whole] == [(len(hot), [np.median(hot)])]
    assert R.exact_percentiles(df.limit(0), [], "v", [0.5]).count() == 0


def test_dense_index(spark, tmp_path):
    words = [f"w{i * 37 % 1000:03d}" for i in range(1000)] * 2 + [None, ""]
    got = R.dense_index(spark.createDataFrame([(w,) for w in words], "w string"), "w", "n", str(tmp_path / "labels"), 7).collect()
    assert sorted((r.w, r.n) for r in got) == [(w, i) for i, w in enumerate(sorted({w for w in words if w is not None}))]
    assert R.dense_index(spark.createDataFrame([], "w string"), "w", "n", str(tmp_path / "none")).count() == 0
