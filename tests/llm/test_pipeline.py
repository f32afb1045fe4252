"""The pipeline's stages on planted documents."""

import random
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from test_langid import SPOKEN, sentence

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(21)
    items = [(i, sentence(rng, "en", 30)) for i in range(5)]
    docs = []
    for i in range(120):
        lang = list(SPOKEN)[i % len(SPOKEN)]
        docs.append([i, sentence(rng, lang, rng.randrange(20, 120)), lang, f"src{i % 3}"])
    docs += [[200, docs[0][1], "en", "copy"], [201, docs[5][1] + " extra", docs[5][2], "near"], [202, "12345 !!! ###", "en", "junk"], [203, None, "en", "null"], [204, "", "en", "empty"]]
    docs += [[300 + i, sentence(rng, "en", 30) + " " + items[i][1] + " " + sentence(rng, "en", 30), "en", "leak"] for i in range(3)]
    docs += [[400, sentence(rng, "en", 20) + " mail joe.x@mail.example.com now " + sentence(rng, "en", 20), "en", "pii"]]
    rows = [(d[0], d[1], d[2], d[3], len(d[1] or "")) for d in docs]
    where = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, {r[0]: r for r in rows}


def test_stages(spark, planted, tmp_path):
    where, rows = planted
    docs, kept = spark.read.parquet(f"{where}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, where)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == COLUMNS
            kept[name] = {r.doc_id: r for r in docs.collect()}
    assert set(kept["language_id"]) == set(rows) - {202, 203, 204}
    assert set(kept["near_dedup"]) == set(kept["language_id"]) - {200, 201}
    assert set(kept["decontamination"]) == set(kept["near_dedup"]) - {300, 301, 302}
    assert set(kept["personal_data"]) == set(kept["decontamination"])
    for i, r in kept["personal_data"].items():
        if i == 400:
            assert "[EMAIL]" in r.text and "@" not in r.text and r.n_chars == len(r.text)
        else:
            assert tuple(r) == rows[i]
    pieces = defaultdict(int)
    for r in docs.collect():
        pieces[r.doc_id] += r.length
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert dict(pieces) == {i: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in kept["personal_data"].items()}


def test_run(spark, planted):
    where, rows = planted
    got = {r.doc_id for r in corpus_pipeline.run(spark, where).collect()}
    assert got == set(rows) - {200, 201, 202, 203, 204, 300, 301, 302}


def test_near_copies_of_a_similarity_from_0_8(spark, planted):
    where, _ = planted
    rng, rows, gone = random.Random(23), [], set()
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    for shared, gains in ((158, False), (160, True), (164, True), (168, True), (170, True)):  # of 200 shingles
        text = words(204)
        rows += [" ".join(text), " ".join(text[: shared + 4])]
        gone |= {len(rows) - 1} if gains else set()
    text = words(204)
    rows += [" ".join(text), " ".join(text[:184] + words(20))]  # 180 of 220
    gone.add(len(rows) - 1)
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, where).collect()}
    assert kept == set(range(len(rows))) - gone


WIDE = "doc_id long, text string, lang string, source string, n_chars long, language string, id long, kept boolean, item_id long, component_id string, row int, passage string"


def test_odd_rows_and_clashing_columns(spark, planted):
    """Repeated and null ids, null, empty and very long texts, further columns: each stage by its rules."""
    where, _ = planted
    rng = random.Random(31)
    leak = spark.read.parquet(f"{where}/benchmark.parquet").where("item_id = 2").first().text
    plain = [sentence(rng, "en", 40) for _ in range(5)]
    long = " ".join(sentence(rng, "en", 1000) for _ in range(40))
    texts = [(1, plain[0]), (1, plain[1]), (2, plain[1]), (3, plain[0]), (None, plain[0]), (4, None), (5, ""), (6, long), (7, long + " " + leak), (8, "x " + leak), (8, plain[2]), (None, "y " + leak), (9, plain[3]), (9, plain[3])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "c", 5, True, 6, "d", 7, "e") for i, t in texts], WIDE)
    key = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    without = lambda *ids: sorted(((i, t) for i, t in texts if i not in ids), key=str)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, where)
    assert out.columns == docs.columns and key(out) == without(2, 3, 7)  # 7 is near 6
    out = corpus_pipeline.drop_leaks(spark, docs, where)
    assert out.columns == docs.columns and key(out) == without(7, 8)  # both rows of 8, but none without an id
    out = corpus_pipeline.redact_personal_data(spark, docs, where)
    assert out.columns == docs.columns and key(out) == without() and all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
    corpus = spark.read.parquet(f"{where}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars", "lang AS language", "5L AS id", "true AS kept", "6L AS item_id", "'d' AS component_id", "7 AS row", "'e' AS passage")
    out = corpus_pipeline.identify_language(spark, docs.unionByName(corpus), where)
    assert out.columns == docs.columns and key(out.where("doc_id < 1000 OR doc_id IS NULL")) == without(4, 5)
    packed = corpus_pipeline.pack(spark, docs, where)
    pieces = defaultdict(int)
    for r in packed.collect():
        pieces[r.doc_id] += r.start == 0
    assert dict(pieces) == {i: sum(j == i for j, _ in texts) for i, _ in texts}


def test_empty_table(spark, planted):
    where, _ = planted
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame([], WIDE)
        out = stage(spark, docs, where)
        assert out.collect() == [] and (name == "packing" or out.columns == docs.columns)


def test_leaks_of_benchmarks_with_repeated_and_null_ids(spark, tmp_path):
    """A clean document stays, whichever ids the benchmark gives its items."""
    a, b, c = (" ".join(f"{x}{j}" for j in range(20)) for x in "abc")
    docs = spark.createDataFrame([(1, a), (2, b), (3, c), (4, f"{c} {b}"), (5, "other words")], "doc_id long, text string")
    for n, (items, gone) in enumerate([([(7, a), (7, b)], {1, 2, 4}), ([(None, a)], {1}), ([(None, a), (8, c), (None, c)], {1, 3, 4})]):
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/{n}/benchmark.parquet")
        kept = {r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs, f"{tmp_path}/{n}").collect()}
        assert kept == {1, 2, 3, 4, 5} - gone
