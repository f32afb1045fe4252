"""Language identification: held-out accuracy, rejection, and features against a plain count."""

import random

import numpy as np

from lumenfold.llm import langid

SPOKEN = {
    "en": "the of and that with tion ing er ed th sh wh ly".split(),
    "de": "der die und ein sch ung keit ch ß ü ö tz pf".split(),
    "fr": "le la des est eau oux tion é è ê qu ment oi".split(),
    "es": "el los que ción ado ñ í ó mente rr ll as os".split(),
}


def sentence(rng, lang, n):
    parts = SPOKEN[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def test_held_out_accuracy(spark):
    rng = random.Random(31)
    rows = [(i, sentence(rng, lang := list(SPOKEN)[i % 4], rng.randrange(8, 60)), lang, "x") for i in range(800)]
    extra = [(None, rows[0][1], "en", "x"), (5000, None, "en", "x"), (5001, "", None, "x"), (5002, "123 !?", "de", "x"), (5003, rows[1][1], None, "x"), (5003, rows[1][1], None, "x")]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, score string")
    model = langid.train(df.where("doc_id % 7 <> 2 or doc_id is null"), settings=langid.Settings(sample=100))
    assert model.languages == tuple(sorted(SPOKEN))
    got = langid.identify(df, model).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    assert np.mean([by[i].lang_pred == lang for i, _, lang, _ in rows if i % 7 == 2]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    for i in (5000, 5001, 5002):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert sum(by[i].rejected for i, *_ in rows) == 0
    assert langid.identify(df.limit(0), model).collect() == []


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "hello", None)], "doc_id long, text string, lang string")
    (r,) = langid.identify(df, langid.train(df)).collect()
    assert (r.lang_pred, r.score) == ("und", 0.0)


def test_one_language(spark):
    df = spark.createDataFrame([(i, f"hello {i} there", "en") for i in range(20)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.identify(df, langid.train(df)).collect()} == {("en", 1.0)}


def test_long_texts_are_read_whole(monkeypatch):
    rng = random.Random(32)
    text = " ".join(sentence(rng, lang, 40) for lang in SPOKEN) + " 12, x"
    ids, counts = langid.features(text, 12)
    monkeypatch.setattr(langid, "SEGMENT", 37)
    again, more = langid.features(text, 12)
    assert (ids == again).all() and (counts == more).all()


def test_junk_and_unlearnt_languages_are_rejected(spark):
    rng = random.Random(33)
    rows = [(i, sentence(rng, lang := list(SPOKEN)[i % 4], rng.randrange(8, 60)), lang) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id < 800"))
    names, scores, rejected = langid.predict(model, [t for _, t, _ in rows[800:]])
    assert sum(rejected) == 0 and np.mean([n == lang for n, (_, _, lang) in zip(names, rows[800:], strict=True)]) > 0.97
    junk = [
        "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему.",
        "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。",
        "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
        "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, ché la diritta via era smarrita",
        " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(3, 9))) for _ in range(60)),
        " ".join(f"{rng.getrandbits(128):032x}" for _ in range(20)),
        '<td colspan="2"><span id="qk">&nbsp;</span></td>' * 8,
    ]
    assert langid.predict(model, junk)[2] == [True] * len(junk)
    # one new word in a long text that repeats itself is no other language
    text = sentence(rng, "en", 2000) + " xqj" * 60
    ids, counts = langid.features(text, model.bits)
    assert counts[model.new[ids]].sum() > 0.01 * counts.sum() and langid.predict(model, [text])[2] == [False]


def test_sample_is_500_rows_a_language(spark, monkeypatch):
    """As before it was halved together with a change of memory; the whole of 400 rows is learnt from."""
    rng = random.Random(34)
    df = spark.createDataFrame([(i, sentence(rng, list(SPOKEN)[i % 2], 12), list(SPOKEN)[i % 2]) for i in range(800)], "doc_id long, text string, lang string")
    learnt, fit = [], langid.fit
    monkeypatch.setattr(langid, "fit", lambda rows, settings: learnt.extend(rows) or fit(rows, settings))
    langid.train(df)
    assert len(learnt) == 800


def test_numerals_are_no_letters():
    model = langid.fit([("en", *langid.features("the cat", 12))], langid.Settings(bits=12))
    assert langid.predict(model, ["½ ² ① Ⅷ", "12_3", "é"])[0] == ["und", "und", "en"]


def test_fixture_model_keeps_ordinary_texts(spark):
    """Learnt from the fixture, whose words are made up of syllables, so that most words of real texts are unlearnt."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where("pmod(crc32(cast(doc_id as string)), 4) <> 2"))
    ordinary = {
        "We hold these truths to be self-evident, that all men are created equal, that they are endowed by their Creator with certain unalienable Rights": "en",
        "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt": "de",
        "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia": "es",
        "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience": "fr",
    }
    names, _, rejected = langid.predict(model, list(ordinary))
    assert names == list(ordinary.values()) and not any(rejected)
    rng = random.Random(35)
    junk = [
        "deadbeef 0a1b2c3d4e5f aabbccdd",
        " ".join(f"{rng.getrandbits(64):016x}" for _ in range(40)),
        "for (int i = 0; i < n; ++i) { ptr->next = malloc(sizeof(struct node)); if (!ptr) goto err; }",
        "SGVsbG8gd29ybGQhIFRoaXMgaXMgYSB0ZXN0 QmFzZTY0IGVuY29kZWQgc3RyaW5ncyBhcmUganVuaw",
        "Все счастливые семьи похожи друг на друга",
        "吾輩は猫である。名前はまだ無い。",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
    ]
    assert all(langid.predict(model, junk)[2])
    assert not any(r.rejected for r in langid.identify(docs.where("text is not null and lang is not null"), model).collect())


def test_rate_of_false_rejections(spark):
    """Held-out texts with up to half of their subwords replaced by unlearnt ones stay, but for about the named rate."""
    rng = random.Random(36)
    rows = [(i, sentence(rng, lang := list(SPOKEN)[i % 4], rng.randrange(20, 60)), lang) for i in range(1600)]
    model = langid.train(spark.createDataFrame(rows[:1200], "doc_id long, text string, lang string"))
    masked = []
    for _, text, _ in rows[1200:]:
        words, size = text.split(" "), 3 * len(text) + len(text.split())
        while sum(3 * len(w) for w in words[len(text.split()):]) < 0.4 * size:
            words.append("".join(rng.choice("жщфюцчш") for _ in range(3)))
        masked.append(" ".join(words))
    assert sum(langid.predict(model, masked)[2]) <= 0.01 * len(masked)
