"""Scores against the explicit automaton, over several blocks and buckets."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import lm


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("size", [1 << 20, 700])
def test_scores_equal_the_explicit_automaton(spark, monkeypatch, size):
    monkeypatch.setattr(lm, "BLOCK_BYTES", size)
    monkeypatch.setattr(lm, "BUCKET_BYTES", size)
    monkeypatch.setattr(lm, "ROW_BYTES", 1)
    rng = random.Random(8)
    words = ["the", "of", "É", "a.", *(f"w{i}" for i in range(40))]
    texts = [" ".join(rng.choice(words[: rng.randrange(2, 44)]) for _ in range(rng.randrange(0, 60))) for _ in range(90)]
    rows = [(i, t, i % 4 == 0, "x") for i, t in enumerate([*texts, None, "", " \t\n", "THE of Zz", "qq rr ss", texts[5], texts[5]])] + [(None, "the of", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, out boolean, block string")
    model = lm.BackoffAutomaton([split(t) for _, t, out, _ in rows if not out])
    n, v = model.smoothing.tokens, model.smoothing.types
    got = {r.doc_id: r for r in lm.score_texts(df, F.col("out")).collect()}
    assert len(got) == len(rows)
    for i, t, out, _ in rows:
        tokens, r = [*split(t), ""], got[i]
        base = sum(math.log10((model.words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (bool(out), len(tokens), sum(model.words[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(model.score(split(t)), rel=1e-9)


def test_states_are_distributions():
    model = lm.BackoffAutomaton([["a", "b", "a", "b", "c"], ["a", "b", "a"], ["a", "b"], ["c"], []])
    assert ("a", "b") in model.fail and (None, "a") in model.fail and ("b", "c") not in model.fail
    for state in [*model.fail, ()]:
        total = sum(10 ** model.step(state, w)[0] for w in [*model.words, "never seen"])
        assert total == pytest.approx(1)


def test_failure_arcs_lead_to_the_longest_state():
    model = lm.BackoffAutomaton([["a", "b", "c"], ["a", "b", "d"], ["x", "b", "e"]])
    assert model.step(("a", "b"), "c")[1] == ("c",) and model.step((None,), "a")[1] == (None, "a")
    weight, after = model.step(("a", "b"), "e")  # unseen after a b, seen after b
    assert weight == pytest.approx(math.log10(model.fail["a", "b"]) + math.log10(model.arcs["b", "e"])) and after == ("e",)
    assert model.step(("a", "b"), "zz")[1] == ()


def test_lanes_of_long_texts(spark, monkeypatch):
    """Texts cut into lanes score as whole ones do."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("a b c d e f".split()) for _ in range(n))) for i, n in enumerate([0, 1, 6, 7, 8, 9, 15, 50, 300])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r.score for r in lm.score_texts(df, F.col("doc_id") == 8).collect()}
    monkeypatch.setattr(lm, "LANE", 7)
    cut = {r.doc_id: r.score for r in lm.score_texts(df, F.col("doc_id") == 8).collect()}
    assert cut == pytest.approx(whole, rel=1e-12)
    model = lm.BackoffAutomaton([split(t) for i, t in rows if i != 8])
    assert whole == pytest.approx({i: model.score(split(t)) for i, t in rows}, rel=1e-9)


def test_three_words_tell_more_than_two(spark):
    """A held-out text is likelier if its triples were seen than if only its pairs were."""
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choice(["a b c x y z", "d b e y x w"]) for _ in range(30))) for i in range(40)]
    rows += [(100, "a b c x y z"), (101, "a b e y x w")]
    got = {r.doc_id: r.score for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 100).collect()}
    assert got[100] > got[101] + 0.5


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    (r,) = lm.score_texts(df, F.lit(True)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, pytest.approx(3 * math.log10(0.5)))
    assert lm.score_texts(df.limit(0), F.lit(False)).collect() == []
