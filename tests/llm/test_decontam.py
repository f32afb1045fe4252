"""Leaks against brute force over every placement."""

import itertools
import random

import numpy as np

from lumenfold.llm.decontam import MASKS, Settings, _overlap, find_leaks
from lumenfold.llm.normalise import plain


def test_masks_hit_every_window_with_two_substitutions():
    for bad in itertools.combinations(range(13), 2):
        assert any(not any(at + o in bad for o in mask) for mask in MASKS for at in range(13 - mask[-1]))


def brute(docs, items, s):
    best = {}
    for (d, t), (i, u) in itertools.product(docs, items):
        a, b = plain(t).split(), plain(u).split()
        if not b:
            continue
        code = {w: n for n, w in enumerate({*a, *b})}
        x, y = np.array([code[w] for w in b], int), np.array([code[w] for w in a], int)
        for offset in range(-len(b), len(a)):
            found = _overlap(x, y, offset, s)
            if found:
                start, n, matched = found
                best[d, i] = max(best.get((d, i), (0, 0, 0)), (matched, -start, n))
    return {(d, i, -b[1], b[2], b[0]) for (d, i), b in best.items()}


def test_find_leaks(spark):
    rng = random.Random(11)
    word = lambda: rng.choice(["the", "of", "and", "Á", *("".join(rng.choice("abcdeg") for _ in range(4)) for _ in range(3))])
    text = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(text(n))) for i, n in enumerate([15, 20, 40, 59, 8, 13, 3, 30])]
    items += [(50, items[2][1]), (51, None), (52, ""), (None, " ".join(text(20)))]
    docs = [(i, " ".join(text(rng.randrange(0, 200)))) for i in range(40)]
    for n, (_, u) in enumerate(items[:8] * 4):
        words = u.split()
        for _ in range(len(words) // 13 * 2 if n % 2 else 0):
            words[rng.randrange(len(words))] = "zz"
        if n % 3 == 0:
            words = words[: max(13, len(words) // 2)]
        at = text(50)
        docs.append((100 + n, " ".join([*at[:25], ", ".join(words).upper(), *at[25:]])))
    docs += [(200, None), (201, ""), (None, "x " + items[1][1]), (202, items[3][1] + "\n" + items[3][1])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, row long")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    s = Settings()
    got = {(r.doc_id, r.item_id, r.start_word, r.n_words, r.matched) for r in find_leaks(df, bench, settings=Settings(block=16)).collect()}
    want = brute(docs, items, s)
    assert got == want
    assert len(got) > 30
    assert find_leaks(df.limit(0), bench).collect() == [] == find_leaks(df, bench.limit(0)).collect()


def test_short_items_equal_brute_force(spark):
    """Items of 1 to 12 words under every choice of as many substitutions as 80 % allows."""
    items, docs = [], []
    for n in range(1, 13):
        words = [f"i{n}w{j}" for j in range(n)]
        items.append((n, " ".join(words)))
        for bad in itertools.combinations(range(n), n // 5):
            docs.append((len(docs), " ".join(["x", *("zz" if j in bad else w for j, w in enumerate(words)), "y"])))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.start_word, r.n_words, r.matched) for r in find_leaks(df, bench).collect()}
    assert got == brute(docs, items, Settings()) and len(got) == len(docs)


def test_hot_seed_in_long_texts(spark):
    """Texts of thousands of words that share a phrase with many items: none leaks but the one that holds an item whole."""
    phrase = "alpha beta gamma delta epsilon zeta eta theta"
    items = [(i, f"{phrase} " + " ".join(f"q{i}x{j}" for j in range(20))) for i in range(40)]
    filler = " ".join(f"w{j % 97}" for j in range(60))
    docs = [(i, " ".join([f"{filler} {phrase}"] * 60)) for i in range(6)]
    docs.append((99, f"{filler} " * 40 + items[7][1] + f" {filler}"))
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.start_word, r.n_words, r.matched) for r in got] == [(99, 7, 2400, 28, 28)]


def test_repeated_and_null_ids(spark):
    """Items and texts that share an id or have none, equal texts under several ids, and a benchmark without any id."""
    a, b, c = (" ".join(f"{x}{j}" for j in range(20)) for x in "abc")
    short = c.split()
    docs = [(1, f"x {a} y"), (2, f"{b} z"), (3, f"{b} w {a}"), (4, "nothing here"), (4, " ".join(short[:14])), (4, f"u v {c}"), (None, b), (None, "q " + a), (5, a)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    for items in ([(7, a), (7, b), (8, b), (None, a), (9, c), (9, c)], [(None, a), (None, c)], [(1, "a3"), (1, "b3"), (None, "b3 b4")]):
        got = [(r.doc_id, r.item_id, r.start_word, r.n_words, r.matched) for r in find_leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(docs, items, Settings()) and got


def test_hot_words_as_items(spark):
    """Items of one and two words that texts hold thousands of times: one hit for each text is enough."""
    text = " ".join(["the", "of", "the", "x"] * 3000)
    docs = [(i, f"w{i} {text}") for i in range(6)] + [(9, "of the end"), (10, "other")]
    items = [(1, "the"), (2, "of the"), (3, "x the"), (4, "end"), (5, "the the")]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    got = {(r.doc_id, r.item_id, r.start_word, r.n_words, r.matched) for r in find_leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got == {(i, item, at, n, n) for i in range(6) for item, at, n in ((1, 1, 1), (2, 2, 2), (3, 4, 2))} | {(9, 1, 1, 1, 1), (9, 2, 0, 2, 2), (9, 4, 2, 1, 1)}
