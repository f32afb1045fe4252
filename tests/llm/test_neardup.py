"""Near-duplicate components against brute force over all pairs."""

import random
import re

from lumenfold.llm.components import connected_components
from lumenfold.llm.common import Workspace
from lumenfold.llm.neardup import near_duplicates, overlap_for, Settings
from lumenfold.llm.wordhash import word_hashes


def brute(rows, percent=85, words=5):
    """{id: (n, component)} for distinct ids."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            common = len(a & b) if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) else 0
            if common and 100 * common >= percent * (len(a) + len(b) - common):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    text = lambda n: [word() for _ in range(n)]
    passage, rows = text(60), []
    for _ in range(60):
        rows.append(text(rng.randrange(1, 300)))
    for n in (3, 4, 5, 6, 30, 70, 150, 600):
        base = text(n)
        rows.append(base)
        for _ in range(14):
            near = list(base)
            for _ in range(rng.randrange(0, max(2, n // 45))):
                near[rng.randrange(n)] = word()
            rows.append(near)
    chain = text(200)
    for step in range(12):  # neighbours are similar, the ends aren't
        rows.append(list(chain))
        chain[step * 15 : step * 15 + 2] = text(2)
    for n in (10, 25, 40, 80, 200):
        for _ in range(6):
            at = rng.randrange(n)
            own = text(n)
            rows.append(own[:at] + passage + own[at:])
    texts = [" ".join(w) for w in rows]
    texts += [texts[0]] * 40 + [texts[3].upper(), texts[3].replace(" ", "\t\n"), "", "   ", "\n", "a", "a", "A b", "a b"]
    rng.shuffle(texts)
    return [*enumerate(texts), (len(texts), None)]


def test_components_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, n long, id string")
    want = brute(rows)
    for settings in (Settings(), Settings(k=24, long_k=100)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, settings=settings).collect()}
        assert got == want
    assert len({c for _, c in want.values()}) < len(rows) - 100


def test_no_link_is_lost_among_thousands_of_pairs(spark):
    """Many edited copies of few texts, linked to some and nearly to the others."""
    rng = random.Random(9)
    rows = []
    for n in (40, 120, 300):
        base = [f"w{rng.randrange(500)}" for _ in range(n)]
        for _ in range(90):
            near = list(base)
            for _ in range(rng.randrange(0, max(2, n // 25))):
                near[rng.randrange(n)] = f"x{rng.randrange(3)}"
            rows.append(" ".join(near))
    rng.shuffle(rows)
    want = brute(list(enumerate(rows)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == want


def test_edges_of_the_contract(spark):
    same = "one two three four five six"
    df = spark.createDataFrame([(7, same), (7, same), (9, same), (None, same), (11, None), (12, "")], "doc_id long, text string")
    got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(7, 2, 7, True), (7, 2, 7, True), (9, 2, 7, False), (None, 2, None, None), (11, 0, 11, True), (12, 0, 12, True)], key=str)
    assert near_duplicates(df.limit(0)).collect() == []


def test_connected_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(5, 5), (None, 3)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test"), "t").collect()
    assert {r.node: r.root for r in found} == {i: find(i) for i in root}
    assert len(found) == len(root)


def test_overlap_is_far_in_the_tail():
    assert 30 <= overlap_for(Settings(), 64) <= 40 and 750 <= overlap_for(Settings(), 1024) <= 850


def test_links_of_sets_about_as_large_as_a_sketch(spark):
    """The larger set's sketch is a sample where the smaller set's is whole."""
    rng, rows, pairs = random.Random(17), [], []
    sizes = [(60, 70), (61, 71), (62, 72), (63, 74), (64, 74), (64, 75), (1000, 1170), (1000, 1176), (1020, 1200), (1024, 1204)]
    for n, m in sizes * 8:
        words = [f"w{rng.randrange(10**9)}" for _ in range(m + 4)]
        pairs.append(len(rows))
        rows += [" ".join(words[: n + 4]), " ".join(words)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [i for i in pairs if got[i + 1] != i] == []


def test_long_words_that_polynomials_confuse():
    """Thue-Morse words and their complements, whose polynomials modulo 2 ** 64 are equal for any radix."""
    word = "a"
    while len(word) < 8192:
        word += word.translate(str.maketrans("ab", "ba"))
        other = word.translate(str.maketrans("ab", "ba"))
        (a, b, c), _ = word_hashes([word.encode(), other.encode(), b"x " + word.encode()])[0][[0, 1, 3]], None
        assert a != b and a == c
