"""Licence passages against brute force over all passages of allowed sizes."""

import random
from collections import Counter

from lumenfold.llm.license import TEMPLATES, scan_licenses
from lumenfold.llm.normalise import plain, words


def grams(ws):
    return list(zip(ws, ws[1:], strict=False))


def best(text, threshold=0.8):
    """The largest coefficient of any passage with any template."""
    g, top = grams([w for w, *_ in words(text)]), 0.0
    for _, t in TEMPLATES:
        bag = Counter(grams([w for w, *_ in words(t)]))
        n = sum(bag.values())
        for i in range(len(g)):
            for j in range(i + 1, min(len(g), i + int(n * (2 - threshold) / threshold)) + 1):
                top = max(top, 2 * sum((Counter(g[i:j]) & bag).values()) / (n + j - i))
    return top


def test_words_agree():
    text = "Ünder the Kİx, 'Apache' v2.0\n\tß—x"
    assert [w.encode() for w, *_ in words(text)] == plain(text).split()


def test_scan(spark):
    rng = random.Random(13)
    filler = lambda n: " ".join(rng.choice(["of", "the", "under", "license", "public", "zx", "é", "version", "all", "rights"]) for _ in range(n))
    data, sure = [], {}
    for i, (name, text) in enumerate(TEMPLATES):
        data.append((i, filler(20) + " qq " + text.upper().replace(" ", "\n ") + " qq " + filler(30)))
        sure[i] = name
        ws = text.split()
        if len(ws) > 25:
            ws[rng.randrange(len(ws))] = "changed"
            data.append((100 + i, "qq " + " ".join(ws) + " qq"))
            sure[100 + i] = name
    data += [(200 + i, filler(rng.randrange(0, 40))) for i in range(60)] + [(300, None), (301, ""), (302, "All rights"), (None, "All rights reserved."), (303, "All rights reserved. " * 3)]
    df = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, license string")
    got = scan_licenses(df).collect()
    texts = dict(data)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        passage = [w for w, *_ in words(texts[r.doc_id][r.start : r.end])]
        assert len(passage) == r.n_words
        assert any(abs(2 * sum((Counter(grams(passage)) & (bag := Counter(grams([w for w, *_ in words(t)])))).values()) / (sum(bag.values()) + len(passage) - 1) - r.dice) < 1e-12 for n, t in TEMPLATES if n == r.license)
    assert {i: {r.license for r in by[i]} >= {n} for i, n in sure.items()} == dict.fromkeys(sure, True)
    for i, t in data:
        if i is not None and i >= 200:
            assert (i in by) == (best(t or "") >= 0.8)
            if i in by:
                assert abs(max(r.dice for r in by[i]) - best(t)) < 1e-12
    assert len(by[303]) == 3 and len(by[None]) == 1
    assert scan_licenses(df.limit(0)).collect() == []


def test_sibling_licences_are_told_apart(spark):
    """Stewards' notices with what stands around them in files."""
    gnu = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version. This {} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    of = lambda name: max((t for n, t in TEMPLATES if n == name), key=len)
    data = {
        "GPL-2.0": gnu.format("program", ";", "General Public License", ";", "2", "program"),
        "GPL-3.0": gnu.format("program", ":", "General Public License", ",", "3", "program"),
        "AGPL-3.0": gnu.format("program", ":", "Affero General Public License", ",", "3", "program"),
        "LGPL-2.1": gnu.format("library", ";", "Lesser General Public License", ";", "2.1", "library"),
        "LGPL-3.0": gnu.format("library", ":", "Lesser General Public License", ",", "3", "library"),
        "BSD-2-Clause": of("BSD-2-Clause").replace("met: R", "met: 1. R").replace("disclaimer. R", "disclaimer. 2. R"),
        "BSD-3-Clause": of("BSD-3-Clause").replace("met: R", "met: 1. R").replace("disclaimer. R", "disclaimer. 2. R").replace("Neither", "3. Neither"),
        **{n: of(n) for n in ("MIT", "ISC", "0BSD", "Unlicense", "CC0-1.0", "EPL-2.0", "Zlib")},
    }
    df = spark.createDataFrame([(n, f"// Copyright 2020 Some One\n// {t}\nint main() {{}}") for n, t in data.items()], "doc_id string, text string")
    got = {}
    for r in scan_licenses(df).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert got == {n: {n} for n in data}
