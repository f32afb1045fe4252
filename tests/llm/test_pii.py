"""Personal data against plain regexes and a plain re-statement of the votes' estimate."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from lumenfold.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd = [int(d) for d in digits[::-1][::2]]
    even = [sum(divmod(2 * int(d), 10)) for d in digits[::-1][1::2]]
    return (sum(odd) + sum(even)) % 10 == 0


def base(text):
    out = {}
    for kind, p in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out[kind].append((m.start(), m.end()))
    return out


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in spans[k])


PARTS = ["a.b@mail.example.com", "x@y", "@", "1.2.3.4", "999.1.1.1", "0001.02.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "+1 (988) 555-2485", "+49 30 1234567", "+", "+1+1", "12", "é😀", " ", "\n", "a@b.c_d@e.f", "%x@e.f.", "..", "-", "word", "0" * 30, "(", "5500 0000 0000 0004 7", "1234.5678"]


def test_base_spans_equal_plain_regexes(spark):
    rng = random.Random(14)
    texts = [None, "", *PARTS, *("".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 30))) for _ in range(400)), "7 " * 20000, "a" * 50000 + "@b.c"]
    df = spark.createDataFrame([*((i, t, "x") for i, t in enumerate(texts)), (None, "a@b.cd", "x")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.digests(pii.find_spans(df)).collect()}
    for i, t in enumerate(texts):
        want, r = base(t or ""), got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(want[k]) for k in pii.KINDS), t
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest(), t
        assert set(filter(None, joined(want).split(","))) <= set(r.spans.split(","))
    assert got[None].n_email == 1
    assert pii.find_spans(df.limit(0)).collect() == []


LOOSE = ["write to bob (at) mail (dot) com now", "mail: joe.x [at] site.org", "call 555-123-4567 today", "tel (212) 555-0100.", "ip 2001:0db8:0000:0000:0000:ff00:0042:8329 up", "card 4111.1111.1111.1111 ok", "order 4111.1111.1111.1112 ok", "isbn 978-123-4567 x", "x555-123-4567y"]


def test_looser_spans_and_redaction(spark):
    strict = ["mail a.b@mail.example.com x", "call +1 (988) 555-2485 x", "host 42.144.35.254 x", "card 4041894974608795 x"] * 20
    df = spark.createDataFrame(list(enumerate(strict + LOOSE)), "doc_id long, text string")
    found = pii.find_spans(df)
    spans = {k: F.col(f"spans_{k}") for k in pii.KINDS}
    out = {r.text: r.red for r in found.select("text", pii.redacted(F.col("text"), spans).alias("red")).collect()}
    assert out[strict[0]] == "mail [EMAIL] x" and out[strict[1]] == "call [PHONE] x"
    assert out[LOOSE[0]] == "write to [EMAIL] now" and out[LOOSE[1]] == "mail: [EMAIL]" and out[LOOSE[3]] == "tel [PHONE]."
    assert out[LOOSE[5]] == "card [CARD] ok" and out[LOOSE[6]] == LOOSE[6] and out[LOOSE[8]] == LOOSE[8]


def test_the_classifier_in_sql_is_the_fitted_one(spark):
    counts = {("email", "22222"): 90, ("email", "12202"): 7, ("email", "10100"): 20, ("phone", "22212"): 40, ("phone", "10110"): 30, ("card", "12222"): 3}
    own = pii.fit(counts)
    posterior, rates = pii.estimate(counts)
    assert posterior["email", "22222"] > 0.9 > 0.1 > posterior["email", "10100"]
    assert all(abs(sum(r.values()) - 1) < 1e-9 for r in rates.values())
    df = spark.createDataFrame([(v,) for _, v in counts], "votes string")
    for kind in ("email", "phone", "card"):
        for r in df.select("votes", own.column(kind, F.col("votes")).alias("z")).collect():
            assert abs(r.z - own.logit(kind, r.votes)) < 1e-9


def test_nothing_to_learn_from():
    assert pii.fit({}).logit("email", "22222") > 0


def test_thousands_of_matches_in_one_text(spark):
    """Places, votes and redaction of a text whose matches fill many blocks and segments."""
    n = 5000
    text = "é 😀 mail " + ", ".join(f"u{i}@m{i % 77}.example.com or 10.0.{i % 256}.{i % 251}" for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    own = pii.fit({("email", "22222"): 90})
    want = base(text)
    (r,) = pii.digests(pii.find_spans(df, classifier=own)).collect()
    assert (r.n_email, r.n_ip) == (n, n) and r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
    (r,) = pii.redact(df, classifier=own).collect()
    assert r.text == "é 😀 mail " + ", ".join(["[EMAIL] or [IP]"] * n)
