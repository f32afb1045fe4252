"""Personal data by weak supervision, with DataFrame and SQL functions only.

Candidates come from two sets of patterns: the base patterns, whose valid matches always stay, and looser spellings of
the same kinds (bracketed "(at)" addresses, phone numbers without a plus, IPv6, cards written with dots). Labelers vote
on each candidate (1 for, -1 against, 0 none): regex, checks of the value, gazetteers, context words and the
characters around it. Votes are counted by pattern, of which there are at most 4 * 3 ** 5, over all texts; expectation
maximisation on these counts estimates each labeler's reliability and each pattern's posterior, on which a logistic
span classifier is trained. Its weights go into a SQL expression that decides on the looser candidates.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import narrow

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "check", "gazetteer", "context", "shape")

# The base patterns. Possessive groups and the look-behind only save the regex engine work: a match
# begins where a run of its first class begins, or where the match before ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[\(\[]at[\)\]]\x20?[A-Za-z0-9-]++(?:\x20?[\(\[]dot[\)\]]\x20?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.])[0-9]{4}(?:\.[0-9]{4}){3}(?:\.?[0-9]{1,3})?(?![0-9.])",
    "phone": r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
# Gazetteers and context words.
TOP_DOMAINS = "com org net edu gov int info io de fr es it uk eu us ca ch at be nl pl pt se".split()
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
DIAL_PREFIX = r"^(?:1|33|34|39|41|43|44|49|31|32|351|45|46|47|48|61|81|86|91)"
RESERVED_IP = r"^(?:0|127|255)\."
FOR_WORDS = {
    "email": "mail email e-mail contact write courriel correo kontakt",
    "ip": "ip address host server login adresse",
    "card": "card visa mastercard amex payment carte tarjeta karte",
    "phone": "phone tel call mobile fax cell telefon telefono appel",
}
AGAINST_WORDS = "version isbn issn invoice order serial build doi"

EMPTY = "cast(array() as array<struct<start:int,end:int,value:string>>)"


def _gate(text: Column, kind: str, loose: bool) -> Column:
    """A cheap test that every text with a match passes."""
    if kind == "email":
        return text.rlike(r"[\(\[]at[\)\]]") if loose else text.contains("@")
    if kind == "ip":
        return text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]") if loose else text.rlike(r"[0-9]\.[0-9]")
    if kind == "card":
        return text.rlike(r"[0-9]{4}\.[0-9]{4}") if loose else text.rlike("[0-9]{2}|[0-9][ -][0-9]")
    return text.rlike("[0-9]{3}[ .-][0-9]{4}") if loose else text.rlike(r"\+[0-9]")


# Arrays and texts of any length. What Spark binds in a lambda is evaluated once; anything else, for each element.


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(items: Column, zero: Column, add, merge, out, depth: int = 2) -> Column:
    """``out`` of each element and of what ``add`` gathers of all elements before it; null if there are none.

    Blocks of about the square root of n elements are summed first, and blocks of each of these in turn, so that the
    work grows as n to the power 1.25.
    """

    def scan(xs: Column, first: Column, depth: int) -> Column:
        if not depth:
            return F.transform(xs, lambda x, i: out(x, F.aggregate(F.slice(xs, 1, i), first, add)))
        return _let(_blocks(xs), lambda blocks: over(blocks, first, depth))

    def over(blocks: Column, first: Column, depth: int) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, zero, add))
        return _let(totals, lambda sums: F.flatten(F.transform(blocks, lambda block, k: _let(F.aggregate(F.slice(sums, 1, k), first, merge), lambda before: scan(block, before, depth - 1)))))

    return _let(items, lambda xs: F.when(F.size(xs) > 0, scan(xs, zero, depth)))


def _blocks(xs: Column) -> Column:
    """An array that isn't empty in blocks of about the square root of its size."""
    width = F.ceil(F.sqrt(F.size(xs).cast("double"))).cast("int")
    return _let(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / w).cast("int")), lambda k: F.slice(xs, k * w + 1, w)))


def _segments(text: Column) -> Column:
    """size, parts: a text in parts of ``size`` code points, so that cutting from its middle doesn't begin at its start."""
    length = F.length(text)
    size = F.greatest(F.lit(2048), (4 * F.sqrt(length.cast("double"))).cast("int"))
    parts = _let(size, lambda n: F.struct(n.alias("size"), F.transform(F.sequence(F.lit(0), F.floor(length / n).cast("int")), lambda k: F.substr(text, k * n + 1, n)).alias("parts")))
    return F.when(length > 2048, parts).otherwise(F.struct(F.lit(2048).alias("size"), F.array(text).alias("parts")))


def _cut(segments: Column, start: Column, n: Column) -> Column:
    """n code points of a text in segments, from ``start`` on; fewer at its end, none beyond it."""
    size = segments["size"]
    first, last = F.floor(start / size).cast("int"), F.floor((start + F.greatest(n, F.lit(1)) - 1) / size).cast("int")
    joined = F.array_join(F.slice(segments["parts"], first + 1, last - first + 1), "")
    return F.substr(joined, start - first * size + 1, F.greatest(n, F.lit(0)))


def _matches(text: Column, pattern: str, gate: Column) -> Column:
    """Leftmost non-overlapping matches with code points: gaps from split, values from extract, in step."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value")))

    def place(x: Column, at: Column) -> Column:
        start = at + x["gap"]
        return F.struct(start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value"))

    found = _scan(pairs, F.lit(0), lambda at, x: at + x["gap"] + F.coalesce(F.length(x["value"]), F.lit(0)), lambda a, b: a + b, place)
    return F.when(gate, F.filter(found, lambda x: x["value"].isNotNull())).otherwise(F.expr(EMPTY))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    """Whether a match of the base pattern is kept."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    n = F.length(_digits(value))
    if kind == "card":
        return n.between(16, 19) & F.call_function("luhn_check", _digits(value))
    return n.between(8, 15)


def _votes(kind: str, loose: bool, segments: Column, x: Column) -> Column:
    """The labelers' votes on a candidate, as digits 0 (against), 1 (none), 2 (for) in the order of LABELERS."""
    value, digits = x["value"], _digits(x["value"])
    around = F.lower(_cut(segments, F.greatest(x["start"] - 30, F.lit(0)), F.least(x["start"], F.lit(30))))
    before, after = _cut(segments, F.greatest(x["start"] - 1, F.lit(0)), F.least(x["start"], F.lit(1))), _cut(segments, x["end"], F.lit(1))
    either = lambda c: F.when(c, "2").otherwise("0")
    if kind == "email":
        top = F.lower(F.regexp_extract(value, r"(?<![A-Za-z0-9-])([A-Za-z0-9-]++)$", 1))
        check, gazetteer = either(top.rlike("^[a-z]{2,}$")), F.when(top.isin(TOP_DOMAINS), "2").otherwise("1")
    elif kind == "ip":
        check = either(F.lit(True) if loose else _valid(kind, value))
        gazetteer = F.when(value.rlike(RESERVED_IP), "0").otherwise("1")
    elif kind == "card":
        check, gazetteer = either(F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)), either(digits.rlike(CARD_PREFIX))
    else:
        check = either(F.length(digits).between(10 if loose else 8, 15))
        gazetteer = F.when(digits.rlike(DIAL_PREFIX) if not loose else digits.rlike("^[2-9]"), "2").otherwise("1")
    words = lambda w: r"\b(?:" + "|".join(w.split()) + r")\b"
    context = F.when(around.rlike(words(AGAINST_WORDS)), "0").when(around.rlike(words(FOR_WORDS[kind])), "2").otherwise("1")
    shape = either(~before.rlike(r"[\p{L}0-9]") & ~after.rlike(r"[\p{L}0-9]"))
    return F.concat(F.lit("1" if loose else "2"), check, gazetteer, context, shape)


# Functions of one array element for a fixed kind; Spark takes every parameter of a lambda for an element.


def _valid_of(kind: str):
    return lambda x: _valid(kind, x["value"])


def _apart(spans: Column, others: Column) -> Column:
    """Spans that overlap none of the others, which are in order and don't overlap each other: blocks of them first."""
    meets = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])
    bound = lambda b: F.struct(b[0]["start"].alias("start"), F.element_at(b, -1)["end"].alias("end"), b.alias("spans"))
    kept = lambda blocks: F.filter(spans, lambda x: ~F.exists(blocks, lambda b: meets(x, b) & F.exists(b["spans"], lambda y: meets(x, y))))
    return F.when((F.size(others) > 0) & (F.size(spans) > 0), _let(F.transform(_blocks(others), bound), kept)).otherwise(spans)


def _apart_from(others: Column):
    return lambda spans: _apart(spans, others)


def _voted(kind: str, loose: bool, segments: Column):
    return lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _votes(kind, loose, segments, x).alias("votes"))


def _tagged(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["votes"].alias("votes"))


def _written(kind: str):
    return lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string"))


def _accepted(classifier: SpanClassifier, kind: str):
    return lambda x: classifier.column(kind, x["votes"]) >= 0


def _marked(kind: str):
    return lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("mark"))


def candidates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and, for each kind, its valid base matches and the looser ones beside them, with votes."""
    source = narrow(df, id=id_col, text=text_col).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    text, segments = F.col("text"), F.col("segments")
    source = source.withColumn("segments", _segments(text))
    for kind in KINDS:
        source = source.withColumn(f"base_{kind}", F.filter(_matches(text, BASE[kind], _gate(text, kind, False)), _valid_of(kind)))
    columns = {}
    for kind in KINDS:
        base = F.col(f"base_{kind}")
        loose = _let(_matches(text, LOOSE[kind], _gate(text, kind, True)), _apart_from(base))
        for name, spans, is_loose in ((f"base_{kind}", base, False), (f"loose_{kind}", loose, True)):
            columns[name] = F.transform(spans, _voted(kind, is_loose, segments))
    return source.select("id", "text", "segments", *[c.alias(n) for n, c in columns.items()])


@dataclass(frozen=True)
class SpanClassifier:
    """Logit of a candidate: bias + kind's weight + a weight for each labeler's vote. ``rates`` are the labelers' estimated reliabilities."""

    bias: float
    kinds: dict[str, float]
    weights: dict[tuple[int, str], float]
    rates: dict[tuple[str, int, bool], dict[str, float]]

    def logit(self, kind: str, votes: str) -> float:
        return self.bias + self.kinds[kind] + sum(self.weights[i, v] for i, v in enumerate(votes))

    def column(self, kind: str, votes: Column) -> Column:
        total = F.lit(self.bias + self.kinds[kind])
        for i in range(len(LABELERS)):
            vote = F.substring(votes, i + 1, 1)
            total = total + F.when(vote == "0", self.weights[i, "0"]).when(vote == "1", self.weights[i, "1"]).otherwise(self.weights[i, "2"])
        return total


def estimate(counts: dict[tuple[str, str], int], rounds: int = 30) -> tuple[dict[tuple[str, str], float], dict]:
    """Posteriors of (kind, votes) and labelers' reliabilities, by expectation maximisation from the majority vote."""
    posterior = {key: 1 / (1 + exp(-sum(int(v) - 1 for v in key[1]))) for key in counts}
    rates: dict = {}
    for _ in range(rounds):
        for kind in KINDS:
            own = {key: n for key, n in counts.items() if key[0] == kind}
            if not own:
                continue
            mass = {True: sum(n * posterior[k] for k, n in own.items()) + 1, False: sum(n * (1 - posterior[k]) for k, n in own.items()) + 1}
            for i in range(len(LABELERS)):
                for truth in (True, False):
                    prior = {"0": 0.2, "1": 0.4, "2": 1.4} if truth else {"0": 1.4, "1": 0.4, "2": 0.2}
                    seen = {v: prior[v] + sum(n * (posterior[k] if truth else 1 - posterior[k]) for k, n in own.items() if k[1][i] == v) for v in "012"}
                    rates[kind, i, truth] = {v: c / sum(seen.values()) for v, c in seen.items()}
            for key in own:
                odds = log(mass[True] / mass[False]) + sum(log(rates[kind, i, True][v] / rates[kind, i, False][v]) for i, v in enumerate(key[1]))
                posterior[key] = 1 / (1 + exp(-max(-30.0, min(30.0, odds))))
    return posterior, rates


def fit(counts: dict[tuple[str, str], int], steps: int = 400, rate: float = 1.0, decay: float = 1e-3) -> SpanClassifier:
    """The span classifier: weighted logistic regression on the posteriors of all patterns."""
    posterior, rates = estimate(counts)
    total = sum(counts.values()) or 1
    bias, kinds = 0.0, dict.fromkeys(KINDS, 0.0)
    weights = {(i, v): float(int(v) - 1) for i in range(len(LABELERS)) for v in "012"}
    keys = sorted(counts)
    for _ in range(steps):
        grad_bias, grad_kinds, grad = 0.0, dict.fromkeys(KINDS, 0.0), dict.fromkeys(weights, 0.0)
        for kind, votes in keys:
            z = bias + kinds[kind] + sum(weights[i, v] for i, v in enumerate(votes))
            g = counts[kind, votes] / total * (1 / (1 + exp(-max(-30.0, min(30.0, z)))) - posterior[kind, votes])
            grad_bias += g
            grad_kinds[kind] += g
            for i, v in enumerate(votes):
                grad[i, v] += g
        bias -= rate * grad_bias
        kinds = {k: w - rate * (grad_kinds[k] + decay * w) for k, w in kinds.items()}
        weights = {k: w - rate * (grad[k] + decay * w) for k, w in weights.items()}
    return SpanClassifier(bias, kinds, weights, rates)


def train(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> SpanClassifier:
    """Count the vote patterns of all candidates in all texts, and fit; at most 4 * 3 ** 5 rows reach the driver."""
    found = candidates(df, id_col, text_col)
    tagged = [F.transform(F.col(f"{part}_{kind}"), _tagged(kind)) for kind in KINDS for part in ("base", "loose")]
    votes = found.select(F.explode(F.concat(*tagged)).alias("c")).groupBy("c.kind", "c.votes").count()
    return fit({(r["kind"], r["votes"]): r["count"] for r in votes.collect()})


def _joined(df_columns: dict[str, Column]) -> Column:
    """kind:start:end of all spans, by kind as listed, then start."""
    tagged = [F.transform(F.array_sort(spans), _written(kind)) for kind, spans in df_columns.items()]
    return F.array_join(F.concat(*tagged), ",")


def find_spans(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", classifier: SpanClassifier | None = None) -> DataFrame:
    """id, text, n_<kind> and base (valid base matches), spans (base and accepted looser ones, kind -> array of start, end).

    Offsets are code points, ends exclusive. Null text is empty; a null id stays null; repeated rows are searched each;
    further columns are not read; an empty table gives an empty result. No shuffle beyond the count of vote patterns.
    """
    classifier = classifier or train(df, id_col=id_col, text_col=text_col)
    found = candidates(df, id_col, text_col)
    place = lambda spans: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    base = {k: place(F.col(f"base_{k}")) for k in KINDS}
    more = {k: place(F.filter(F.col(f"loose_{k}"), _accepted(classifier, k))) for k in KINDS}
    return found.select(
        F.col("id").alias(id_col),
        F.col("text").alias(text_col),
        *[F.size(f"base_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS],
        _joined(base).alias("base"),
        *[F.concat(base[k], more[k]).alias(f"spans_{k}") for k in KINDS],
    )


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of ``find_spans``: id, n_<kind>, base_sha256, spans as text."""
    spans = _joined({k: F.col(f"spans_{k}") for k in KINDS})
    return found.select(id_col, *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"))


def redacted(text: Column, spans: dict[str, Column]) -> Column:
    """The text with each run of overlapping spans replaced by the kind of its first span, as in [EMAIL]."""
    tagged = F.array_sort(F.concat(*[F.transform(c, _marked(k)) for k, c in spans.items()]))
    furthest = lambda end, x: F.greatest(end, x["end"])

    def place(x: Column, done: Column) -> Column:
        """A run begins where all spans before have ended; what lies between is kept."""
        return F.struct(x.alias("span"), done.alias("done"))

    def joined(xs: Column, segments: Column) -> Column:
        begun = F.filter(_scan(xs, F.lit(0), furthest, lambda a, b: F.greatest(a, b), place), lambda p: p["span"]["start"] >= p["done"])
        parts = F.transform(begun, lambda p: F.concat(_cut(segments, p["done"], p["span"]["start"] - p["done"]), p["span"]["mark"]))
        return _let(F.aggregate(xs, F.lit(0), furthest), lambda end: F.concat(F.array_join(parts, ""), _cut(segments, end, F.length(text) - end)))

    return _let(tagged, lambda xs: F.when(F.size(xs) > 0, _let(_segments(text), lambda segments: joined(xs, segments))).otherwise(text))


def redact(df: DataFrame, *, text_col: str = "text", classifier: SpanClassifier | None = None) -> DataFrame:
    """All rows and columns, with personal data in ``text_col`` replaced by its kind; null text stays null."""
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    found = find_spans(whole, id_col="row", text_col="text", classifier=classifier or train(whole, id_col="row", text_col="text"))
    clean = F.when(F.col("row").getField(text_col).isNotNull(), redacted(F.col("text"), {k: F.col(f"spans_{k}") for k in KINDS}))
    return found.select(*[clean.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns])
