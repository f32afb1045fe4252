"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are byte n-grams of lower-cased words with their boundaries, hashed into buckets. A text's vector is the
mean of its subwords' embeddings; embeddings and softmax are trained together by stochastic gradient descent in numpy
on the driver, over a bounded sample of labelled rows whose features (at most one count a bucket, however long the
text) are computed on the executors. Probabilities are calibrated by a temperature on a part of the sample that training
doesn't see. The same part sets two bounds of rejection at a named rate: on the probability, and on the share of
subwords of three bytes that are usual in the predicted language, which tells junk and texts of other languages however sure the softmax
is of them. Both are set for texts of which a stated part is words that nobody has learnt. As the softmax is linear,
each bucket's contribution to the logits is a fixed vector, so that prediction is one gather and sum over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import narrow, release, released

UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
ORDERS = (2, 3, 4)
JUDGED = 3  # the order that familiarity is told by: pairs of bytes occur in junk too, four are too rare
SEGMENT = 1 << 20
# every byte that is an ASCII letter or belongs to a longer UTF-8 sequence stays; others part words
PARTS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


@dataclass(frozen=True)
class Settings:
    """``sample`` labelled rows a language, chosen by a hash of their id, are learnt from: the one bound here.

    A subword is usual in a language if it makes up at least ``usual`` of its texts. ``reject_share``: the part of
    held-out texts that may be rejected for its subwords when ``unlearnt`` of each is words without one usual subword;
    ``unsure_share``: the same for the probability.
    """

    bits: int = 17
    dim: int = 16
    sample: int = 500
    epochs: int = 12
    rate: float = 8.0
    batch: int = 16
    calibration: float = 0.2
    reject_share: float = 0.01
    unsure_share: float = 0.001
    usual: float = 1e-4
    unlearnt: float = 0.6
    seed: int = 7


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    logits: np.ndarray  # bucket x language, for the mean over a text's subwords; bucket 0 is empty
    bias: np.ndarray
    threshold: float
    bits: int
    familiar: np.ndarray  # bucket x language: whether the subword is usual in the language
    floor: float  # the least share of usual ones in the judged order; 0: unknown, nothing is rejected for it

    @property
    def new(self) -> np.ndarray:
        """Whether a bucket is usual in no language."""
        found = ~self.familiar.any(axis=1)
        found[0] = False
        return found

    def strange(self, usual: int, asked: int) -> bool:
        """Whether too few are usual; one standard deviation of so many draws is allowed for, as short texts vary."""
        u = self.floor
        return asked > 0 and usual / asked < u - (u * (1 - u) / asked) ** 0.5


def judged(bucket: np.ndarray) -> np.ndarray:
    """Even buckets, but for the empty one, are those of the judged order."""
    return (bucket > 0) & (bucket % 2 == 0)


def buckets(text: bytes, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Orders and bucket numbers of all subwords (0: none here), by segments of long texts."""
    padded = b" " + text.translate(PARTS) + b" "
    for at in range(0, len(padded), SEGMENT):
        again = min(at, max(ORDERS) - 1)  # bytes of the segment before, in which no subword ends anew
        a = np.frombuffer(padded[at - again : at + SEGMENT], np.uint8).astype(np.uint32)
        letter = a != 32
        for n in ORDERS:
            m = len(a) - n + 1
            if m <= 0:
                continue
            key = a[:m].copy()
            for i in range(1, n):
                key = (key << np.uint32(8)) | a[i : i + m] if n <= 4 else key * np.uint32(257) + a[i : i + m]
            key = (key * np.uint32(0x9E3779B1)) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            key = ((key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(33 - bits)
            key = (key << np.uint32(1)) | np.uint32(n != JUDGED)
            valid = letter[1 : 1 + m] if n > 2 else letter[:m] | letter[1 : 1 + m]
            if n > 3:
                valid = valid & letter[2 : 2 + m]
            found = np.where(valid, np.where(key > 0, key, 2), 0)
            found[: max(0, again - n + 1)] = 0
            yield n, found


def features(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their counts over the whole text."""
    counts = np.zeros(1 << bits, np.int64)
    for _, found in buckets(text.lower().encode(errors="ignore"), bits):
        counts += np.bincount(found, minlength=1 << bits)
    counts[0] = 0
    ids = np.flatnonzero(counts)
    return ids, counts[ids]


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], settings: Settings) -> LanguageModel:
    """From (language, buckets, counts); the order of rows doesn't matter if they are sorted the same."""
    languages = tuple(sorted({r[0] for r in rows}))
    n, size = max(1, len(languages)), 1 << settings.bits
    rng = np.random.default_rng(settings.seed)
    order = rng.permutation(len(rows))
    held = set(order[: int(len(rows) * settings.calibration)].tolist())
    train = [i for i in range(len(rows)) if i not in held]
    data = [(languages.index(r[0]), r[1], (r[2] / max(1, r[2].sum())).astype(np.float32)) for r in rows]
    share = np.bincount([data[i][0] for i in train], minlength=n) if train else np.ones(n)
    weight = np.where(share, len(train) / np.maximum(share, 1) / n, 0)
    table = (rng.standard_normal((size, settings.dim)) / settings.dim).astype(np.float32)
    soft, bias = np.zeros((settings.dim, n), np.float32), np.zeros(n, np.float32)
    steps = max(1, settings.epochs * len(train) // settings.batch)
    for step in range(steps if n > 1 else 0):
        rate = settings.rate * (1 - step / steps)
        grad_soft, grad_bias, updates = np.zeros_like(soft), np.zeros_like(bias), []
        for i in rng.choice(train, settings.batch):
            y, ids, w = data[i]
            x = w @ table[ids]
            z = x @ soft + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= weight[y]
            grad_soft += np.outer(x, p)
            grad_bias += p
            updates.append((ids, w, soft @ p))
        for ids, w, g in updates:
            table[ids] -= rate / settings.batch * len(ids) ** 0.5 * w[:, None] * g
        soft -= rate / settings.batch * grad_soft
        bias -= 0.1 * rate / settings.batch * grad_bias
    logits = table @ soft
    scores = [(data[i][0], data[i][2] @ logits[data[i][1]] + bias) for i in sorted(held)]
    heat = _temperature(scores)
    learnt = 1 - settings.unlearnt
    best = [_softmax((learnt * (z - bias) + bias) / heat).max() for _, z in scores]  # unlearnt words add nothing
    # a quarter of the way from chance: a text of a word or two is far less sure than the least sure of the sample
    threshold = (float(np.quantile(best, settings.unsure_share)) + 3 / n) / 4 if best else 0.0
    spread = np.zeros((size, n))
    for i in train:
        spread[data[i][1], data[i][0]] += data[i][2]
    familiar = spread >= settings.usual * np.maximum(1, np.bincount([data[i][0] for i in train], minlength=n)) if train else spread > 0
    familiar[0] = False
    shares = []
    for i, (_, z) in zip(sorted(held), scores, strict=True):
        ids, w = data[i][1:]
        if total := float(w[judged(ids)].sum()):
            shares.append(float(w[judged(ids)] @ familiar[ids[judged(ids)], np.argmax(z)]) / total)
    floor = learnt * float(np.quantile(shares, settings.reject_share)) if shares else 0.0
    logits = (logits / heat).astype(np.float32)
    logits[0] = 0
    return LanguageModel(languages if rows else (), logits, (bias / heat).astype(np.float32), threshold, settings.bits, familiar, floor)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def _temperature(scores: list[tuple[int, np.ndarray]]) -> float:
    """The temperature with the least held-out log loss."""
    if not scores:
        return 1.0
    y, z = np.array([s[0] for s in scores]), np.stack([s[1] for s in scores]).astype(float)
    loss = {t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in np.geomspace(0.05, 20, 61)}
    return float(min(loss, key=loss.get))


def train(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> LanguageModel:
    """Learn from rows with text, letters and a language; without any, every prediction is undetermined.

    Repeated rows count each. About ``settings.sample`` rows of each language go to the driver, as bucket counts.
    """
    source = narrow(df, id=id_col, text=text_col, lang=lang_col).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = {r["lang"]: settings.sample / r["count"] for r in source.groupBy("lang").count().collect()}
    if not share:
        return fit([], settings)
    known = F.create_map(*[F.lit(x) for pair in sorted(share.items()) for x in pair])
    drawn = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(settings.seed)), F.lit(1 << 30)) / float(1 << 30)
    bits = settings.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                ids, counts = features(text.as_py(), bits)
                if len(ids):
                    yield pa.RecordBatch.from_pydict({"lang": [lang.as_py()], "ids": [ids.astype(np.int32)], "counts": [counts.astype(np.int32)]}, schema=pa.schema([("lang", pa.string()), ("ids", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]))

    sample = source.where(drawn < F.element_at(known, F.col("lang"))).select("lang", "text").mapInArrow(released(run), "lang string, ids array<int>, counts array<int>")
    rows = sample.limit(2 * settings.sample * len(share)).toArrow()
    found = [(r, np.array(i.values), np.array(c.values)) for r, i, c in zip(rows["lang"].to_pylist(), rows["ids"], rows["counts"], strict=True)]
    del rows
    found.sort(key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    model = fit(found, settings)
    del found
    release()  # the driver goes on to other work
    return model


def predict(model: LanguageModel, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray, list[bool]]:
    """Languages, calibrated probabilities (0 if undetermined), and whether the model rejects the text."""
    names, scores, rejected = [], np.zeros(len(texts)), []
    for i, text in enumerate(texts):
        if text is None or not model.languages or not LETTER.search(text):
            names.append(UNDETERMINED)
            rejected.append(True)
            continue
        total, count = np.zeros(len(model.languages)), 0
        usual, asked = np.zeros(len(model.languages), np.int64), 0
        for n, found in buckets(text.lower().encode(errors="ignore"), model.bits):
            total += model.logits[found].sum(axis=0, dtype=np.float64)
            count += np.count_nonzero(found)
            if n == JUDGED:
                usual += np.count_nonzero(model.familiar[found], axis=0)
                asked += np.count_nonzero(found)
        p = _softmax(total / max(1, count) + model.bias)
        best = int(p.argmax())
        names.append(model.languages[best])
        scores[i] = p[best]
        rejected.append(bool(p[best] < model.threshold or model.strange(usual[best], asked)))
    return names, scores, rejected


def language(model: LanguageModel, text: Column) -> Column:
    """struct(lang, score, rejected) of a text column. Null text or text without a letter: und, 0.0, rejected."""
    from pyspark.sql import SparkSession

    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)
    fields = [pa.field("lang", pa.string()), pa.field("score", pa.float64()), pa.field("rejected", pa.bool_())]

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def run(column: pa.Array) -> pa.Array:
        names, scores, rejected = [], np.zeros(len(column)), []
        for at in range(0, len(column), 256):  # only so many texts are Python strings at a time
            part = predict(shared.value, column.slice(at, 256).to_pylist())
            names += part[0]
            scores[at : at + 256] = part[1]
            rejected += part[2]
        release()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores), pa.array(rejected, pa.bool_())], fields=fields)

    return run(text.cast("string"))


def identify(df: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, rejected for each row, repeated ones and those with a null id too; no shuffle.

    Further columns are not read; an empty table gives an empty result.
    """
    named = narrow(df, id=id_col, text=text_col).select("id", language(model, F.col("text")).alias("p"))
    return named.select(F.col("id").alias(id_col), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))
