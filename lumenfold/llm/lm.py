"""Language-model scoring with a weighted backoff automaton.

States are contexts: pairs of tokens that training saw at least ``STATE_COUNT`` times, known words, the start of a text,
and the root. A state h has an arc for each n-gram (h, w) seen in training, with the weight log10 P(w | h), and a failure
arc to the state of h without its first token with the weight log10 alpha(h); the root has an arc for every word. One
traversal from left to right carries the state and adds up weights: while the state has no arc for the next token it
takes the failure arc, then the arc. An arc leads to the longest state that ends the text so far.

Smoothing. P(w) = (1 - u) c(w) / N for known words and u for the unknown, u being the share of training tokens seen
once (Good-Turing). P(w | h) = (1 - a) c(h, w) / c(h) + a P(w | h without its first token), where a is the same share of
n-grams of that length among contexts whose count is in the same power of two as c(h); so a seen arc weighs log10 of that
and a failure arc log10 a. These are proper distributions over V known tokens and the unknown one.

Counts cover all training texts. Texts are dealt into blocks by a hash; each block sends its distinct keys (hashes of
words, pairs and triples), counted, to buckets of the key space as sorted, delta-coded columns. A bucket sums up and
answers each block for just the keys it asked for, so that the model is never gathered or broadcast: a block gets the
part of the automaton that its texts can reach. It traverses its texts side by side, one token of each at a time; a long
text is cut into lanes, each of which begins two tokens early, as no state is longer than that.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import as_bytes, blocks_for, narrow, release, text_bytes
from lumenfold.llm.wordhash import codes, mix, word_hashes

START, END, UNIGRAM, LEFT, RIGHT, THIRD = (np.uint64(x) for x in codes(6, 3))
CLASSES = 64
STATE_COUNT = 2
LANE = 4096
# n-grams of two and three words are known by so many bits: 1e13 of them would share a key in 0.2 % of cases
WORD_BITS, GRAM_BITS = 64, 52
BLOCK_BYTES, BUCKET_BYTES, ROW_BYTES = 8 << 20, 16 << 20, 8 << 10


# --- the automaton itself, built from counts -------------------------------------------------------------------------


@dataclass
class Smoothing:
    """Totals of the training tokens; ``ones`` and ``total`` are of pairs and triples by the power of two of their context's count."""

    tokens: int = 0
    types: int = 0
    singles: int = 0
    ones: dict[int, np.ndarray] = field(default_factory=lambda: {n: np.zeros(CLASSES) for n in (2, 3)})
    total: dict[int, np.ndarray] = field(default_factory=lambda: {n: np.zeros(CLASSES) for n in (2, 3)})

    @property
    def unknown(self) -> float:
        return min(0.5, max(self.singles, 0.5) / (self.tokens + 1))

    def alpha(self, order: int, context_counts: np.ndarray) -> np.ndarray:
        """The failure mass of states with these counts whose arcs are n-grams of ``order``; 1 where a context is unknown."""
        share = np.clip((self.ones[order] + 0.5) / (self.total[order] + 1), 0.01, 0.99)
        return np.where(context_counts > 0, share[count_class(context_counts)], 1.0)


def count_class(counts: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum(counts, 1).astype(np.float64))[1] - 1


class BackoffAutomaton:
    """Explicit states and arcs over Python tokens, for a model that fits in memory. States are tuples of tokens."""

    def __init__(self, texts: list[list[str]]):
        self.words, pairs, triples = Counter(), Counter(), Counter()
        for words in texts:
            run = [None, *words, ""]  # None: the start, "": the end
            self.words.update(run[1:])
            pairs.update(zip(run, run[1:], strict=False))
            triples.update(zip(run, run[1:], run[2:], strict=False))
        counts = {(w,): c for w, c in self.words.items()} | dict(pairs)
        contexts = {h: c for h, c in counts.items() if h[-1] != "" and (len(h) == 1 or c >= STATE_COUNT)}
        if texts:
            contexts[None,] = len(texts)
        grams = {g: c for g, c in [*pairs.items(), *triples.items()] if g[:-1] in contexts}
        self.smoothing = s = Smoothing(sum(self.words.values()), len(self.words), sum(c == 1 for c in self.words.values()))
        for g, c in grams.items():
            k = int(count_class(np.array(contexts[g[:-1]])))
            s.ones[len(g)][k] += c == 1
            s.total[len(g)][k] += c
        self.fail = {h: float(s.alpha(len(h) + 1, np.array(c))) for h, c in contexts.items()}
        self.arcs = {(w,): (1 - s.unknown) * c / s.tokens for w, c in self.words.items()}
        for g, c in sorted(grams.items(), key=lambda item: len(item[0])):
            h = g[:-1]
            self.arcs[g] = (1 - self.fail[h]) * c / contexts[h] + self.fail[h] * self.arcs[g[1:]]

    def step(self, state: tuple, word: str) -> tuple[float, tuple]:
        """The weight of reading ``word``, and the next state."""
        weight = 0.0
        while state and (*state, word) not in self.arcs:
            weight += log10(self.fail.get(state, 1.0))
            state = state[1:]
        weight += log10(self.arcs.get((*state, word), self.smoothing.unknown))
        after = (*state, word)[-2:]
        while after and after not in self.fail:
            after = after[1:]
        return weight, after

    def score(self, words: list[str]) -> float:
        state, total = (None,), 0.0
        for w in [*words, ""]:
            weight, state = self.step(state, w)
            total += weight
        return total


# --- columns of sorted keys -----------------------------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Byte planes of unsigned numbers, which Spark's block compression makes short."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unpack(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def bucket_bounds(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each bucket of the key space begins among sorted keys."""
    edges = np.array([-(-(b << bits) // buckets) for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


# --- blocks and buckets -----------------------------------------------------------------------------------------------


class Block:
    """A block's tokens: distinct words, pairs and triples, and where each position's are among them."""

    def __init__(self, table: pa.Table):
        texts = as_bytes(table["text"].combine_chunks())
        hashes, ptr = word_hashes(texts)
        n = len(texts)
        del texts
        self.first = ptr[:-1] + np.arange(n)  # of each text, among tokens with ends
        self.size = np.diff(ptr) + 1
        tokens = np.empty(len(hashes) + n, np.uint64)
        ends = self.first + self.size - 1
        body = np.ones(len(tokens), bool)
        body[ends] = False
        tokens[body], tokens[ends] = hashes, END
        self.words, at = np.unique(tokens, return_inverse=True)
        self.word_at = at.astype(np.int32)
        held = np.asarray(table["held"].combine_chunks().to_numpy(zero_copy_only=False), bool)
        self.train = np.repeat(~held, self.size)

    def _follow(self, at: np.ndarray) -> np.ndarray:
        """At each position, what ``at`` has one position before; of no meaning at a text's first."""
        return np.roll(at, 1)

    @property
    def contexts(self) -> np.ndarray:
        """The word before each position. Starts are counted by ends."""
        at = self._follow(self.word_at)
        at[self.first] = np.searchsorted(self.words, END)
        return at

    def find_pairs(self) -> None:
        before = self.words[self._follow(self.word_at)]
        before[self.first] = START
        key = mix(before * LEFT + self.words[self.word_at] * RIGHT) >> np.uint64(64 - GRAM_BITS)
        del before
        self.pairs, at = np.unique(key, return_inverse=True)
        self.pair_at = at.astype(np.int32)

    def find_triples(self, pair_counts: np.ndarray) -> None:
        """Triples whose first two tokens are a state; ``triple_at`` is -1 elsewhere."""
        before = self._follow(self.pair_at)
        follows = pair_counts[before] >= STATE_COUNT
        follows[self.first] = False
        self.triple_places = np.flatnonzero(follows)
        before = before[self.triple_places]
        key = mix(self.pairs[before] * THIRD + self.words[self.word_at[self.triple_places]] * RIGHT) >> np.uint64(64 - GRAM_BITS)
        self.triples, at = np.unique(key, return_inverse=True)
        self.triple_at = np.full(len(self.word_at), -1, np.int32)
        self.triple_at[self.triple_places] = at
        self.triple_context = np.empty(len(self.triples), np.int32)  # the pair that a triple begins with
        self.triple_context[at] = before
        self.triple_suffix = np.empty(len(self.triples), np.int32)  # the pair that it ends with
        self.triple_suffix[at] = self.pair_at[self.triple_places]

    def counted(self, at: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(at[self.train & (at >= 0)], minlength=n).astype(np.uint32)


@dataclass
class Arcs:
    """The part of the automaton that a block's texts can reach.

    States: one for each word, then the start, the root, and one for each pair. ``weights`` and ``targets`` of arcs are
    by word (from the root), pair (from a word or the start) and triple (from a pair); NaN where there is no arc.
    """

    words: int
    fail_weight: np.ndarray
    fail_state: np.ndarray
    weights: tuple[np.ndarray, np.ndarray, np.ndarray]
    word_target: np.ndarray
    pair_target: np.ndarray

    @staticmethod
    def of(own: Block, model: Smoothing, c: np.ndarray, hw: np.ndarray, uvw: np.ndarray) -> Arcs:
        """From a block's words, pairs and triples and their counts."""
        n, start, root = len(own.words), len(own.words), len(own.words) + 1
        context, last = np.empty(len(own.pairs), np.int32), np.empty(len(own.pairs), np.int32)
        context[own.pair_at], last[own.pair_at] = own.contexts, own.word_at
        h = c[context]
        unigram = np.where(c > 0, (1 - model.unknown) * c / max(model.tokens, 1), model.unknown)
        fail2 = model.alpha(2, h)
        pair = np.where(hw > 0, (1 - fail2) * hw / np.maximum(h, 1), 0) + fail2 * unigram[last]
        uv = hw[own.triple_context]
        fail3 = model.alpha(3, uv)
        triple = (1 - fail3) * uvw / np.maximum(uv, 1) + fail3 * pair[own.triple_suffix]
        starts = c[np.searchsorted(own.words, END)] if n else 0
        fail = np.concatenate([model.alpha(2, c), model.alpha(2, np.array([starts])), [1.0], model.alpha(3, hw)])
        to = np.concatenate([np.full(n + 2, root), last]).astype(np.int32)
        arc = lambda p, seen: np.where(seen > 0, np.log10(p), np.nan)
        word_target = np.where(c > 0, np.arange(n), root).astype(np.int32)
        pair_target = np.where(hw >= STATE_COUNT, root + 1 + np.arange(len(hw)), word_target[last]).astype(np.int32)
        return Arcs(n, np.log10(fail), to, (np.log10(unigram), arc(pair, hw), arc(triple, uvw)), word_target, pair_target)

    def traverse(self, own: Block) -> np.ndarray:
        """The log10 probability of each text."""
        lanes = -(-own.size // LANE)
        text = np.repeat(np.arange(len(own.size)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        early = np.where(nth > 0, 2, 0)
        at = own.first[text] + nth * LANE - early
        length = np.minimum(own.size[text] - nth * LANE, LANE) + early
        order = np.argsort(-length, kind="stable")
        text, nth, early, at, length = (x[order] for x in (text, nth, early, at, length))
        start, root = self.words, self.words + 1
        state, total = np.where(nth > 0, root, start).astype(np.int32), np.zeros(len(text))
        running = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")  # lanes longer than t
        w1, w2, w3 = self.weights
        w3 = np.append(w3, np.nan)  # what -1 finds
        for t, k in enumerate(running.tolist()):
            p, s = at[:k] + t, state[:k]
            word, pair = own.word_at[p], own.pair_at[p]
            weight = np.where(s > root, w3[own.triple_at[p]], np.nan)
            failed = np.isnan(weight) & (s > root)
            passed = np.where(failed, self.fail_weight[s], 0.0)
            s = np.where(failed, self.fail_state[s], s)
            weight = np.where(s < root, w2[pair], weight)
            failed = np.isnan(weight)
            passed += np.where(failed, self.fail_weight[s], 0.0)  # the root's is 0
            weight = np.where(failed, w1[word], weight)
            state[:k] = np.where(failed, self.word_target[word], self.pair_target[pair])
            total[:k] += np.where(t >= early[:k], weight + passed, 0.0)
        return np.bincount(text, weights=total, minlength=len(own.size))


BLOBS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("classes", pa.binary())])
ANSWERS = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("order", pa.int32()), ("counts", pa.binary()), ("stats", pa.list_(pa.float64()))])
BLOBS_SQL = "bucket int, block int, keys binary, counts binary, classes binary"
ANSWERS_SQL = "block int, bucket int, order int, counts binary, stats array<double>"


def _blobs(block: int, keys: np.ndarray, counts: np.ndarray, classes: np.ndarray | None, buckets: int) -> pa.Table:
    at = bucket_bounds(keys, buckets, WORD_BITS if classes is None else GRAM_BITS)
    rows = [{"bucket": b, "block": block, "keys": pack_keys(keys[i:j]), "counts": pack(counts[i:j]), "classes": classes[i:j].tobytes() if classes is not None else b""} for b, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True))]
    return pa.Table.from_pylist(rows, BLOBS)


def _merge(order: int):
    """Sums of a bucket's keys, sent back to each block in the order of its keys, with the bucket's share of totals."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["bucket", "block"]).to_pylist()
        keys = [unpack_keys(x.as_py()) for x in table["keys"]]
        counts = np.concatenate([unpack(x.as_py(), np.uint32) for x in table["counts"]])
        ends = np.cumsum([len(k) for k in keys])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(at, weights=counts, minlength=len(distinct))
        del keys
        if order == 1:
            stats = [sums.sum(), float((sums > 0).sum()), float((sums == 1).sum())]
        else:
            classes = np.zeros(len(distinct), np.uint8)
            classes[at] = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table["classes"]])
            stats = [*np.bincount(classes, weights=sums == 1, minlength=CLASSES), *np.bincount(classes, weights=sums, minlength=CLASSES)]
        answer = sums.astype(np.uint64)[at]
        out = pa.Table.from_pylist([r | {"order": order, "counts": pack(part), "stats": stats} for r, part in zip(rows, np.split(answer, ends[:-1]), strict=True)], ANSWERS)
        del answer, at, sums, distinct
        release()
        return out

    return run


def _answer(table: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's sums in the order of its keys, and the stats of all buckets added up."""
    rows = sorted((r for r in table.select(["bucket", "order", "counts", "stats"]).to_pylist() if r["order"] == order), key=lambda r: r["bucket"])
    return np.concatenate([unpack(r["counts"], np.uint64) for r in rows]).astype(np.float64), np.sum([r["stats"] for r in rows], axis=0)


def score_texts(df: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    The model learns from rows where ``held_out`` is false; null there counts as false. Tokens: runs of bytes other
    than space and \\x09-\\x0D with A-Z lower-cased, then one end. base_score is the sum of log10((c + 0.1) /
    (N + 0.1 (V + 1))). Null text is empty: its end is scored. A null id stays null; repeated rows are counted and
    scored each; further columns are not read; an empty table gives an empty result. If nothing is learnt from, every
    token is unknown and scores log10(0.5). A task holds one block or bucket: 8 and 16 MB of text, and from some 8 GB
    of text on as much as keeps a block's column for a bucket at 8 KB.
    """
    source = narrow(df.withColumn("__held", F.coalesce(held_out, F.lit(False))), id=id_col, text=text_col, held="__held")
    total = text_bytes(source, "text")
    each = max(BLOCK_BYTES, int((total * ROW_BYTES) ** 0.5))
    blocks, buckets = blocks_for(total, each), blocks_for(total, max(BUCKET_BYTES, each))
    kind = source.schema["id"].dataType.simpleString()
    dealt = source.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")).repartition("block")

    def count_words(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = Block(table)
        out = _blobs(key[0].as_py(), own.words, own.counted(own.word_at, len(own.words)), None, buckets)
        del own
        release()
        return out

    def count_pairs(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        own = Block(table)
        own.find_pairs()
        sums, _ = _answer(answers, 1)
        classes = np.zeros(len(own.pairs), np.uint8)
        classes[own.pair_at] = count_class(sums)[own.contexts]
        out = _blobs(key[0].as_py(), own.pairs, own.counted(own.pair_at, len(own.pairs)), classes, buckets)
        del own, sums, classes
        release()
        return out

    def count_triples(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        own = Block(table)
        own.find_pairs()
        sums, _ = _answer(answers, 2)
        own.find_triples(sums)
        classes = count_class(sums[own.triple_context]).astype(np.uint8)
        out = _blobs(key[0].as_py(), own.triples, own.counted(own.triple_at, len(own.triples)), classes, buckets)
        del own, sums, classes
        release()
        return out

    def traverse(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        own = Block(table)
        own.find_pairs()
        words, (tokens, types, singles) = _answer(answers, 1)
        pairs, pair_stats = _answer(answers, 2)
        triples, triple_stats = _answer(answers, 3)
        own.find_triples(pairs)
        halves = {2: pair_stats, 3: triple_stats}
        model = Smoothing(int(tokens), int(types), int(singles), {n: x[:CLASSES] for n, x in halves.items()}, {n: x[CLASSES:] for n, x in halves.items()})
        base = np.log10((words + 0.1) / (tokens + 0.1 * (types + 1)))[own.word_at]
        columns = {
            "id": table["id"],
            "held_out": table["held"],
            "n_tokens": pa.array(own.size, pa.int64()),
            "n_known": pa.array(np.add.reduceat((words > 0)[own.word_at].astype(np.int64), own.first)),
            "train_tokens": pa.array(np.full(len(own.size), int(tokens))),
            "base_score": pa.array(np.add.reduceat(base, own.first)),
            "score": pa.array(Arcs.of(own, model, words, pairs, triples).traverse(own)),
        }
        del own, words, pairs, triples, base
        release()
        return pa.table(columns)

    by_block = lambda df: df.groupBy("block")
    # answers lie by block, so that their union does too, and a block's words and pairs are shuffled once for both their uses
    summed = lambda blobs, order: blobs.groupBy("bucket").applyInArrow(_merge(order), ANSWERS_SQL).repartition("block")
    words = summed(by_block(dealt).applyInArrow(count_words, BLOBS_SQL), 1)
    pairs = summed(by_block(dealt).cogroup(by_block(words)).applyInArrow(count_pairs, BLOBS_SQL), 2)
    triples = summed(by_block(dealt).cogroup(by_block(pairs)).applyInArrow(count_triples, BLOBS_SQL), 3)
    answers = words.unionByName(pairs).unionByName(triples)
    scored = by_block(dealt).cogroup(by_block(answers)).applyInArrow(traverse, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return scored.withColumnRenamed("id", id_col)
