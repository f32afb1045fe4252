"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask of word positions: the hash covers five words of a window and ignores the others, so substituted
words at ignored positions don't matter. Every position of every item and text is hashed under each mask; equal
hashes place an item against a text at an offset. Around such a hit the words of both are compared one by one: the
item leaks if, in some window of ``window`` aligned words (all of a shorter item), at least ``percent`` of them are
equal. The masks hit every window of 12 or 13 words with any two words substituted; shorter items have masks of their own
that hit them under any substitutions that 80 % allows, and texts are hashed under those only if there are such items.

Texts are scanned once. A bitmap of the items' hashes, of a size fixed by ``bits``, lets only texts with a hit leave
their task; hits, items and the blocks of text words around the hits then meet in joins, so neither side has to fit
anywhere and no text is moved as a whole with each of its hits. Should a benchmark be so large that the bitmap fills up,
more texts are joined, with the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import Workspace, bounded, narrow, released
from lumenfold.llm.normalise import plain
from lumenfold.llm.wordhash import codes, mix, word_hashes

# Together these masks hit every 13-word window with at most two substitutions (see the tests).
MASKS = ((0, 1, 2, 6, 7), (0, 1, 3, 5, 6), (0, 3, 5, 6, 7))
# Masks of shorter items, and the numbers of words for which each is needed: as many substitutions as 80 % allows leave
# three words in a row in items of 6 to 11 words and none in items under 5.
SHORT = (((0, 1, 2), range(3, 12)), ((0, 1, 3, 4), range(5, 6)), ((0, 1), range(2, 3)), ((0,), range(1, 2)))
# Of an item of one or two words every place with its seed is as good; the first in a text is the one to report.
FIRST_ONLY = ((0, 1), (0,))


@dataclass(frozen=True)
class Settings:
    window: int = 13
    percent: int = 80
    bits: int = 25
    block: int = 256
    masks: tuple[tuple[int, ...], ...] = MASKS


def seeds(hashes: np.ndarray, ptr: np.ndarray, masks: list[tuple[int, tuple[int, ...]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each numbered mask: seed hashes at all positions of a batch, and which of them lie within one text."""
    owner = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    for number, mask in masks:
        span = mask[-1]
        n = max(0, len(hashes) - span)
        factor = codes(len(mask) + 1, 10 + number)
        key = np.full(n, factor[-1], np.uint64)
        for f, offset in zip(factor, mask, strict=False):
            key += hashes[offset : offset + n] * f
        yield mix(key), owner[:n] == owner[span : span + n]


def _slots(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (key >> np.uint64(64 - bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)


def _item_seeds(items: DataFrame, s: Settings) -> DataFrame:
    """item, passage (128 bits that stand for its words), words and its seeds with their positions; items without words have none."""
    numbered = list(enumerate([*s.masks, *(mask for mask, _ in SHORT)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 1 << 20):
            hashes, ptr = word_hashes([plain(t) for t in batch.column("text").to_pylist()])
            found: list[tuple[list, list]] = [([], []) for _ in range(batch.num_rows)]
            owner = np.repeat(np.arange(batch.num_rows), np.diff(ptr))
            length = np.diff(ptr)[owner]
            for number, (key, within) in enumerate(seeds(hashes, ptr, numbered)):
                if number >= len(s.masks):
                    within = within & np.isin(length[: len(within)], SHORT[number - len(s.masks)][1])
                for at in np.flatnonzero(within):
                    keys, places = found[owner[at]]
                    keys.append(key[at])
                    places.append(int(at - ptr[owner[at]]))
            signed = hashes.view(np.int64)
            words = [signed[a:b] for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
            names = [hashlib.blake2b(w.tobytes(), digest_size=16).digest() for w in words]
            columns = [batch.column("item"), pa.array(names, pa.binary()), pa.array(words, pa.list_(pa.int64())), pa.array([np.array(k, np.uint64).view(np.int64) for k, _ in found], pa.list_(pa.int64())), pa.array([p for _, p in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "passage", "words", "seed", "place"])

    kind = items.schema["item"].dataType.simpleString()
    return items.mapInArrow(released(run), f"item {kind}, passage binary, words array<bigint>, seed array<bigint>, place array<int>")


def _bitmap(found: DataFrame, bits: int) -> np.ndarray:
    """Both slots of every seed, as 64-bit words; at most 2 ** (bits - 6) rows reach the driver."""
    key = F.explode("seed").alias("key")
    slots = found.select(key).select(F.explode(F.array(F.shiftrightunsigned("key", 64 - bits), F.col("key").bitwiseAND((1 << bits) - 1))).alias("slot"))
    rows = slots.select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[rows["word"].to_numpy()] = rows["bit"].to_numpy()
    return bitmap


def find_leaks(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """A row for each text and item that leaks into it: id, item, start_word, n_words, matched, similarity.

    Words are lower-cased, ASCII punctuation is white space. start_word is the first word of the text in the windows
    that pass, n_words how many words those span, matched how many of them are equal, similarity their share; of
    several placements the one with the most matched words is given, then the first. Null and empty texts and items
    have no leak; an item of one word leaks into every text with that word. Rows of either table that share an id, and
    those whose id is null, are searched each and reported once for each pair of ids, by the same rule; equal items
    are searched once and reported under each of their ids. Further columns are not read; if either table is empty, so
    is the result.
    """
    s, space = settings, Workspace(df.sparkSession, "leaks")
    items = space.save(_item_seeds(narrow(benchmark, item=item_col, text=item_text_col).distinct(), s), "items")
    passages = items.where(F.size("seed") > 0).groupBy("passage").agg(*[F.first(c).alias(c) for c in ("words", "seed", "place")])
    passages = space.save(passages, "passages")
    shared = df.sparkSession.sparkContext.broadcast(_bitmap(passages, s.bits))
    sizes = {r["n"] for r in passages.select(F.size("words").alias("n")).where(F.col("n") < max(r.stop for _, r in SHORT)).distinct().collect()}
    masks = [*enumerate(s.masks), *((len(s.masks) + n, mask) for n, (mask, needed) in enumerate(SHORT) if sizes & set(needed))]
    source = narrow(df, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, row = shared.value, TaskContext.get().partitionId() << 40
        for batch in bounded(batches, "text"):
            hashes, ptr = word_hashes([plain(t) for t in batch.column("text").to_pylist()])
            keys, places = [], []
            for (_, mask), (key, within) in zip(masks, seeds(hashes, ptr, masks), strict=True):
                first, second = _slots(key, s.bits)
                at = np.flatnonzero((bitmap[first >> 6] >> (first & 63)) & 1 & within)
                at = at[((bitmap[second[at] >> 6] >> (second[at] & 63)) & 1).astype(bool)]
                if mask in FIRST_ONLY and len(at):
                    text = np.searchsorted(ptr, at, side="right")
                    order = np.lexsort([at, key[at], text])
                    again = (text[order][1:] == text[order][:-1]) & (key[at[order]][1:] == key[at[order]][:-1])
                    at = np.sort(at[order[np.append(True, ~again)]])
                keys.append(key[at])
                places.append(at)
            keys, places = np.concatenate(keys).view(np.int64), np.concatenate(places)
            order = np.argsort(places, kind="stable")
            keys, places = keys[order], places[order]
            cut, signed = np.searchsorted(places, ptr), hashes.view(np.int64)
            hit = np.flatnonzero(np.diff(cut))
            columns = [
                pa.array(row + hit),
                batch.column("id").take(pa.array(hit)),
                pa.array([signed[ptr[i] : ptr[i + 1]] for i in hit], pa.list_(pa.int64())),
                pa.array([keys[cut[i] : cut[i + 1]] for i in hit], pa.list_(pa.int64())),
                pa.array([(places[cut[i] : cut[i + 1]] - ptr[i]).astype(np.int32) for i in hit], pa.list_(pa.int32())),
            ]
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "words", "seed", "place"])

    scanned = space.save(source.mapInArrow(released(scan), f"row bigint, id {kind}, words array<bigint>, seed array<bigint>, place array<int>"), "scanned")
    spread = lambda frame, *keep: frame.select(*keep, F.explode(F.arrays_zip("seed", "place")).alias("at")).select(*keep, F.col("at.seed").alias("seed"), F.col("at.place").alias("place"))
    hits = spread(scanned, "row").join(spread(passages, "passage").withColumnRenamed("place", "from"), "seed")
    placed = hits.select("row", "passage", (F.col("place") - F.col("from")).alias("offset")).distinct()
    side = passages.select("passage", F.col("words").alias("item_words"))
    # each placement asks for the blocks of words that the item covers, and gets its stretch of the text put together
    span = placed.join(passages.select("passage", F.size("words").alias("n")), "passage")
    asked = span.select("row", "passage", "offset", "n", F.explode(F.expr(f"sequence(greatest(offset, 0) div {s.block}, greatest(offset + n - 1, 0) div {s.block})")).alias("block"))
    blocks = scanned.select("row", F.posexplode(F.expr(f"transform(sequence(0, (size(words) - 1) div {s.block}), b -> slice(words, cast(b * {s.block} + 1 as int), {s.block}))")).alias("block", "part"))
    parts = asked.withColumn("block", F.col("block").cast("int")).join(blocks, ["row", "block"]).groupBy("row", "passage", "offset", "n").agg(F.sort_array(F.collect_list(F.struct("block", "part"))).alias("parts"))
    stretch = F.expr(f"slice(flatten(parts.part), cast(greatest(offset, 0) - parts[0].block * {s.block} + 1 as int), n + least(offset, 0))")
    both = parts.select("row", "passage", "offset", stretch.alias("words")).join(side, "passage").join(scanned.select("row", "id"), "row")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for offset, item, text in zip(batch.column("offset").to_pylist(), batch.column("item_words"), batch.column("words"), strict=True):
                found = _overlap(np.asarray(item.values), np.asarray(text.values), min(offset, 0), s)
                rows.append((found[0] + max(offset, 0), *found[1:]) if found else None)
            keep = pa.array([r is not None for r in rows], pa.bool_())
            numbers = np.array([r for r in rows if r is not None], np.int64).reshape(-1, 3)
            kept = batch.filter(keep)
            yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("passage"), *[pa.array(numbers[:, i]) for i in range(3)]], names=["id", "passage", "start_word", "n_words", "matched"])

    compared = both.select("id", "passage", "offset", "item_words", "words").mapInArrow(released(compare), f"id {kind}, passage binary, start_word bigint, n_words bigint, matched bigint")
    best = compared.groupBy("id", "passage").agg(F.max(F.struct("matched", (-F.col("start_word")).alias("from"), "n_words")).alias("best"))
    out = best.join(items.select("item", "passage").distinct(), "passage").groupBy("id", "item").agg(F.max("best").alias("best"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_col),
        (-F.col("best.from")).alias("start_word"),
        F.col("best.n_words").alias("n_words"),
        F.col("best.matched").alias("matched"),
        (F.col("best.matched") / F.col("best.n_words")).alias("similarity"),
    )


def _overlap(item: np.ndarray, text: np.ndarray, offset: int, s: Settings) -> tuple[int, int, int] | None:
    """(first word in the text, words, equal words) of the windows that pass, for item[0] placed at text[offset]."""
    low, high = max(0, offset), min(len(text), offset + len(item))
    width = min(s.window, len(item))
    if high - low < width:
        return None
    equal = text[low:high] == item[low - offset : high - offset]
    sums = np.concatenate([[0], np.cumsum(equal)])
    passing = np.flatnonzero(100 * (sums[width:] - sums[:-width]) >= s.percent * width)
    if not len(passing):
        return None
    start, end = int(passing[0]), int(passing[-1]) + width
    return low + start, end - start, int(sums[end] - sums[start])
