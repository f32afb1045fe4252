"""Vector bin packing of examples into training sequences.

An example takes a vector of a sequence's capacity: tokens, segments (one a piece) and loss-bearing tokens. The
dot-product heuristic fills one sequence after another: of the pieces that still fit in all three dimensions it
places the one whose demand has the largest weighted dot product with the capacity left. Examples longer than a
sequence are cut at multiples of its length first.

Packing needs no shuffle: each task packs what it reads, in windows of pieces; badly filled sequences of a window
are opened again in the next one, so at most a few badly filled ones remain for each task.
"""

from __future__ import annotations

import os
import string
import struct
import threading
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import KEPT, bounded, narrow, released

PIECES = "id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, loss_tokens bigint, sequence_id bigint, segment int, `offset` bigint, input_ids array<int>, loss_mask array<boolean>"


@dataclass(frozen=True)
class Limits:
    """Capacity of a sequence. ``window`` pieces are packed at a time; sequences filled less than ``reopen`` go on."""

    tokens: int = 4096
    segments: int = 256
    loss_tokens: int = 4096
    window: int = 4096
    reopen: float = 0.98


def dot_product_bins(demand: np.ndarray, capacity: np.ndarray) -> list[list[int]]:
    """Bins of row numbers of ``demand`` (n x d, each row within capacity), filled one at a time."""
    scaled = demand / capacity
    weight = scaled.mean(axis=0) if len(scaled) else np.ones(len(capacity))
    order = np.lexsort((np.arange(len(scaled)), -scaled[:, 0])) if len(scaled) else np.empty(0, np.int64)
    left_rows, bins = order, []
    while len(left_rows):
        left, chosen = np.ones(scaled.shape[1]), []
        rows, open_ = left_rows, scaled[left_rows].T.copy()
        taken = np.zeros(len(scaled), bool)
        while True:
            keep = (open_ <= left[:, None] + 1e-12).all(axis=0) & ~taken[rows]
            rows, open_ = rows[keep], open_[:, keep]
            if not len(rows):
                break
            best = rows[int(np.argmax((weight * left) @ open_))]
            chosen.append(int(best))
            taken[best] = True
            left = left - scaled[best]
        bins.append(chosen)
        left_rows = left_rows[~taken[left_rows]]
    return bins


@dataclass
class Piece:
    owner: object
    start: int
    length: int
    crc: int
    doc_tokens: int
    loss: int
    ids: bytes | None = None
    mask: bytes | None = None


class Packer:
    """Packs a stream of pieces; yields (sequence number, pieces in order)."""

    def __init__(self, limits: Limits):
        self.limits, self.held, self.next = limits, [], 0
        self.capacity = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)

    def _close(self, pieces: list[Piece]) -> tuple[int, list[Piece]]:
        self.next += 1
        return self.next - 1, pieces

    def add(self, piece: Piece) -> Iterator[tuple[int, list[Piece]]]:
        if piece.length == self.limits.tokens:
            yield self._close([piece])
            return
        self.held.append(piece)
        if len(self.held) >= self.limits.window:
            yield from self.flush(final=False)

    def flush(self, final: bool) -> Iterator[tuple[int, list[Piece]]]:
        demand = np.array([(p.length, 1, p.loss) for p in self.held], float).reshape(-1, 3)
        again: list[Piece] = []
        for chosen in dot_product_bins(demand, self.capacity):
            pieces = [self.held[i] for i in chosen]
            full = max(demand[chosen].sum(axis=0) / self.capacity)
            if final or full >= self.limits.reopen or len(again) + len(pieces) > self.limits.window // 2:
                yield self._close(pieces)
            else:
                again += pieces
        self.held = again


def cut(owner, ids: bytes, limits: Limits, mask: bytes | None, keep: bool) -> Iterator[Piece]:
    """An example's pieces: runs of at most a sequence's tokens and loss-bearing tokens. ids: little-endian uint32."""
    total, start, step = len(ids) // 4, 0, min(limits.tokens, limits.loss_tokens) if mask is None else limits.tokens
    while start < total:
        n = min(step, total - start)
        loss = n if mask is None else sum(mask[start : start + n])
        while loss > limits.loss_tokens:  # halve until it fits; a single token always does
            n = max(1, n // 2)
            loss = sum(mask[start : start + n])
        part = ids[4 * start : 4 * (start + n)]
        yield Piece(owner, start, n, zlib.crc32(part), total, loss, part if keep else None, mask[start : start + n] if keep and mask is not None else None)
        start += n


def _pack(examples: Iterable[tuple[object, bytes, bytes | None]], limits: Limits, kind: pa.DataType, keep: bool) -> Iterator[pa.RecordBatch]:
    """Record batches of PIECES from (owner, ids, loss mask) in any order."""
    task = TaskContext.get()
    first = (task.partitionId() if task else 0) << 40
    packer, rows = Packer(limits), []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(11)]
        types = [kind, *[pa.int64()] * 6, pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.bool_())]
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "segment", "offset", "input_ids", "loss_mask"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def lay(sequence: int, pieces: list[Piece]) -> None:
        offset = 0
        for segment, p in enumerate(pieces):
            ids = np.frombuffer(p.ids, "<u4").astype(np.int32) if keep else None
            mask = (np.frombuffer(p.mask, np.uint8).astype(bool) if p.mask is not None else np.ones(p.length, bool)) if keep else None
            rows.append((p.owner, p.start, p.length, p.crc, p.doc_tokens, p.loss, first + sequence, segment, offset, ids, mask))
            offset += p.length

    for owner, ids, mask in examples:
        for piece in cut(owner, ids, limits, mask, keep):
            for sequence, pieces in packer.add(piece):
                lay(sequence, pieces)
        if len(rows) >= (256 if keep else 8192):
            yield batch()
            rows.clear()
    for sequence, pieces in packer.flush(final=True):
        lay(sequence, pieces)
    yield batch()


# The vocabulary file's pre-tokenizer pattern and the byte-level alphabet's printable ranges.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRINTABLE = ((33, 126), (161, 172), (174, 255))


def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's character for each byte: itself if printable, else the next one from 256 on."""
    keep = {b for low, high in PRINTABLE for b in range(low, high + 1)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in keep else next(rest)) for b in range(256)}


class WordEncoder(dict):
    """Ids of space-separated words as little-endian uint32 bytes, with a memory of words and pieces bounded in bytes.

    The tokenizer drops white space and merges within pre-tokens only, so a text's ids are its words' ids in order.
    Printable Latin-1 words go to the BPE model piece by piece; all others through the tokenizer as a whole.
    """

    ENTRY = 200  # bytes of an entry besides its word and ids

    def __init__(self, path: str, words: int = 60 << 20, pieces: int = 4 << 20):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.find = self.tokenizer.model, regex.compile(PRE_TOKENS).findall
        self.alphabet, self.most_words, self.most_pieces = byte_alphabet(), words, pieces
        self.pieces: dict[str, bytes] = {}
        self.held_words = self.held_pieces = 0
        self[""] = b""

    def forget(self) -> None:
        """Drop the words and pieces held."""
        self.clear()
        self.pieces.clear()
        self.held_words = self.held_pieces = 0
        self[""] = b""

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            if self.held_pieces > self.most_pieces:
                self.pieces.clear()
                self.held_pieces = 0
            found = self.pieces[piece] = self._merged(piece.encode().decode("latin-1").translate(self.alphabet))
            self.held_pieces += self.ENTRY + len(piece) + len(found)
        return found

    def _merged(self, mapped: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(mapped)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        head = word.rstrip(string.punctuation)
        if len(word) <= 1000 and head.isalpha() and max(head) <= "ÿ":  # one pre-token of letters, at most one of punctuation
            low = head.lower()
            if len(head) == len(word):
                ids = self._merged(low if low.isascii() else low.encode().decode("latin-1").translate(self.alphabet))
            else:
                ids = self[low] + self._piece(word[len(head) :])
        elif len(word) > 1000 or max(word) > "ÿ" or not word.isprintable() or "<|" in word:
            ids = self._whole(word)
        else:
            # letters are held once, whether alone or beside other signs
            ids = b"".join([self[p] if p.isalpha() and p != word else self._piece(p) for p in self.find(unicodedata.normalize("NFC", word).lower())])
        if len(word) <= 1000:
            self[word] = ids
            self.held_words += self.ENTRY + len(word) + len(ids)
        return ids

    def text(self, text: str) -> bytes:
        if self.held_words > self.most_words:
            self.clear()
            self.held_words = 0
            self[""] = b""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_LOADED: dict[str, WordEncoder] = {}
_LOCK = threading.Lock()


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker and file."""
    with _LOCK:
        if path not in _LOADED:
            _LOADED[path] = WordEncoder(path)
        return _LOADED[path]


def pack_texts(df: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, limits: Limits = Limits(), with_ids: bool = False) -> DataFrame:
    """Tokenize whole texts, append ``end_id``, and pack; every token bears loss.

    One row a piece: id, start (ids of its document before it), length, ids_crc32, doc_tokens, loss_tokens,
    sequence_id, segment, offset; with ``with_ids`` also input_ids and loss_mask. Null or empty text is a document
    of the end id alone; a null id stays null; repeated rows are packed each; further columns are not read; an empty
    table gives no rows. Working memory: a record batch, one document's ids, and a window's pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end, kind = encoder(tokenizer), end_id.to_bytes(4, "little"), None

        def examples(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]):
            for batch in bounded((b for part in ([first], rest) for b in part), "text"):
                for owner, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    yield owner, own.text(text or "") + end, None

        KEPT[__name__] = own.forget
        for batch in batches:
            kind = batch.schema.field("id").type
            yield from _pack(examples(batch, batches), limits, kind, with_ids)

    source = narrow(df, id=id_col, text=text_col)
    return _named(source.mapInArrow(released(run), PIECES.format(kind=source.schema["id"].dataType.simpleString())), id_col, with_ids)


def pack_tokens(df: DataFrame, *, id_col: str = "doc_id", ids_col: str = "input_ids", loss_col: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """Pack rows that hold token ids (array<int>) and, optionally, a loss mask (array<boolean>), as of formatted chats.

    Returns what ``pack_texts`` does with ids. A null or empty array has no pieces; a mask shorter than the ids, or
    null, or null in places, counts as false there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def examples(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]):
            for part in ([first], rest):
                for batch in part:
                    masks = batch.column("mask").to_pylist() if loss_col else [None] * batch.num_rows
                    for owner, ids, mask in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist(), masks, strict=True):
                        ids = [x or 0 for x in ids or []]
                        bits = bytes(bool(x) for x in (mask or [])[: len(ids)]) if loss_col else None
                        yield owner, np.array(ids, "<u4").tobytes(), bits + bytes(len(ids) - len(bits)) if loss_col else None

        for batch in batches:
            yield from _pack(examples(batch, batches), limits, batch.schema.field("id").type, True)

    source = narrow(df, id=id_col, ids=ids_col, **({"mask": loss_col} if loss_col else {}))
    return _named(source.mapInArrow(released(run), PIECES.format(kind=source.schema["id"].dataType.simpleString())), id_col, True)


def _named(pieces: DataFrame, id_col: str, with_ids: bool) -> DataFrame:
    named = pieces.withColumnRenamed("id", id_col)
    return named if with_ids else named.drop("input_ids", "loss_mask")


def sequences(pieces: DataFrame, pad_id: int = 0, tokens: int = 4096) -> DataFrame:
    """Assemble pieces that carry ids: sequence_id, input_ids padded to ``tokens`` except at a power of two, loss_mask, segment_ids.

    A sequence's pieces are bounded by its capacity, so a group is never larger than that.
    """
    parts = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "segment", "input_ids", "loss_mask"))).alias("parts"))
    flat = parts.select(
        "sequence_id",
        F.flatten(F.col("parts.input_ids")).alias("ids"),
        F.flatten(F.col("parts.loss_mask")).alias("mask"),
        F.flatten(F.transform("parts", lambda p: F.array_repeat(p["segment"], F.size(p["input_ids"])))).alias("segments"),
    )
    n = F.size("ids")
    pad = F.when(F.bit_count(n) == 1, F.lit(0)).otherwise(F.greatest(F.lit(tokens) - n, F.lit(0)))
    return flat.select(
        "sequence_id",
        F.concat("ids", F.array_repeat(F.lit(pad_id), pad)).alias("input_ids"),
        F.concat("mask", F.array_repeat(F.lit(False), pad)).alias("loss_mask"),
        F.concat("segments", F.array_repeat(F.lit(-1), pad)).alias("segment_ids"),
    )
