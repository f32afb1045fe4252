"""Token counts of a sentencepiece model, whole texts, with overlap resynchronisation for huge documents.

A huge text is encoded in chunks that overlap. Two neighbouring encodings are spliced at a position of the
overlap where both have a token boundary and where the boundary is proven stable: no piece of the vocabulary
holds the two characters around it side by side, so that no merge can ever cross it, whatever stands further
left or right. Where an overlap has no such position, it is widened, in the end to the whole chunk and then by
encoding both chunks as one, twice as long each time, so that a text without any proven boundary is encoded a few times
in all. So counts equal those of encoding the text at once; working memory is bounded by the longest stretch without
a proven boundary.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import bounded, narrow, released

SPACE = "▁"
_LOADED: dict[tuple, PieceCounter] = {}
_LOCK = threading.Lock()


class PieceCounter:
    def __init__(self, model: str, huge: int = 16_000, overlap: int = 256):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.huge, self.overlap = huge, overlap
        self.inside: set[str] = set()
        for i in range(self.sp.get_piece_size()):
            if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i)):
                piece = self.sp.id_to_piece(i)
                self.inside.update(piece[j : j + 2] for j in range(len(piece) - 1))

    def stable(self, text: str, at: int) -> bool:
        """Whether no piece can span the boundary before ``text[at]``."""
        return text[at - 1 : at + 1].replace(" ", SPACE) not in self.inside

    def _starts(self, text: str) -> np.ndarray:
        return np.fromiter((begin for begin, _ in self.sp.encode(text, out_type="offset_mapping")["offsets"]), np.int64)

    def count_huge(self, text: str, chunk: int | None = None, overlap: int | None = None) -> int:
        """Tokens of the text by chunks; chunk and overlap are counts of characters."""
        chunk, overlap = chunk or self.huge // 2, overlap or self.overlap
        total, left, end = 0, 0, min(chunk, len(text))
        # tokens before ``left`` are counted; the chunk at hand is text[base:end], with token starts ``starts`` once needed
        base, starts = 0, None
        while end < len(text):
            if not self._parted(text, left, end):  # no proven boundary to be found: go on with as much again
                end = min(len(text), max(end + chunk, end + (end - base)))
                starts = None
                continue
            starts = self._starts(text[base:end]) if starts is None else starts
            width, splice = min(overlap, end - left), None
            until = min(len(text), end + chunk)
            while splice is None and width:
                after = self._starts(text[end - width : until])
                splice = self._splice(text, base, starts, end - width, after, max(left, end - width) + 1, end)
                if splice is None:
                    width = 0 if width == end - left else min(2 * width, end - left)
            if splice is None:  # none of them aligned in all of the chunk: go on with both as one, and as much again
                end = min(len(text), max(until, end + (end - base)))
                starts = None
                continue
            total += int(((starts + base >= left) & (starts + base < splice)).sum())
            base, starts, left, end = end - width, after, splice, until
        if base == left == 0:
            return len(self.sp.encode(text, out_type="numpy"))
        starts = self._starts(text[base:end]) if starts is None else starts
        return total + int((starts + base >= left).sum())

    def _parted(self, text: str, left: int, end: int) -> bool:
        """Whether there is a proven boundary in (left, end)."""
        part = text[left:end].replace(" ", SPACE)
        return any(a + b not in self.inside for a, b in set(zip(part, part[1:], strict=False)))

    def _splice(self, text: str, a: int, a_starts: np.ndarray, b: int, b_starts: np.ndarray, low: int, high: int) -> int | None:
        """The last position in [low, high) where both encodings start a token and the boundary is proven."""
        both = np.intersect1d(a_starts + a, b_starts + b)
        for s in both[(both >= low) & (both < high)][::-1].tolist():
            if self.stable(text, s):
                return s
        return None

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        small = [i for i, t in enumerate(texts) if len(t) <= self.huge]
        for i, ids in zip(small, self.sp.encode([texts[i] for i in small], out_type="numpy", num_threads=1), strict=True):
            out[i] = len(ids)
        for i, t in enumerate(texts):
            if len(t) > self.huge:
                out[i] = self.count_huge(t)
        return out


def counter(model: str, huge: int, overlap: int) -> PieceCounter:
    """One counter for each Python worker and setting."""
    with _LOCK:
        key = (model, huge, overlap)
        if key not in _LOADED:
            _LOADED[key] = PieceCounter(model, huge, overlap)
        return _LOADED[key]


def count_tokens(df: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, huge: int = 16_000, overlap: int = 256) -> DataFrame:
    """One row for each input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows are counted each; further
    columns are not read, so their names can't clash; an empty table gives an empty result. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model, huge, overlap)
        for batch in bounded(batches, "text"):
            counts = own.counts([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    source = narrow(df, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()
    sized = source.withColumn("n_bytes", F.coalesce(F.octet_length("text").cast("bigint"), F.lit(0).cast("bigint")))
    counted = sized.mapInArrow(released(run), f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
