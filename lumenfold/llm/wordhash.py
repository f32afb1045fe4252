"""64-bit hashes of words and shingles, vectorised over whole batches of texts.

A word is a run of bytes other than space and \\x09-\\x0D, with A-Z lower-cased. Its hash is a polynomial over a
table of random 64-bit byte codes, read off a prefix sum of the batch and then mixed; equal words have equal hashes in
any task and run. Polynomials modulo 2 ** 64 collide for some very long words whatever their radix (Thue-Morse words), so
words of more than LONG bytes are hashed one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

SEGMENT = 2 << 20
LONG = 128
RADIX = 0x9E3779B97F4A7C15
INVERSE = pow(RADIX, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def codes(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(RADIX)) | np.uint64(1)


WORD = np.ones(256, bool)
WORD[[32, *range(9, 14)]] = False
BYTES = np.where(WORD, codes(256, 1), np.uint64(0))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((RADIX, INVERSE)):
            all_of = np.full(max(n, SEGMENT + 4096), base, np.uint64)
            all_of[0] = 1
            _powers[k] = np.cumprod(all_of)
    return _powers[0], _powers[1]


def _hash_buffer(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and byte starts of a buffer's words."""
    joined = joined.lower()
    a = np.frombuffer(joined, np.uint8)
    if not len(a):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    edges = np.flatnonzero(np.diff(WORD[a], prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(a))
    total = np.empty(len(a) + 1, np.uint64)
    total[0] = 0
    np.cumsum(BYTES[a] * up[: len(a)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts])
    for i in np.flatnonzero(ends - starts > LONG):
        hashes[i] = xxhash.xxh3_64_intdigest(joined[starts[i] : ends[i]], RADIX)
    return hashes, starts


def _segments(text: bytes) -> Iterator[bytes]:
    """A long text cut at white space, where there is some, into buffers of about SEGMENT bytes."""
    start = 0
    while len(text) - start > SEGMENT:
        end = max(text.rfind(c, start + 1, start + SEGMENT) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
        if end < 0:
            after = [p for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r") if (p := text.find(c, start + SEGMENT)) >= 0]
            end = min(after, default=len(text))
        yield text[start:end]
        start = end
    yield text[start:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes in order, and each text's first word: text i has hashes[ptr[i] : ptr[i + 1]]."""
    parts, counts = [], np.zeros(len(texts), np.int64)
    group: list[int] = []
    held = 0

    def close() -> None:
        nonlocal held
        if group:
            lengths = np.array([len(texts[i]) + 1 for i in group])
            found, starts = _hash_buffer(b"\n".join([texts[i] for i in group]))
            firsts = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)[:-1]]))
            counts[group] = np.diff(np.concatenate([firsts, [len(starts)]]))
            parts.append(found)
            group.clear()
            held = 0

    for i, text in enumerate(texts):
        if len(text) > SEGMENT:
            close()
            for segment in _segments(text):
                found, _ = _hash_buffer(segment)
                counts[i] += len(found)
                parts.append(found)
            continue
        if held + len(text) > SEGMENT:
            close()
        group.append(i)
        held += len(text) + 1
    close()
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Each text's set of k-word shingle hashes, ascending int64; all words as one shingle if there are fewer."""
    hashes, ptr = word_hashes(texts)
    factor = codes(2 * k, 2)
    n = len(hashes)
    rolled = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k):
        rolled += hashes[i : i + len(rolled)] * factor[i]
    rolled = mix(rolled).view(np.int64)
    out = []
    for a, b in zip(ptr[:-1], ptr[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            whole = (hashes[a:b] * factor[: b - a]).sum(dtype=np.uint64, keepdims=True) + factor[k + b - a]
            out.append(mix(whole).view(np.int64))
        else:
            out.append(np.empty(0, np.int64))
    return out
