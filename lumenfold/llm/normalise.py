"""Normalised words of texts: lower case, ASCII punctuation as white space."""

from __future__ import annotations

import re

SPACES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain(text: str | None) -> bytes:
    """UTF-8 whose words are runs without white space."""
    return (text or "").lower().encode(errors="ignore").translate(SPACES)


def words(text: str) -> list[tuple[str, int, int]]:
    """The same words with their code points in the text; for texts that lower-casing lengthens, word by word."""
    return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]
