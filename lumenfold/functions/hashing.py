"""Deterministic splits, ids and fingerprints, bit-exact in any engine with SHA and MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_fraction(c: Column, seed: str) -> Column:
    """A fraction in [0, 1]: the first 8 hex digits of SHA-256(seed:id) over 0xFFFFFFFF."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), c), 256), 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0)


def split_of(c: Column, seed: str, train: float = 0.8, val: float = 0.1) -> Column:
    """train, val or test of a class id; all rows of a class share a split."""
    f = hash_fraction(c, seed)
    return F.when(f < train, "train").when(f < train + val, "val").otherwise("test")


def art_id(name: Column, artist: Column) -> Column:
    """16 hex digits of SHA-1(name|artist)."""
    return F.substring(F.sha1(F.concat(name, F.lit("|"), artist)), 1, 16)


def digest12(c: Column) -> Column:
    return F.substring(F.sha1(c), 1, 12)


def order_key(c: Column, seed: str) -> Column:
    """A pseudo-random order of ids that any engine reproduces."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), c.cast("string")), 256)
