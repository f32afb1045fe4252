"""Vector and bit-vector functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8


def dot(a: Column, b: Column) -> Column:
    """Sum of products in index order, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, style: str = "add") -> Column:
    """Normalised; ``add``: by norm + epsilon, ``clip``: by the larger of norm and epsilon."""
    by = norm(a) + EPSILON if style == "add" else F.greatest(norm(a), F.lit(EPSILON))
    return F.transform(a, lambda x: x.cast("double") / by)


def cosine(a: Column, b: Column) -> Column:
    return dot(unit(a), unit(b))


def sign_bits(a: Column) -> Column:
    """Positive components as bits of one 64-bit word, the first component highest; arrays of at most 64."""
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda t, x: F.shiftleft(t, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("bigint")))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)


def hamming_unpacked(a: Column, b: Column) -> Column:
    """Places where two arrays of 0 and 1 differ."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d))


def pack_bits(a: Column, width: int) -> Column:
    """Positive components as a binary string of ``width``, right-padded; an error if there are more."""
    bits = F.array_join(F.transform(a, lambda x: F.when(x > 0, "1").otherwise("0")), "")
    return F.when(F.size(a) > width, F.raise_error(F.lit(f"more than {width} bits"))).otherwise(F.rpad(bits, width, "0"))


def hex_canonical(c: Column, width: Column) -> Column:
    """Trimmed hex of one width: zero-padded on the left, or its rightmost digits."""
    h = F.lower(F.trim(c))
    return F.when(F.length(h) >= width, F.right(h, width)).otherwise(F.concat(F.repeat(F.lit("0"), width - F.length(h)), h))


def hex_words(c: Column, width: int) -> Column:
    """64-bit words of a hex string whose width is a multiple of 16."""
    return F.array(*[F.conv(F.substring(c, i, 16), 16, -10).cast("bigint") for i in range(1, width + 1, 16)])


def confidence(score: Column, kind: str, bits: int = 256) -> Column:
    return F.greatest(F.lit(0.0), 1 - score / bits) if kind == "hamming" else score


def hash_bytes(side: Column) -> Column:
    """Bytes of a square hash: (n * n + 7) div 8."""
    return ((side * side + 7) / 8).cast("bigint")
