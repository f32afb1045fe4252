"""Keypoints and packed bits as binary columns of a fixed layout, with a header that says what they hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, IntegerType, StructField, StructType

MAGIC = b"KP1\0"
LAYOUT = np.dtype([("x", "<f4"), ("y", "<f4"), ("size", "<f4"), ("angle", "<f4"), ("response", "<f4"), ("octave", "<i4"), ("class_id", "<i4")])
KEYPOINT = ArrayType(StructType([StructField(n, IntegerType() if LAYOUT[n].kind == "i" else FloatType()) for n in LAYOUT.names]))


@F.arrow_udf(BinaryType())
def pack_keypoints(points: pa.Array) -> pa.Array:
    """Records (see KEYPOINT) as bytes: four that name the layout, their number, then 28 bytes each. Null stays null.

    A keypoint without some of its fields has 0 there, and -1 for class_id.
    """
    out = []
    flat, ends = points.flatten(), np.cumsum([0, *[n or 0 for n in pa.compute.list_value_length(points).to_pylist()]])
    records = np.zeros(len(flat), LAYOUT)
    for name in LAYOUT.names:
        records[name] = flat.field(name).fill_null(-1 if name == "class_id" else 0).to_numpy(zero_copy_only=False)
    for i, known in enumerate(points.is_valid().to_pylist()):
        own = records[ends[i] : ends[i + 1]]
        out.append(MAGIC + np.uint32(len(own)).tobytes() + own.tobytes() if known else None)
    return pa.array(out, pa.binary())


@F.arrow_udf(KEYPOINT)
def unpack_keypoints(packed: pa.Array) -> pa.Array:
    """The records again; null for null, for another layout, and for bytes that are cut off."""
    rows, offsets, valid = [], [0], []
    for data in packed.to_pylist():
        fine = data is not None and data[:4] == MAGIC and len(data) >= 8 and len(data) == 8 + LAYOUT.itemsize * int(np.frombuffer(data, "<u4", 1, 4)[0])
        own = np.frombuffer(data, LAYOUT, offset=8) if fine else np.zeros(0, LAYOUT)
        rows.append(own)
        offsets.append(offsets[-1] + len(own))
        valid.append(fine)
    flat = np.concatenate(rows) if rows else np.zeros(0, LAYOUT)
    records = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[n])) for n in LAYOUT.names], names=list(LAYOUT.names))
    mask = pa.array([not v for v in valid], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), records, mask=mask) if len(valid) else pa.array([], pa.list_(records.type))


def described(bits: Column, name: str, n_bits: int, fingerprint: str = "") -> Column:
    """A packed column under ``name`` with a header that Parquet keeps: how many bits, and of what they were made."""
    return bits.alias(name, metadata={"packed_bits": n_bits, "fingerprint": fingerprint})


def words(bits: Column, n_bits: int) -> Column:
    """The 64-bit words of packed bits, zeros behind, for bit_count and xor."""
    padded = F.rpad(F.hex(bits), 16 * -(-n_bits // 64), "0")
    return F.transform(F.sequence(F.lit(0), F.lit(-(-n_bits // 64) - 1)), lambda i: F.conv(F.substring(padded, i * 16 + 1, F.lit(16)), 16, -10).cast("bigint"))


def hamming(a: Column, b: Column, n_bits: int) -> Column:
    """Differing bits of two packed columns of one width, read straight from their bytes; null if either is null or of another width."""
    same = (F.octet_length(a) == -(-n_bits // 8)) & (F.octet_length(b) == -(-n_bits // 8))
    differing = F.aggregate(F.zip_with(words(a, n_bits), words(b, n_bits), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return F.when(same, differing)
