"""Pictures as rows of pixels: warps, resizing, transforms, perceptual hashes and blur, in numpy over whole batches.

A picture is an array of doubles, row by row, channels of a pixel together, beside its height and width. A picture that is
null, or whose length isn't height * width * channels, gives null.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StringType

# The low-pass taps of the Daubechies wavelet with four vanishing moments.
DB4 = (-0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114, -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523)


def _by_shape(pixels: pa.Array, height: pa.Array, width: pa.Array, channels: int, run: Callable[[np.ndarray, np.ndarray], list]) -> list:
    """``run`` over the pictures of each shape at once (n x h x w x c, their rows); nulls for the others."""
    out: list = [None] * len(pixels)
    sizes = np.array([-1 if n is None else n for n in pa.compute.list_value_length(pixels).to_pylist()])
    h, w = (np.array(c.fill_null(-1), np.int64) for c in (height, width))
    fine = (sizes == h * w * channels) & (h > 0) & (w > 0)
    for shape in {(int(a), int(b)) for a, b in zip(h[fine], w[fine], strict=True)}:
        rows = np.flatnonzero(fine & (h == shape[0]) & (w == shape[1]))
        flat = pixels.take(pa.array(rows)).flatten()
        images = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), *shape, channels)
        whole = np.isfinite(images).reshape(len(rows), -1).all(axis=1)
        if whole.any():
            for row, made in zip(rows[whole], run(images[whole], rows[whole]), strict=True):
                out[row] = made
    return out


# --- warps ------------------------------------------------------------------------------------------------------------


def square_to_quads(quads: np.ndarray) -> np.ndarray:
    """The projective maps (n x 3 x 3) of the unit square's corners, clockwise from (0, 0), to n quadrilaterals (n x 4 x 2).

    NaN where three corners stand on one line.
    """
    p0, p1, p2, p3 = (quads[:, i] for i in range(4))
    a, b, s = p1 - p2, p3 - p2, p0 - p1 + p2 - p3
    det = a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]
    with np.errstate(all="ignore"):
        g = np.where(det != 0, (s[:, 0] * b[:, 1] - b[:, 0] * s[:, 1]) / det, np.nan)
        h = np.where(det != 0, (a[:, 0] * s[:, 1] - s[:, 0] * a[:, 1]) / det, np.nan)
    first = [np.stack([p1[:, i] - p0[:, i] + g * p1[:, i], p3[:, i] - p0[:, i] + h * p3[:, i], p0[:, i]], axis=1) for i in range(2)]
    return np.stack([*first, np.stack([g, h, np.ones(len(quads))], axis=1)], axis=1)


def sampled(images: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples (n x points x c) of pictures at points (n x points); what lies outside is 0."""
    n, height, width, _ = images.shape
    x0, y0 = np.floor(x), np.floor(y)
    out = np.zeros((*x.shape, images.shape[3]))
    row = np.arange(n)[:, None]
    for dx in (0, 1):
        for dy in (0, 1):
            px, py = x0 + dx, y0 + dy
            weight = np.abs(1 - dx - (x - x0)) * np.abs(1 - dy - (y - y0))
            inside = (px >= 0) & (px < width) & (py >= 0) & (py < height)
            at_x, at_y = np.where(inside, px, 0).astype(int), np.where(inside, py, 0).astype(int)
            out += np.where(inside, weight, 0)[..., None] * images[row, at_y, at_x]
    return out


def warped(images: np.ndarray, maps: np.ndarray, to_width: int, to_height: int) -> np.ndarray:
    """Pictures (n x to_height x to_width x c) whose pixel (x, y) is the source at ``maps`` (n x 3 x 3) of (x, y)."""
    y, x = np.mgrid[0:to_height, 0:to_width]
    points = np.stack([x.ravel(), y.ravel(), np.ones(x.size)]).astype(np.float64)
    u, v, w = np.moveaxis(maps @ points, 1, 0)
    with np.errstate(all="ignore"):
        u, v = np.where(w != 0, u / w, -2.0), np.where(w != 0, v / w, -2.0)
    limit = max(images.shape[1:3]) + 2.0  # far outside is as good as just outside
    return sampled(images, np.clip(u, -2.0, limit), np.clip(v, -2.0, limit)).reshape(len(images), to_height, to_width, -1)


def dewarp(pixels: Column, height: Column, width: Column, corners: Column, to_width: int, to_height: int, channels: int = 1) -> Column:
    """The quadrilateral with these corners (normalised, from the top left clockwise), as a picture of its own.

    Corner (0, 0) is the first pixel's centre, and (1, 1) lies one pixel behind the last. Null corners, another number of
    corners, or three of them on one line give null.
    """

    @F.arrow_udf(ArrayType(DoubleType()))
    def run(p: pa.Array, h: pa.Array, w: pa.Array, q: pa.Array) -> pa.Array:
        lists = q.to_pylist()
        known = [v is not None and len(v) == 4 and all(c is not None and c["x"] is not None and c["y"] is not None for c in v) for v in lists]
        quads = np.array([[(c["x"], c["y"]) for c in v] if ok else [(np.nan, np.nan)] * 4 for v, ok in zip(lists, known, strict=True)], np.float64).reshape(-1, 4, 2)

        def each(images: np.ndarray, rows: np.ndarray) -> list:
            own = quads[rows] * np.array(images.shape[2:0:-1])
            maps = square_to_quads(own) * np.array([1 / to_width, 1 / to_height, 1.0])
            fine = np.isfinite(maps).all(axis=(1, 2))
            made = warped(images, np.where(fine[:, None, None], maps, 0.0), to_width, to_height).reshape(len(rows), -1)
            return [m if ok else None for m, ok in zip(made, fine, strict=True)]

        return pa.array(_by_shape(p, h, w, channels, each), pa.list_(pa.float64()))

    return run(pixels, height, width, corners)


# --- hashes -----------------------------------------------------------------------------------------------------------


@functools.cache
def area_matrix(n: int, to: int) -> np.ndarray:
    """(to x n) means of the stretches that n pixels are shrunk into, or spread over."""
    edges = np.arange(to + 1) * n / to
    low, high = edges[:-1, None], edges[1:, None]
    covered = np.clip(np.minimum(high, np.arange(1, n + 1)) - np.maximum(low, np.arange(n)), 0, None)
    return covered / covered.sum(axis=1, keepdims=True)


@functools.cache
def cosine_matrix(n: int, kept: int) -> np.ndarray:
    """The first rows of the discrete cosine transform of type II, without normalisation."""
    return 2 * np.cos(np.pi * np.arange(kept)[:, None] * (2 * np.arange(n) + 1) / (2 * n))


@functools.cache
def wavelet_matrix(n: int) -> np.ndarray:
    """One level of the low-pass of the wavelet, every second place, over a signal that is mirrored at its ends."""
    taps, out = len(DB4), (n + len(DB4) - 1) // 2
    m = np.zeros((out, n))
    for i in range(out):
        for j, tap in enumerate(DB4):
            at = (2 * i + 1 - j) % (2 * n)  # mirrored with the end repeated: a period of 2n
            m[i, at if at < n else 2 * n - 1 - at] += tap
    return m


def _both(m: np.ndarray, images: np.ndarray) -> np.ndarray:
    return m @ images @ m.T


def _over_median(x: np.ndarray) -> np.ndarray:
    """Bits of values above the median of their picture; values are rounded, so that equal ones stay equal."""
    flat = np.round(x.reshape(len(x), -1), 9)
    return flat > np.median(flat, axis=1, keepdims=True)


def _shrunk(images: np.ndarray, height: int, width: int) -> np.ndarray:
    h, w = images.shape[1:]
    return images if (h, w) == (height, width) else area_matrix(h, height) @ images @ area_matrix(w, width).T


HASHES: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {}


def _hash(name: str):
    def add(f):
        HASHES[name] = f
        return f

    return add


@_hash("average")
def _average(images: np.ndarray, size: int) -> np.ndarray:
    """Pixels of the shrunk picture above their mean."""
    flat = _shrunk(images, size, size).reshape(len(images), -1)
    return np.round(flat, 9) > np.round(flat.mean(axis=1, keepdims=True), 9)


@_hash("difference")
def _difference(images: np.ndarray, size: int) -> np.ndarray:
    """Pixels brighter than the one to their left."""
    small = np.round(_shrunk(images, size, size + 1), 9)
    return (small[:, :, 1:] > small[:, :, :-1]).reshape(len(images), -1)


@_hash("cosine")
def _cosine(images: np.ndarray, size: int, factor: int = 4) -> np.ndarray:
    """Low frequencies of the discrete cosine transform of a picture of ``factor`` times the size, above their median."""
    n = size * factor
    return _over_median(_both(cosine_matrix(n, size), _shrunk(images, n, n)))


@_hash("wavelet")
def _wavelet(images: np.ndarray, size: int, factor: int = 4) -> np.ndarray:
    """Wavelet approximations of a picture of ``factor`` times the size, halved until about the size, above their median."""
    n = size * factor
    x = _shrunk(images, n, n)
    for _ in range(max(1, int(factor).bit_length() - 1)):
        x = _both(wavelet_matrix(x.shape[1]), x)
    return _over_median(x)


def picture_hash(pixels: Column, height: Column, width: Column, kind: str, size: int = 8, **options: int) -> Column:
    """Bits of a grey picture, packed into bytes from the highest bit on, zeros behind; ``kind`` is a name of HASHES."""
    make = HASHES[kind]

    @F.arrow_udf(BinaryType())
    def run(p: pa.Array, h: pa.Array, w: pa.Array) -> pa.Array:
        return pa.array(_by_shape(p, h, w, 1, lambda x, _: [np.packbits(b).tobytes() for b in make(x[..., 0], size, **options)]), pa.binary())

    return run(pixels, height, width)


def bits_text(packed: Column, bits: int) -> Column:
    """The first bits as a text of 0 and 1."""
    digits = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(-(-bits // 8))), lambda i: F.lpad(F.conv(F.hex(F.substring(packed, i, F.lit(1))), 16, 2), 8, "0")))
    return F.when(packed.isNotNull(), F.substring(digits, 1, bits)).cast(StringType())


# --- blur -------------------------------------------------------------------------------------------------------------


def blur_score(pixels: Column, height: Column, width: Column) -> Column:
    """Variance of the Laplacian (centre -4, neighbours 1) of a grey picture, mirrored at its edges without the edge itself."""

    @F.arrow_udf(DoubleType())
    def run(p: pa.Array, h: pa.Array, w: pa.Array) -> pa.Array:
        def each(x: np.ndarray, _: np.ndarray) -> list:
            x = x[..., 0]
            # a side of one pixel mirrors itself
            padded = np.pad(x, ((0, 0), (1, 1), (0, 0)), "reflect" if x.shape[1] > 1 else "edge")
            padded = np.pad(padded, ((0, 0), (0, 0), (1, 1)), "reflect" if x.shape[2] > 1 else "edge")
            around = padded[:, :-2, 1:-1] + padded[:, 2:, 1:-1] + padded[:, 1:-1, :-2] + padded[:, 1:-1, 2:]
            return (around - 4 * x).reshape(len(x), -1).var(axis=1).tolist()

        return pa.array(_by_shape(p, h, w, 1, each), pa.float64())

    return run(pixels, height, width)


def sharp_enough(score: Column, least: float) -> Column:
    """The keep rule: a score of ``least`` or more; 0 keeps all, also pictures without a score."""
    return F.lit(True) if least <= 0 else F.coalesce(score >= least, F.lit(False))
