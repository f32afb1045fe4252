"""Corner heatmaps and per-axis distributions as arrays of logits: decoding, targets and losses, in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, x: t + x)


def _weighed(values: Column, weight) -> Column:
    """Sum of value times a function of its place."""
    places = F.sequence(F.lit(0), F.size(values) - 1)
    return _total(F.zip_with(values, places, lambda v, i: v * weight(i)))


def softmax(logits: Column) -> Column:
    """Shares that add up to one; the largest logit is taken off first, so no exponential overflows. Empty stays empty."""
    most = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x.cast("double") - most.cast("double")))
    total = _total(powers)
    return F.transform(powers, lambda p: p / total)


def soft_argmax(logits: Column, width: int) -> Column:
    """struct(x, y): the mean pixel centre, in shares of width and height, of a map given row by row. Null for an empty map."""
    shares, height = softmax(logits), F.size(logits) / width
    x = _weighed(shares, lambda i: (i % width + 0.5) / width)
    y = _weighed(shares, lambda i: (F.floor(i / width) + 0.5) / height)
    return F.when(F.size(logits) > 0, F.struct(x.alias("x"), y.alias("y")))


def axis_mean(logits: Column) -> Column:
    """The mean of a distribution over evenly spaced places from 0 to 1, both ends among them."""
    last = F.greatest(F.size(logits) - 1, F.lit(1))
    return F.when(F.size(logits) > 0, _weighed(softmax(logits), lambda i: i / last))


def gaussian_map(x: Column, y: Column, width: int, height: int, sigma: float) -> Column:
    """A map, row by row, of exp(-d^2 / (2 sigma^2)); d: pixels between a pixel's number and the corner at shares x, y."""
    px, py = x * width, y * height
    bell = lambda i: F.exp(-((i % width - px) ** 2 + (F.floor(i / width) - py) ** 2) / (2 * sigma**2))
    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), bell)


def gaussian_axis(place: Column, bins: int, sigma: float) -> Column:
    """Shares of ``bins`` places, by a bell around a place from 0 to 1."""
    at = place * (bins - 1)
    bell = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.exp(-0.5 * ((i - at) / sigma) ** 2))
    total = _total(bell)
    return F.transform(bell, lambda b: b / total)


def map_loss(logits: Column, target: Column) -> Column:
    """Mean binary cross entropy of a map's logits, in the form that doesn't overflow."""
    each = F.zip_with(logits, target, lambda x, t: F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x))))
    return _total(each) / F.nullif(F.size(logits), F.lit(0))


def axis_loss(logits: Column, target: Column) -> Column:
    """Divergence of a distribution, given by logits, from its target; places that the target gives nothing add nothing."""
    most = F.array_max(logits).cast("double")
    log_total = F.log(_total(F.transform(logits, lambda x: F.exp(x - most)))) + most
    return _total(F.zip_with(logits, target, lambda x, t: F.when(t > 0, t * (F.log(t) - (x - log_total))).otherwise(0.0)))


def corner_loss(axes: Column, corners: Column, bins: int, sigma: float) -> Column:
    """Mean axis loss of a card's axes (an array of logits for each coordinate) against its coordinates, in the same order."""
    each = F.zip_with(axes, corners, lambda logits, at: axis_loss(logits, gaussian_axis(at, bins, sigma)))
    return _total(each) / F.nullif(F.size(axes), F.lit(0))
