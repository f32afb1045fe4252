"""Quadrilaterals as arrays of four struct(x, y), in Column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lumenfold.functions.binding import let


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def quad(*xy: Column) -> Column:
    """Four points of eight columns x0, y0, x1, ..."""
    return F.array(*[point(x, y) for x, y in zip(xy[::2], xy[1::2], strict=True)])


def rotate_list(q: Column, by: Column) -> Column:
    """The points from place ``by`` (0 to 3) on, then those before it."""
    n = by.cast("int")
    return F.concat(F.slice(q, n + 1, F.lit(4) - n), F.when(n > 0, F.slice(q, F.lit(1), n)).otherwise(F.slice(q, 1, 0)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2)


def _mean(values: list[Column]) -> Column:
    total = values[0]
    for v in values[1:]:
        total = total + v
    return total / len(values)


def canonical(q: Column, width: float, height: float) -> Column:
    """Clockwise in image space around the centroid, from the end of the pixel axis whose edge is the shortest on."""
    cx, cy = _mean([q[i]["x"] for i in range(4)]), _mean([q[i]["y"] for i in range(4)])
    keyed = F.transform(q, lambda p: F.struct(F.atan2((p["y"] - cy) * height, (p["x"] - cx) * width).alias("angle"), p["x"].alias("x"), p["y"].alias("y")))
    around = F.transform(F.array_sort(keyed), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    scaled = lambda p: F.struct((p["x"] * width).alias("x"), (p["y"] * height).alias("y"))
    edges = F.array(*[F.round(distance(scaled(around[i]), scaled(around[(i + 1) % 4])), 9) for i in range(4)])
    return rotate_list(around, F.array_position(edges, F.array_min(edges)) - 1)


def top_left_first(q: Column) -> Column:
    sums = F.transform(q, lambda p: p["x"] + p["y"])
    return rotate_list(q, F.array_position(sums, F.array_min(sums)) - 1)


def by_sum_and_difference(q: Column) -> Column:
    """Top left, top right, bottom right, bottom left: the extremes of x + y and x - y."""
    pick = lambda key, largest: F.array_sort(F.transform(q, lambda p: F.struct(key(p).alias("k"), p["x"].alias("x"), p["y"].alias("y"))))[3 if largest else 0]
    plus, minus = lambda p: p["x"] + p["y"], lambda p: p["x"] - p["y"]
    chosen = (pick(plus, False), pick(minus, True), pick(plus, True), pick(minus, False))
    return F.array(*[F.struct(c["x"].alias("x"), c["y"].alias("y")) for c in chosen])


def _rotated_distances(pred: Column, true: Column) -> list[list[Column]]:
    return [[distance(pred[(i + r) % 4], true[i]) for i in range(4)] for r in range(4)]


def corner_error(pred: Column, true: Column) -> Column:
    """Mean corner distance under the best of the four rotations."""
    return F.least(*[_mean(d) for d in _rotated_distances(pred, true)])


def corner_error_fixed(pred: Column, true: Column) -> Column:
    return _mean([distance(pred[i], true[i]) for i in range(4)])


def pck(pred: Column, true: Column, threshold: float) -> Column:
    """Share of corners within threshold * sqrt(2), under the best rotation."""
    return F.greatest(*[_mean([(d < threshold * 2**0.5).cast("double") for d in ds]) for ds in _rotated_distances(pred, true)])


def _bounds(q: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(q, lambda p: p["x"]), F.transform(q, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def box_area(q: Column) -> Column:
    x1, y1, x2, y2 = _bounds(q)
    return (x2 - x1) * (y2 - y1)


def box_iou(a: Column, b: Column, width: float, height: float) -> Column:
    """Intersection over union of bounding boxes in pixels; 0 without a union."""
    a1, b1, a2, b2 = _bounds(a)
    c1, d1, c2, d2 = _bounds(b)
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(a2, c2) - F.greatest(a1, c1)) * width * F.greatest(zero, F.least(b2, d2) - F.greatest(b1, d1)) * height
    union = (box_area(a) + box_area(b)) * (width * height) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def valid(q: Column, least_degrees: float = 15.0) -> Column:
    """Convex, with every angle of at least ``least_degrees``."""
    cross, angles = [], []
    for i in range(4):
        a, b, c = q[(i - 1) % 4], q[i], q[(i + 1) % 4]
        ux, uy, vx, vy = a["x"] - b["x"], a["y"] - b["y"], c["x"] - b["x"], c["y"] - b["y"]
        cross.append(ux * vy - uy * vx)
        along = (ux * vx + uy * vy) / F.nullif(F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy), F.lit(0.0))
        angles.append(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), along)))))
    convex = (F.least(*cross) > 0) | (F.greatest(*cross) < 0)
    return F.coalesce(convex & (F.least(*angles) >= least_degrees), F.lit(False))


def accepted(q: Column, width: float, height: float, margin: float = 5.0) -> Column:
    """Corners inside the frame but for a margin in pixels, and 5 to 95 % of its area."""
    x1, y1, x2, y2 = _bounds(q)
    inside = (x1 * width >= -margin) & (y1 * height >= -margin) & (x2 * width <= width + margin) & (y2 * height <= height + margin)
    return inside & box_area(q).between(0.05, 0.95)


def padded_box(q: Column, width: int, height: int, pad: float) -> list[Column]:
    """Integer pixel box x1, y1, x2, y2, grown by ``pad`` of its size on each side and cut at the image."""
    x1, y1, x2, y2 = _bounds(q)
    px, py = (x2 - x1) * pad, (y2 - y1) * pad
    whole = lambda c, most: F.greatest(F.lit(0.0), F.least(c, F.lit(float(most)))).cast("int")
    # half a thousandth keeps products such as 0.2 * 1000 from falling below their whole number
    return [whole((x1 - px) * width + 5e-4, width), whole((y1 - py) * height + 5e-4, height), whole((x2 + px) * width + 5e-4, width), whole((y2 + py) * height + 5e-4, height)]


def crop_to_full(q: Column, box: list[Column], width: float, height: float) -> Column:
    """Corners normalised to a crop, mapped to the whole image."""
    x1, y1, x2, y2 = box
    return F.transform(q, lambda p: point((x1 + p["x"] * (x2 - x1)) / width, (y1 + p["y"] * (y2 - y1)) / height))


def to_pixels(q: Column, width: float, height: float) -> Column:
    return F.transform(q, lambda p: point(p["x"] * width, p["y"] * height))


def rotate_points(q: Column, degrees: Column, cx: float, cy: float) -> Column:
    """Counter-clockwise in image space (y down) about a centre, not clipped."""
    turn = let(F.radians(degrees), lambda a: F.struct(F.cos(a).alias("c"), F.sin(a).alias("s")))
    move = lambda c, s: F.transform(q, lambda p: point(cx + (p["x"] - cx) * c + (p["y"] - cy) * s, cy - (p["x"] - cx) * s + (p["y"] - cy) * c))
    return let(turn, lambda t: move(t["c"], t["s"]))


def square_to_quad(q: Column) -> list[Column]:
    """Row-major 3 x 3 matrix of the projective map from the unit square, clockwise from (0, 0), to four points.

    Null where the last three points stand on one line.
    """
    return _entries(q, *_bent(q))


def _bent(q: Column) -> tuple[Column, Column]:
    """The matrix' first two entries of its last row."""
    x, y = [q[i]["x"] for i in range(4)], [q[i]["y"] for i in range(4)]
    ax, ay, bx, by = x[1] - x[2], y[1] - y[2], x[3] - x[2], y[3] - y[2]
    sx, sy = x[0] - x[1] + x[2] - x[3], y[0] - y[1] + y[2] - y[3]
    det = F.nullif(ax * by - bx * ay, F.lit(0.0))
    return (sx * by - bx * sy) / det, (ax * sy - sx * ay) / det


def _entries(q: Column, g: Column, h: Column) -> list[Column]:
    x, y = [q[i]["x"] for i in range(4)], [q[i]["y"] for i in range(4)]
    return [x[1] - x[0] + g * x[1], x[3] - x[0] + h * x[3], x[0], y[1] - y[0] + g * y[1], y[3] - y[0] + h * y[3], y[0], g, h, F.lit(1.0)]


def _product(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)]


def _adjugate(m: list[Column]) -> list[Column]:
    a, b, c, d, e, f, g, h, i = m
    return [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]


def quad_to_quad(source: Column, target: Column) -> list[Column]:
    """The projective map of four points to four others, as a row-major matrix with 1 at its end; exact, without a solver."""
    whole = _product(square_to_quad(target), _adjugate(square_to_quad(source)))
    return [c / F.nullif(whole[8], F.lit(0.0)) for c in whole]


def with_quad_to_quad(rows: DataFrame, source: Column, target: Column) -> DataFrame:
    """Rows with the map of ``quad_to_quad`` as h0 to h8, made in steps of plain columns, each of which is evaluated once."""
    sides = {"s": source, "t": target}
    made = rows.select("*", *[q[i][c].alias(f"_{n}{c}{i}") for n, q in sides.items() for i in range(4) for c in "xy"])
    flat = {n: quad(*[F.col(f"_{n}{c}{i}") for i in range(4) for c in "xy"]) for n in sides}
    made = made.select("*", *[e.alias(f"_{n}{m}") for n, q in flat.items() for m, e in zip("gh", _bent(q), strict=True)])
    made = made.select("*", *[e.alias(f"_{n}{i}") for n, q in flat.items() for i, e in enumerate(_entries(q, F.col(f"_{n}g"), F.col(f"_{n}h")))])
    inverse, to = _adjugate([F.col(f"_s{i}") for i in range(9)]), [F.col(f"_t{i}") for i in range(9)]
    made = made.select(*rows.columns, *[e.alias(f"_w{i}") for i, e in enumerate(_product(to, inverse))])
    return made.select(*rows.columns, *[(F.col(f"_w{i}") / F.nullif(F.col("_w8"), F.lit(0.0))).alias(f"h{i}") for i in range(9)])


def apply_homography(q: Column, h: list[Column]) -> Column:
    """Points under a row-major 3 x 3 matrix."""
    return F.transform(q, lambda p: point((h[0] * p["x"] + h[1] * p["y"] + h[2]) / (h[6] * p["x"] + h[7] * p["y"] + h[8]), (h[3] * p["x"] + h[4] * p["y"] + h[5]) / (h[6] * p["x"] + h[7] * p["y"] + h[8])))


def cover_crop(width: Column, height: Column, to_width: float, to_height: float) -> list[Column]:
    """x, y, width, height of the largest centred part with the target's proportions."""
    scale = F.greatest(to_width / width, to_height / height)
    w, h = to_width / scale, to_height / scale
    return [(width - w) / 2, (height - h) / 2, w, h]


def outer_product(a: Column, b: Column) -> Column:
    """All products of two arrays, divided by the largest."""
    most = F.array_max(a) * F.array_max(b)
    return F.transform(a, lambda x: F.transform(b, lambda y: x * y / most))


def _clipped(points: np.ndarray, count: np.ndarray, corner: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polygons (n x slots x 2, the first ``count`` of them used) cut to the left of a line each: a corner and an edge."""
    n, slots, _ = points.shape
    j = np.arange(slots)
    used = j < count[:, None]
    before = np.take_along_axis(points, np.where(j > 0, j - 1, np.maximum(count[:, None] - 1, 0))[..., None], axis=1)
    side = lambda p: edge[:, None, 0] * (p[..., 1] - corner[:, None, 1]) - edge[:, None, 1] * (p[..., 0] - corner[:, None, 0])
    sp, sq = side(before), side(points)
    crossing = used & ((sp < 0) != (sq < 0))
    share = np.divide(sp, sp - sq, out=np.zeros_like(sp), where=crossing)
    both = np.stack([before + (points - before) * share[..., None], points], axis=2).reshape(n, 2 * slots, 2)
    kept = np.stack([crossing, used & (sq >= 0)], axis=2).reshape(n, 2 * slots)
    order = np.argsort(~kept, axis=1, kind="stable")[:, : max(1, int(kept.sum(axis=1).max(initial=0)))]
    return np.take_along_axis(both, order[..., None], axis=1), kept.sum(axis=1)


def _areas(points: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Signed areas; unused slots stand at the first point, where they add nothing."""
    p = np.where((np.arange(points.shape[1]) < count[:, None])[..., None], points, points[:, :1])
    q = np.roll(p, -1, axis=1)
    return (p[..., 0] * q[..., 1] - p[..., 1] * q[..., 0]).sum(axis=1) / 2


def _polygon_ious(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of quadrilaterals (n x 4 x 2), all rows at once."""
    four = np.full(len(a), 4)
    a, b = (np.where((_areas(p, four) >= 0)[:, None, None], p, p[:, ::-1]) for p in (a, b))
    inner, count = a, four
    for i in range(4):
        inner, count = _clipped(inner, count, b[:, i], b[:, (i + 1) % 4] - b[:, i])
    shared = np.where(count > 2, np.abs(_areas(inner, count)), 0.0)
    union = np.abs(_areas(a, four)) + np.abs(_areas(b, four)) - shared
    return np.divide(shared, union, out=np.zeros(len(a)), where=union > 0)


def _corners(quads: pa.Array) -> np.ndarray:
    """n x 4 x 2; null coordinates are NaN."""
    points = quads.flatten()
    if len(points) != 4 * len(quads) or not pa.compute.all(pa.compute.equal(pa.compute.list_value_length(quads), 4)).as_py():
        raise ValueError("quadrilaterals have four corners")
    x, y = (pa.compute.struct_field(points, n).to_numpy(zero_copy_only=False) for n in ("x", "y"))
    return np.stack([x, y], axis=1).astype(float).reshape(-1, 4, 2)


@F.arrow_udf(DoubleType())
def polygon_iou(a: pa.Array, b: pa.Array) -> pa.Array:
    """Exact intersection over union of convex quadrilaterals; null for null."""
    whole = pa.compute.and_(a.is_valid(), b.is_valid())
    out, rows = np.zeros(len(a)), whole.to_numpy(zero_copy_only=False)
    if rows.any():
        out[rows] = _polygon_ious(_corners(a.filter(whole)), _corners(b.filter(whole)))
    return pa.array(out, pa.float64(), mask=~rows)
