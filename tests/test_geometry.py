"""Geometry on the fixed quadrilaterals, against NumPy re-statements of the definitions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import geometry as G

SHAPES = {
    "portrait": ((0.20, 0.10), (0.80, 0.10), (0.80, 0.90), (0.20, 0.90), 1000, 1000),
    "landscape": ((0.30, 0.05), (0.70, 0.05), (0.70, 0.95), (0.30, 0.95), 1920, 1080),
}


def lit(points):
    return G.quad(*[F.lit(float(v)) for p in points for v in p])


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def xy(points):
    return [(p["x"], p["y"]) for p in points]


@pytest.mark.parametrize("name", SHAPES)
def test_canonical_order_is_the_same_for_every_start_and_winding(spark, name):
    *pts, w, h = SHAPES[name]
    orders = [pts[i:] + pts[:i] for i in range(4)] + [pts[::-1], random.Random(1).sample(pts, 4)]
    row = one(spark, *[G.canonical(lit(o), w, h).alias(f"c{i}") for i, o in enumerate(orders)])
    found = [xy(c) for c in row]
    assert all(sorted(f) == sorted(pts) for f in found)
    for f in found:
        px = np.array(f) * (w, h)
        edges = [np.linalg.norm(px[i] - px[(i + 1) % 4]) for i in range(4)]
        assert edges[0] == pytest.approx(min(edges))
        assert sum(px[i][0] * px[(i + 1) % 4][1] - px[(i + 1) % 4][0] * px[i][1] for i in range(4)) > 0


def test_boxes(spark):
    *portrait, _, _ = SHAPES["portrait"]
    row = one(spark, *[c.alias(f"p{i}") for i, c in enumerate(G.padded_box(lit(portrait), 1000, 1000, 0.0))])
    assert tuple(row) == (200, 100, 800, 900)
    row = one(spark, *[c.alias(f"p{i}") for i, c in enumerate(G.padded_box(lit([(0.4, 0.3), (0.6, 0.3), (0.6, 0.7), (0.4, 0.7)]), 1000, 1000, 0.5))])
    assert tuple(row) == (300, 100, 700, 900)


def test_rotation_identities(spark):
    q = lit([(0.1, 0.1), (0.7, 0.2), (0.9, 0.8), (0.2, 0.6)])
    turn = lambda c, d: G.rotate_points(c, F.lit(float(d)), 0.5, 0.5)
    row = one(spark, q.alias("q"), turn(q, 90).alias("quarter"), turn(q, 360).alias("whole"), turn(turn(q, 90), 90).alias("twice"), turn(q, 180).alias("half"))
    assert xy(row.quarter)[0] == pytest.approx((0.1, 0.9))
    assert np.array(xy(row.whole)) == pytest.approx(np.array(xy(row.q)))
    assert np.array(xy(row.twice)) == pytest.approx(np.array(xy(row.half)))


def test_errors_don_t_depend_on_the_first_corner(spark):
    rng = random.Random(2)
    a, b = ([(rng.random(), rng.random()) for _ in range(4)] for _ in range(2))
    turns = [a[i:] + a[:i] for i in range(4)]
    row = one(spark, *[G.corner_error(lit(t), lit(b)).alias(f"e{i}") for i, t in enumerate(turns)], *[G.pck(lit(t), lit(b), 0.3).alias(f"p{i}") for i, t in enumerate(turns)])
    want = min(np.mean([math.dist(t[i], b[i]) for i in range(4)]) for t in turns)
    share = max(np.mean([math.dist(t[i], b[i]) < 0.3 * 2**0.5 for i in range(4)]) for t in turns)
    assert list(row)[:4] == pytest.approx([want] * 4) and list(row)[4:] == pytest.approx([share] * 4)


def test_valid_quads(spark):
    square = [(0, 0), (1, 0), (1, 1), (0, 1)]
    cases = {"square": square, "reversed": square[::-1], "crossed": [square[i] for i in (0, 2, 1, 3)], "dent": [(0, 0), (1, 0), (0.2, 0.2), (0, 1)], "thin": [(0, 0), (1, 0.01), (2, 0), (1, 0.3)], "point": [(0, 0)] * 4}
    row = one(spark, *[G.valid(lit(c)).alias(n) for n, c in cases.items()])
    assert row.asDict() == {"square": True, "reversed": True, "crossed": False, "dent": False, "thin": False, "point": False}


def test_polygon_iou(spark):
    square, half, diamond = [(0, 0), (1, 0), (1, 1), (0, 1)], [(0.5, 0), (1.5, 0), (1.5, 1), (0.5, 1)], [(0.5, 0), (1, 0.5), (0.5, 1), (0, 0.5)]
    pairs = [(square, square, 1.0), (square, half, 1 / 3), (square, diamond, 0.5), (square, diamond[::-1], 0.5), (square, [(2, 2), (3, 2), (3, 3), (2, 3)], 0.0)]
    for a, b, want in pairs:
        assert one(spark, G.polygon_iou(lit(a), lit(b)).alias("i")).i == pytest.approx(want)


def test_scaled_axes_are_not_swapped(spark):
    *pts, _, _ = SHAPES["portrait"]
    row = one(spark, G.to_pixels(lit(pts), 1920.0, 1080.0).alias("p"), G.crop_to_full(lit(pts), [F.lit(v) for v in (100.0, 50.0, 300.0, 650.0)], 1000.0, 1000.0).alias("c"))
    assert xy(row.p)[1] == pytest.approx((1536, 108)) and xy(row.c)[2] == pytest.approx((0.26, 0.59))
    assert all(p != q for p, q in itertools.pairwise(xy(row.p)))
