"""Geometry over quadrilaterals made from line items: a box of the image, and a shifted and turned guess of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import geometry as G
from lumenfold.plans.base import registrar
from lumenfold.sources import table

REGISTRY: dict[str, tuple] = {}
query = registrar(REGISTRY)

SIDE = {"x1": "0.1 + (k % 7) * 0.05", "y1": "0.1 + (k % 5) * 0.05", "x2": "0.6 + (k % 4) * 0.05", "y2": "0.7 + (k % 3) * 0.05", "d": "(k % 9 - 4) * 0.01"}
BOXES = "(SELECT id, k, " + ", ".join(f"{e} AS {n}" for n, e in SIDE.items()) + " FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 997 AS k FROM lineitem))"


def boxes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 997).alias("k"))
    rows = rows.select("id", "k", *[F.expr(e).cast("double").alias(n) for n, e in SIDE.items()])
    x1, y1, x2, y2, d = (F.col(c) for c in SIDE)
    true = G.quad(x1, y1, x2, y1, x2, y2, x1, y2)
    # the same corners, moved by d and listed from the third on
    pred = G.quad(x2 + d, y2 + d, x1 + d, y2 + d, x1 + d, y1 + d, x2 + d, y1 + d)
    return rows.select("id", "k", *SIDE, true.alias("true"), pred.alias("pred"))


R6 = lambda c: F.round(c, 6)


@query(f"SELECT id, round(abs(d) * sqrt(2), 6) AS cpe FROM {BOXES}")
def cpe(spark, sf_dir):
    return boxes(spark, sf_dir).select("id", R6(G.corner_error(F.col("pred"), F.col("true"))).alias("cpe"))


@query(f"SELECT id, CASE WHEN abs(d) < 0.025 THEN 1.0 ELSE 0.0 END::DOUBLE AS pck FROM {BOXES}")
def pck(spark, sf_dir):
    return boxes(spark, sf_dir).select("id", G.pck(F.col("pred"), F.col("true"), 0.025).alias("pck"))


@query(f"SELECT id, round(sqrt((x2 - x1 + d) * (x2 - x1 + d) + (y2 - y1 + d) * (y2 - y1 + d)) / 4 + sqrt((x1 - x2 + d) * (x1 - x2 + d) + (y2 - y1 + d) * (y2 - y1 + d)) / 4 + sqrt((x1 - x2 + d) * (x1 - x2 + d) + (y1 - y2 + d) * (y1 - y2 + d)) / 4 + sqrt((x2 - x1 + d) * (x2 - x1 + d) + (y1 - y2 + d) * (y1 - y2 + d)) / 4, 5) AS cpe FROM {BOXES}")
def cpe_unrotated(spark, sf_dir):
    return boxes(spark, sf_dir).select("id", F.round(G.corner_error_fixed(F.col("pred"), F.col("true")), 5).alias("cpe"))


@query(f"SELECT id, round(i / (2 * (x2 - x1) * (y2 - y1) - i), 5) AS iou FROM (SELECT *, (x2 - x1 - abs(d)) * (y2 - y1 - abs(d)) AS i FROM {BOXES})")
def bbox_iou(spark, sf_dir):
    return boxes(spark, sf_dir).select("id", F.round(G.box_iou(F.col("pred"), F.col("true"), 1000.0, 800.0), 5).alias("iou"))


@query(f"SELECT id, round(i / (2 * (x2 - x1) * (y2 - y1) - i), 5) AS iou FROM (SELECT *, (x2 - x1 - abs(d)) * (y2 - y1 - abs(d)) AS i FROM {BOXES})")
def polygon_iou(spark, sf_dir):
    """By clipping; equal to the boxes' here, as sides are parallel."""
    return boxes(spark, sf_dir).select("id", F.round(G.polygon_iou("pred", "true"), 5).alias("iou"))


@query(f"SELECT id, round((x2 - x1) * (y2 - y1), 6) AS area, true AS valid, false AS crossed FROM {BOXES}")
def quad_valid(spark, sf_dir):
    """Convex with wide enough angles; the same corners in crossed order aren't."""
    t = F.col("true")
    return boxes(spark, sf_dir).select("id", R6(G.box_area(t)).alias("area"), G.valid(t).alias("valid"), G.valid(F.array(t[0], t[2], t[1], t[3])).alias("crossed"))


@query(f"SELECT id, true AS accepted, x1 - 0.2 >= -0.005 AS moved FROM {BOXES}")
def homography_accept(spark, sf_dir):
    left = F.transform("true", lambda p: G.point(p["x"] - 0.2, p["y"]))
    return boxes(spark, sf_dir).select("id", G.accepted(F.col("true"), 1000.0, 1000.0).alias("accepted"), G.accepted(left, 1000.0, 1000.0).alias("moved"))


FIRST = "CASE WHEN (x2 - x1) * 1000 <= (y2 - y1) * 1000 + 1e-9 THEN x1 ELSE x2 END"


@query(f"SELECT id, round({FIRST}, 6) AS x0, round(y1, 6) AS y0 FROM {BOXES}")
def corners_canonical(spark, sf_dir):
    """The corner that the shortest pixel edge begins at, clockwise."""
    q = G.canonical(F.col("pred"), 1000.0, 1000.0)
    return boxes(spark, sf_dir).select("id", R6(q[0]["x"] - F.col("d")).alias("x0"), R6(q[0]["y"] - F.col("d")).alias("y0"))


@query(f"SELECT id, round(x1, 6) AS x0, round(y1, 6) AS y0, round(x2, 6) AS x1, round(y1, 6) AS y1 FROM {BOXES}")
def corners_top_left(spark, sf_dir):
    q = G.by_sum_and_difference(G.top_left_first(F.col("pred")))
    d = F.col("d")
    return boxes(spark, sf_dir).select("id", R6(q[0]["x"] - d).alias("x0"), R6(q[0]["y"] - d).alias("y0"), R6(q[1]["x"] - d).alias("x1"), R6(q[1]["y"] - d).alias("y1"))


PAD = "CAST(trunc(greatest(0.0, least({c} * 1000 + 5e-4, 1000.0))) AS INTEGER)"


@query(f"SELECT id, {PAD.format(c='(x1 - (x2 - x1) * 0.5)')} AS left, {PAD.format(c='(y1 - (y2 - y1) * 0.5)')} AS top, {PAD.format(c='(x2 + (x2 - x1) * 0.5)')} AS right, {PAD.format(c='(y2 + (y2 - y1) * 0.5)')} AS bottom FROM {BOXES}".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))
def padded_bbox(spark, sf_dir):
    box = G.padded_box(F.col("true"), 1000, 1000, 0.5)
    return boxes(spark, sf_dir).select("id", *[b.alias(n) for b, n in zip(box, ("left", "top", "right", "bottom"), strict=True)])


@query(f"SELECT id, round((100 + x1 * 300) / 1000, 6) AS x0, round((50 + y1 * 400) / 800, 6) AS y0 FROM {BOXES}")
def crop_to_full(spark, sf_dir):
    q = G.crop_to_full(F.col("true"), [F.lit(v) for v in (100.0, 50.0, 400.0, 450.0)], 1000.0, 800.0)
    return boxes(spark, sf_dir).select("id", R6(q[0]["x"]).alias("x0"), R6(q[0]["y"]).alias("y0"))


@query(f"SELECT id, round(x1 * 1000, 4) AS px, round(y1 * 800, 4) AS py FROM {BOXES}")
def corners_pixel(spark, sf_dir):
    q = G.to_pixels(F.col("true"), 1000.0, 800.0)
    return boxes(spark, sf_dir).select("id", F.round(q[0]["x"], 4).alias("px"), F.round(q[0]["y"], 4).alias("py"))


@query(f"SELECT id, round(y1, 5) AS x0, round(1 - x1, 5) AS y0 FROM {BOXES}")
def rotate_points(spark, sf_dir):
    """A quarter turn about the middle."""
    q = G.rotate_points(F.col("true"), F.lit(90.0), 0.5, 0.5)
    return boxes(spark, sf_dir).select("id", F.round(q[0]["x"], 5).alias("x0"), F.round(q[0]["y"], 5).alias("y0"))


@query(f"SELECT id, round((2 * x1 + 0.1) / (0.5 * x1 + 1), 6) AS x0, round(3 * y1 / (0.5 * x1 + 1), 6) AS y0 FROM {BOXES}")
def apply_homography(spark, sf_dir):
    q = G.apply_homography(F.col("true"), [F.lit(v) for v in (2.0, 0.0, 0.1, 0.0, 3.0, 0.0, 0.5, 0.0, 1.0)])
    return boxes(spark, sf_dir).select("id", R6(q[0]["x"]).alias("x0"), R6(q[0]["y"]).alias("y0"))


@query(f"SELECT id, round((w - 4 * least(w / 4, h / 3)) / 2, 6) AS x, round((h - 3 * least(w / 4, h / 3)) / 2, 6) AS y FROM (SELECT id, (640 + k % 300)::DOUBLE AS w, (480 + k % 200)::DOUBLE AS h FROM {BOXES})")
def cover_crop(spark, sf_dir):
    w, h = (640 + F.col("k") % 300).cast("double"), (480 + F.col("k") % 200).cast("double")
    box = G.cover_crop(w, h, 400.0, 300.0)
    return boxes(spark, sf_dir).select("id", R6(box[0]).alias("x"), R6(box[1]).alias("y"))


@query(f"SELECT id, round(x1 * y1 / (greatest(x1, x2) * greatest(y1, y2)), 6) AS low, 1.0::DOUBLE AS most FROM {BOXES}")
def outer_product(spark, sf_dir):
    blob = G.outer_product(F.array("x1", "x2"), F.array("y1", "y2"))
    return boxes(spark, sf_dir).select("id", R6(blob[0][0]).alias("low"), R6(F.array_max(F.flatten(blob))).alias("most"))
