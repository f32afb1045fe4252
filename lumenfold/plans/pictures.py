"""Pictures, heatmaps, homographies and views: embeddings serve as grey pictures of 8 x 8 pixels, line items as matches and corners."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lumenfold.functions import augment, codecs, heatmaps, pixels
from lumenfold.functions import geometry as G
from lumenfold.operators import homography, margin
from lumenfold.plans.base import registrar
from lumenfold.plans.shapes import BOXES, boxes
from lumenfold.sources import table
from lumenfold.sources.scratch import scratch

REGISTRY: dict[str, tuple] = {}
query = registrar(REGISTRY)

R6 = lambda c: F.round(c, 6) + 0.0  # noqa: E731  never a negative zero
S6 = lambda e: f"round({e}, 6) + 0.0"
PICTURES = "(SELECT vec_id, label, embedding::DOUBLE[] AS p FROM embeddings WHERE embedding IS NOT NULL)"
SIDE = lambda: F.lit(8)


def pictures(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("p"))


# --- homographies -----------------------------------------------------------------------------------------------------

# Corners of four sides that aren't parallel.
CORNERS = (("x1", "y1"), ("x2", "y1 + 0.02 * (k % 3)"), ("x2 + 0.03 * (k % 2)", "y2"), ("x1 + d", "y2 - 0.01 * (k % 5)"))
SQUARE_SQL = """
  d AS (SELECT *, (u1 - u2) * (v3 - v2) - (u3 - u2) * (v1 - v2) AS det, u0 - u1 + u2 - u3 AS su, v0 - v1 + v2 - v3 AS sv FROM q),
  g AS (SELECT *, (su * (v3 - v2) - (u3 - u2) * sv) / det AS g, ((u1 - u2) * sv - su * (v1 - v2)) / det AS h FROM d),
  m AS (SELECT *, u1 - u0 + g * u1 AS a, u3 - u0 + h * u3 AS b, v1 - v0 + g * v1 AS c, v3 - v0 + h * v3 AS e FROM g)"""


@query(f"""WITH q AS (SELECT id, {', '.join(f'{x} AS u{i}, {y} AS v{i}' for i, (x, y) in enumerate(CORNERS))} FROM {BOXES}), {SQUARE_SQL}
  SELECT id, {S6('a / 63')} AS h0, {S6('b / 87')} AS h1, {S6('u0')} AS h2, {S6('c / 63')} AS h3, {S6('e / 87')} AS h4, {S6('v0')} AS h5, {S6('g / 63')} AS h6, {S6('h / 87')} AS h7 FROM m""")
def homography_four_points(spark, sf_dir):
    target = G.quad(*[F.expr(e).cast("double") for xy in CORNERS for e in xy])
    source = G.quad(*[F.lit(float(c)) for c in (0, 0, 63, 0, 63, 87, 0, 87)])
    made = G.with_quad_to_quad(boxes(spark, sf_dir).select("id", target.alias("target")), source, F.col("target"))
    return made.select("id", *[R6(F.col(f"h{i}")).alias(f"h{i}") for i in range(8)])


PLANTED = ("1 + 0.01 * (s % 5)", "0.02 * (s % 3)", "3.0 * (s % 7)", "-0.015 * (s % 4)", "0.95 + 0.01 * (s % 6)", "2.0 * (s % 5)", "0.0001 * (s % 3)", "0.00005 * (s % 4)")
OUTLIER = "(l_linenumber + l_orderkey) % 5 < 2"


@query(f"SELECT s AS l_suppkey, {', '.join(f'any_value({S6(e)}) AS h{i}' for i, e in enumerate(PLANTED))}, count(*) AS matches, count(*) FILTER (NOT ({OUTLIER})) AS inliers FROM (SELECT l_suppkey AS s, l_linenumber, l_orderkey FROM lineitem) GROUP BY s")
def homography_planted(spark, sf_dir):
    """Matches of each supplier under a map of its own, two fifths of them wrong: the map is found again."""
    lines = table(spark, sf_dir, "lineitem").withColumn("s", F.col("l_suppkey"))
    points = lines.select("l_suppkey", "s", "l_partkey", F.expr(OUTLIER).alias("wrong"), (F.col("l_partkey") * 37 % 640).cast("double").alias("x"), ((F.col("l_orderkey") * 17 + F.col("l_linenumber") * 91) % 480).cast("double").alias("y"))
    # doubles from the literals on: decimals of SQL cost most of a match's time
    h = [F.expr(re.sub(r"\d+\.\d+", r"\g<0>D", e)).cast("double") for e in PLANTED]
    w = h[6] * F.col("x") + h[7] * F.col("y") + 1
    u, v = (h[0] * F.col("x") + h[1] * F.col("y") + h[2]) / w, (h[3] * F.col("x") + h[4] * F.col("y") + h[5]) / w
    off = F.when(F.col("wrong"), 40 + 7 * (F.col("l_partkey") % 31)).otherwise(0)
    found = homography.fit_homographies(points.select("l_suppkey", "x", "y", (u + off).alias("u"), (v - off).alias("v")), "l_suppkey", F.col("x"), F.col("y"), F.col("u"), F.col("v"))
    return found.select("l_suppkey", *[R6(F.col("h")[i]).alias(f"h{i}") for i in range(8)], "matches", "inliers")


# --- pictures ---------------------------------------------------------------------------------------------------------

FRAME = (("0.05 * (vec_id % 4)", "0.03 * (vec_id % 5)"), ("1 - 0.04 * (vec_id % 3)", "0.02 * (vec_id % 7)"), ("0.97", "1 - 0.05 * (vec_id % 2)"), ("0.02 * (vec_id % 6)", "0.95"))


@query(f"""WITH q AS (SELECT vec_id, p, {', '.join(f'8 * ({x}) AS u{i}, 8 * ({y}) AS v{i}' for i, (x, y) in enumerate(FRAME))} FROM {PICTURES}), {SQUARE_SQL},
  o AS (SELECT vec_id, p, place, a * (place % 5) / 5 + b * (place // 5) / 6 + u0 AS un, c * (place % 5) / 5 + e * (place // 5) / 6 + v0 AS vn, g * (place % 5) / 5 + h * (place // 5) / 6 + 1 AS wn FROM m, range(30) AS r(place)),
  t AS (SELECT vec_id, place, p, un / wn AS x, vn / wn AS y, dx, dy FROM o, range(2) AS tx(dx), range(2) AS ty(dy)),
  k AS (SELECT vec_id, place, p, floor(x) + dx AS px, floor(y) + dy AS py, abs(1 - dx - (x - floor(x))) * abs(1 - dy - (y - floor(y))) AS weight FROM t)
  SELECT vec_id, place::INTEGER AS place, {S6('sum(CASE WHEN px BETWEEN 0 AND 7 AND py BETWEEN 0 AND 7 THEN weight * p[(py * 8 + px)::INTEGER + 1] ELSE 0 END)')} AS value FROM k GROUP BY vec_id, place""")
def dewarped_pixels(spark, sf_dir):
    corners = G.quad(*[F.expr(e).cast("double") for xy in FRAME for e in xy])
    flat = pictures(spark, sf_dir).select("vec_id", pixels.dewarp(F.col("p"), SIDE(), SIDE(), corners, 5, 6).alias("made"))
    return flat.select("vec_id", F.posexplode("made").alias("place", "value")).select("vec_id", "place", R6(F.col("value")).alias("value"))


@query(f"""WITH p AS (SELECT vec_id, p, row // 8 AS y, row % 8 AS x, p[row + 1] AS v FROM {PICTURES}, range(64) AS r(row)),
  a AS (SELECT vec_id, string_agg(CASE WHEN round(v, 9) > round(m, 9) THEN '1' ELSE '0' END, '' ORDER BY y, x) AS average FROM (SELECT *, avg(v) OVER (PARTITION BY vec_id) AS m FROM p) GROUP BY vec_id),
  s AS (SELECT vec_id, i, x, round(sum(v * greatest(0, least((i + 1) * 8 / 7, y + 1) - greatest(i * 8 / 7, y))) / (8 / 7), 9) AS v FROM p, range(7) AS r(i) GROUP BY vec_id, i, x),
  d AS (SELECT b.vec_id, string_agg(CASE WHEN b.v > a.v THEN '1' ELSE '0' END, '' ORDER BY b.i, b.x) AS difference FROM s a JOIN s b ON a.vec_id = b.vec_id AND a.i = b.i AND b.x = a.x + 1 GROUP BY b.vec_id),
  f AS (SELECT vec_id, i, j, round(sum(4 * v * cos(pi() * i * (2 * y + 1) / 16) * cos(pi() * j * (2 * x + 1) / 16)), 9) AS v FROM p, range(4) AS r(i), range(4) AS c(j) GROUP BY vec_id, i, j),
  c AS (SELECT vec_id, string_agg(CASE WHEN v > m THEN '1' ELSE '0' END, '' ORDER BY i, j) AS cosine FROM (SELECT *, median(v) OVER (PARTITION BY vec_id) AS m FROM f) GROUP BY vec_id)
  SELECT vec_id, average, difference, cosine FROM a JOIN d USING (vec_id) JOIN c USING (vec_id)""")
def picture_hashes(spark, sf_dir):
    made = lambda kind, size, **options: pixels.picture_hash(F.col("p"), SIDE(), SIDE(), kind, size, **options).alias(kind)
    packed = pictures(spark, sf_dir).select("vec_id", made("average", 8), made("difference", 7), made("cosine", 4, factor=2))
    return packed.select("vec_id", *[pixels.bits_text(F.col(kind), bits).alias(kind) for kind, bits in (("average", 64), ("difference", 49), ("cosine", 16))])


@query(f"""WITH p AS (SELECT vec_id, p, (row // 8)::INTEGER AS y, (row % 8)::INTEGER AS x FROM {PICTURES}, range(64) AS r(row)),
  l AS (SELECT vec_id, p[y * 8 + CASE x WHEN 0 THEN 1 ELSE x - 1 END + 1] + p[y * 8 + CASE x WHEN 7 THEN 6 ELSE x + 1 END + 1] + p[CASE y WHEN 0 THEN 1 ELSE y - 1 END * 8 + x + 1] + p[CASE y WHEN 7 THEN 6 ELSE y + 1 END * 8 + x + 1] - 4 * p[y * 8 + x + 1] AS v FROM p),
  s AS (SELECT vec_id, var_pop(v) AS score FROM l GROUP BY vec_id)
  SELECT vec_id, {S6('score')} AS score, score >= 0.3 AS kept FROM s""")
def blur_scores(spark, sf_dir):
    scored = pictures(spark, sf_dir).select("vec_id", pixels.blur_score(F.col("p"), SIDE(), SIDE()).alias("score"))
    return scored.select("vec_id", R6(F.col("score")).alias("score"), pixels.sharp_enough(F.col("score"), 0.3).alias("kept"))


@query(f"""WITH bits AS (SELECT vec_id, list_transform(p, lambda x: x > 0) AS b FROM {PICTURES})
  SELECT a.vec_id, len(list_filter(range(1, 65), lambda i: a.b[i] <> b.b[i])) AS distance FROM bits a JOIN bits b ON b.vec_id = a.vec_id + 1""")
def cached_bits_hamming(spark, sf_dir):
    """Bits written to a cache, packed with a header, and compared straight from it: each picture with the next."""
    packed = F.unhex(F.lpad(F.hex(F.conv(F.concat_ws("", F.transform("p", lambda x: (x > 0).cast("int").cast("string"))), 2, -10).cast("bigint")), 16, "0"))
    where = scratch(spark, "bits")
    pictures(spark, sf_dir).where("size(p) = 64").select("vec_id", codecs.described(packed, "bits", 64, "sign")).write.parquet(f"{where}/cache")
    cache = spark.read.parquet(f"{where}/cache")
    n = cache.schema["bits"].metadata["packed_bits"]
    after = cache.select((F.col("vec_id") - 1).alias("vec_id"), F.col("bits").alias("next"))
    return cache.join(after, "vec_id").select("vec_id", codecs.hamming(F.col("bits"), F.col("next"), n).cast("bigint").alias("distance"))


@query("SELECT l_orderkey, count(*) AS n, sum(l_partkey % 640)::DOUBLE AS x, sum(l_quantity / 4) AS size, sum(l_linenumber)::BIGINT AS octaves FROM lineitem GROUP BY l_orderkey")
def keypoint_records(spark, sf_dir):
    """An order's lines as keypoint records, packed and unpacked again."""
    point = F.struct(
        (F.col("l_partkey") % 640).cast("float").alias("x"), F.lit(0.5).cast("float").alias("y"), (F.col("l_quantity") / 4).cast("float").alias("size"), F.lit(-1.0).cast("float").alias("angle"),
        F.lit(0.25).cast("float").alias("response"), F.col("l_linenumber").alias("octave"), F.lit(None).cast("int").alias("class_id"),
    )
    packed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(point).alias("points")).select("l_orderkey", codecs.pack_keypoints("points").alias("packed"))
    total = lambda name: F.aggregate("points", F.lit(0.0), lambda t, p: t + p[name])
    back = packed.select("l_orderkey", codecs.unpack_keypoints("packed").alias("points"))
    return back.select("l_orderkey", F.size("points").cast("bigint").alias("n"), total("x").alias("x"), total("size").alias("size"), total("octave").cast("bigint").alias("octaves"))


# --- heads ------------------------------------------------------------------------------------------------------------

# A vector on its own class has a sine near 1e-8, known to no more digits than that.
R4 = lambda c: F.round(c, 4) + 0.0
S4 = lambda e: f"round({e}, 4) + 0.0"


@query(f"""WITH w AS (SELECT label AS class, arg_min(p, vec_id) AS w FROM {PICTURES} WHERE label IS NOT NULL GROUP BY label),
  c AS (SELECT vec_id, label, class, list_cosine_similarity(p, w) AS c FROM {PICTURES} v, w WHERE label IS NOT NULL),
  l AS (SELECT *, 30 * CASE WHEN class <> label THEN c WHEN c > cos(pi() - 0.3) THEN c * cos(0.3) - sqrt(greatest(0, 1 - c * c)) * sin(0.3) ELSE c - sin(pi() - 0.3) * 0.3 END AS logit FROM c)
  SELECT vec_id, label, {S4('max(c) FILTER (class = label)')} AS cosine, {S4('max(logit) FILTER (class = label)')} AS logit, {S4('30 + ln(sum(exp(logit - 30))) - max(logit) FILTER (class = label)')} AS loss FROM l GROUP BY vec_id, label""")
def margin_losses(spark, sf_dir):
    """Loss of every vector against classes that stand for their first vector, met in blocks of three classes."""
    vectors = pictures(spark, sf_dir)
    classes = vectors.where("label is not null").groupBy(F.col("label").alias("class")).agg(F.min_by("p", "vec_id").alias("w"))
    found = margin.margin_loss(vectors, classes, id_col="vec_id", label_col="label", vector_col="p", class_col="class", weight_col="w", settings=margin.Settings(classes=3))
    return found.select("vec_id", "label", *[R4(F.col(c)).alias(c) for c in ("cosine", "logit", "loss")])


@query(f"""WITH p AS (SELECT vec_id, (row % 8)::INTEGER AS x, (row // 8)::INTEGER AS y, 30 * p[row + 1] AS z, exp(-((row % 8 - vec_id % 8) ** 2 + (row // 8 - 8 * (vec_id % 5) / 5) ** 2) / 4.5) AS t FROM {PICTURES}, range(64) AS r(row)),
  m AS (SELECT vec_id, sum(exp(z) * (x + 0.5) / 8) / sum(exp(z)) AS x, sum(exp(z) * (y + 0.5) / 8) / sum(exp(z)) AS y, avg(greatest(z, 0) - z * t + ln(1 + exp(-abs(z)))) AS map_loss FROM p GROUP BY vec_id),
  s AS (SELECT vec_id, x, z, exp(-0.5 * ((x - 7 * (vec_id % 8) / 8) / 1.5) ** 2) AS b FROM p WHERE y = 0),
  a AS (SELECT vec_id, x, z, b / sum(b) OVER (PARTITION BY vec_id) AS t, z - ln(sum(exp(z)) OVER (PARTITION BY vec_id)) AS lp FROM s),
  c AS (SELECT vec_id, sum(exp(z) * x / 7) / sum(exp(z)) AS axis, sum(t * (ln(t) - lp)) AS axis_loss FROM a GROUP BY vec_id)
  SELECT vec_id, {S6('m.x')} AS x, {S6('m.y')} AS y, {S6('map_loss')} AS map_loss, {S6('axis')} AS axis, {S6('axis_loss')} AS axis_loss FROM m JOIN c USING (vec_id)""")
def heatmap_corners(spark, sf_dir):
    """Embeddings as heatmaps of logits: decoded corners and losses against a corner that the id gives."""
    logits = F.transform("p", lambda v: 30 * v)
    at_x, at_y = F.col("vec_id") % 8 / 8, F.col("vec_id") % 5 / 5
    maps = pictures(spark, sf_dir).select("vec_id", logits.alias("z"), F.slice(logits, 1, 8).alias("row"))
    corner = heatmaps.soft_argmax(F.col("z"), 8)
    loss = heatmaps.map_loss(F.col("z"), heatmaps.gaussian_map(at_x, at_y, 8, 8, 1.5))
    axis_loss = heatmaps.axis_loss(F.col("row"), heatmaps.gaussian_axis(at_x, 8, 1.5))
    return maps.select("vec_id", R6(corner["x"]).alias("x"), R6(corner["y"]).alias("y"), R6(loss).alias("map_loss"), R6(heatmaps.axis_mean(F.col("row"))).alias("axis"), R6(axis_loss).alias("axis_loss"))


DRAW = lambda name: f"(('0x' || substr(md5('7|' || id || '|2|{name}'), 1, 13))::BIGINT / 16.0::DOUBLE ** 13)"
BOX4 = (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))


@query(f"""WITH a AS (SELECT *, 360 * {DRAW('degrees')} AS deg, 0.6 + 0.4 * {DRAW('crop_w')} AS w, 0.6 + 0.4 * {DRAW('crop_h')} AS h FROM {BOXES}),
  t AS (SELECT id, deg, w, h, {', '.join(f'0.5 + ({x} - 0.5) * cos(radians(deg)) + ({y} - 0.5) * sin(radians(deg)) AS tx{i}, 0.5 - ({x} - 0.5) * sin(radians(deg)) + ({y} - 0.5) * cos(radians(deg)) AS ty{i}, {x} AS ox{i}, {y} AS oy{i}' for i, (x, y) in enumerate(BOX4))} FROM a),
  f AS (SELECT *, deg > 0.5 AND {' AND '.join(f'tx{i} BETWEEN 0 AND 1 AND ty{i} BETWEEN 0 AND 1' for i in range(4))} AS turned FROM t),
  c AS (SELECT id, deg, turned, {', '.join(f'(CASE WHEN turned THEN tx{i} ELSE ox{i} END - (1 - w) * {DRAW("crop_x")}) / w AS x{i}, (CASE WHEN turned THEN ty{i} ELSE oy{i} END - (1 - h) * {DRAW("crop_y")}) / h AS y{i}' for i in range(4))} FROM f)
  SELECT id, {S6('deg')} AS degrees, turned, {S6('x0')} AS x0, {S6('y2')} AS y2, {' + '.join(f'(x{i} BETWEEN 0 AND 1 AND y{i} BETWEEN 0 AND 1)::INTEGER' for i in range(4))} AS visible FROM c""")
def augmented_corners(spark, sf_dir):
    """Epoch 2 of seed 7: boxes turned where they stay whole, then cropped; which corners the crop still shows."""
    key = augment.draw_key(7, F.col("id"), F.lit(2))
    rows = boxes(spark, sf_dir).select("id", "true").withColumn("t", augment.turned(F.col("true"), key))
    rows = rows.withColumn("c", augment.cropped(F.col("t.corners"), augment.crop_box(key)))
    visible = F.size(F.filter("c", lambda p: p["visible"]))
    return rows.select("id", R6(F.col("t.degrees")).alias("degrees"), F.col("t.applied").alias("turned"), R6(F.col("c")[0]["x"]).alias("x0"), R6(F.col("c")[2]["y"]).alias("y2"), visible.alias("visible"))
