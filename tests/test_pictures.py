"""Pictures, heatmaps, homographies, margin loss, codecs and augmentation against numpy and plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import augment, codecs, heatmaps, pixels
from lumenfold.functions import geometry as G
from lumenfold.operators import homography, margin


def picture(spark, *images):
    rows = [(i, None if x is None else np.asarray(x, float).ravel().tolist(), None if x is None else x.shape[0], None if x is None else x.shape[1]) for i, x in enumerate(images)]
    return spark.createDataFrame(rows, "n int, p array<double>, h int, w int")


def quads(*corners):
    return [[{"x": float(x), "y": float(y)} for x, y in q] if q is not None else None for q in corners]


P, H, W = (lambda: F.col("p")), (lambda: F.col("h")), (lambda: F.col("w"))
WHOLE = [(0, 0), (1, 0), (1, 1), (0, 1)]


def dewarped(spark, image, corners, to_width, to_height, channels=1):
    rows = [(image.ravel().tolist(), image.shape[0], image.shape[1], c) for c in quads(*corners)]
    df = spark.createDataFrame(rows, "p array<double>, h int, w int, q array<struct<x:double,y:double>>")
    return [r.d for r in df.select(pixels.dewarp(P(), H(), W(), F.col("q"), to_width, to_height, channels).alias("d")).collect()]


def test_dewarp_keeps_quadrants(spark):
    """Quadrants of four colours: the whole picture, and each quadrant cut out by its corners."""
    image = np.zeros((100, 100, 3))
    colours = {"tl": (255, 0, 0), "tr": (0, 255, 0), "br": (0, 0, 255), "bl": (0, 255, 255)}
    image[:50, :50], image[:50, 50:], image[50:, 50:], image[50:, :50] = (colours[k] for k in ("tl", "tr", "br", "bl"))
    turned = [(1, 0), (1, 1), (0, 1), (0, 0)]
    whole, quarter, quarter_turn = dewarped(spark, image, [WHOLE, [(0.5, 0.5), (1, 0.5), (1, 1), (0.5, 1)], turned], 24, 36, 3)
    whole = np.reshape(whole, (36, 24, 3))
    for part, colour in ((whole[:17, :11], "tl"), (whole[:17, 13:], "tr"), (whole[19:, 13:], "br"), (whole[19:, :11], "bl")):
        assert np.allclose(part.mean(axis=(0, 1)), colours[colour], atol=1)
    assert np.allclose(np.reshape(quarter, (36, 24, 3))[1:-1, 1:-1], colours["br"])
    # its first row lies one pixel behind the picture's last
    assert np.allclose(np.reshape(quarter_turn, (36, 24, 3))[1:17, :11].mean(axis=(0, 1)), colours["tr"], atol=1)


def test_dewarp_of_the_whole_picture_and_odd_rows(spark):
    image = np.random.default_rng(1).integers(0, 255, (10, 15)).astype(float)
    same, none, flat, short = dewarped(spark, image, [WHOLE, None, [(0, 0), (0.5, 0.5), (1, 1), (0.2, 0.2)], WHOLE[:3]], 15, 10)
    assert np.allclose(same, image.ravel()) and none is flat is short is None
    df = picture(spark, None, image).withColumn("w", F.col("w") + 1)
    assert all(r.b is None for r in df.select(pixels.blur_score(P(), H(), W()).alias("b")).collect())


def test_dewarp_under_perspective_equals_sampling_one_by_one(spark):
    rng = np.random.default_rng(2)
    image = rng.random((9, 7))
    corners = [(0.1, 0.05), (0.9, 0.2), (1.1, 0.95), (-0.1, 0.8)]
    (got,) = dewarped(spark, image, [corners], 6, 5)
    target = np.array(corners) * (7, 9)
    a, b = [], []
    for (x, y), (u, v) in zip([(0, 0), (6, 0), (6, 5), (0, 5)], target, strict=True):
        a += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        b += [u, v]
    h = np.append(np.linalg.solve(np.array(a, float), np.array(b)), 1).reshape(3, 3)
    pixel = lambda x, y: image[y, x] if 0 <= x < 7 and 0 <= y < 9 else 0.0
    for n, value in enumerate(got):
        u, v, w = h @ (n % 6, n // 6, 1)
        u, v = u / w, v / w
        x, y = math.floor(u), math.floor(v)
        want = sum(pixel(x + i, y + j) * abs(1 - i - (u - x)) * abs(1 - j - (v - y)) for i in (0, 1) for j in (0, 1))
        assert abs(want - value) < 1e-9


def test_hashes_equal_their_definitions(spark):
    rng = np.random.default_rng(3)
    images = [rng.random((32, 32)) * 255, rng.random((32, 32)), np.full((32, 32), 7.0)]
    kinds = ("average", "difference", "cosine", "wavelet")
    df = picture(spark, *images, None).select("n", *[pixels.picture_hash(P(), H(), W(), k, 8).alias(k) for k in kinds])
    got = {r.n: r for r in df.collect()}
    assert all(got[3][k] is None for k in kinds)
    bits = lambda packed, n: np.unpackbits(np.frombuffer(packed, np.uint8))[:n].astype(bool)
    for n, image in enumerate(images):
        small = image.reshape(8, 4, 8, 4).mean(axis=(1, 3))
        assert (bits(got[n].average, 64) == (np.round(small, 9) > np.round(small.mean(), 9)).ravel()).all()
        c = np.array([[2 * math.cos(math.pi * k * (2 * j + 1) / 64) for j in range(32)] for k in range(8)])
        low = np.round(c @ image @ c.T, 9)
        assert (bits(got[n].cosine, 64) == (low > np.median(low)).ravel()).all()
        x = image
        for _ in range(2):  # the definition of the wavelet's low-pass: mirrored ends, every second place
            x = np.array([_low(row) for row in np.array([_low(c) for c in x.T]).T])
        x = np.round(x, 9)
        assert (bits(got[n].wavelet, x.size) == (x > np.median(x)).ravel()).all()
    assert not bits(got[2].difference, 64).any() and bits(got[0].difference, 64).any()


def _low(signal):
    n = len(signal)
    at = lambda i: signal[i % (2 * n)] if i % (2 * n) < n else signal[2 * n - 1 - i % (2 * n)]
    return [sum(tap * at(2 * i + 1 - j) for j, tap in enumerate(pixels.DB4)) for i in range((n + 7) // 2)]


def test_wavelet_taps_are_orthonormal():
    taps = np.array(pixels.DB4)
    assert abs(taps.sum() - math.sqrt(2)) < 1e-9
    assert all(abs((taps[: 8 - 2 * k] * taps[2 * k :]).sum() - (k == 0)) < 1e-9 for k in range(4))
    high = taps[::-1] * (-1) ** np.arange(8)
    assert all(abs((high * np.arange(8) ** p).sum()) < 1e-6 for p in range(4))  # four vanishing moments


def test_bits_and_their_cache(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, bytes(rng.randrange(256) for _ in range(13))) for i in range(40)] + [(90, None), (91, b"short")]
    df = spark.createDataFrame(rows, "n int, b binary")
    df.select("n", codecs.described(F.col("b"), "b", 100, "f1")).write.parquet(str(tmp_path / "cache"))
    cache = spark.read.parquet(str(tmp_path / "cache"))
    assert cache.schema["b"].metadata == {"packed_bits": 100, "fingerprint": "f1"} and dict(cache.dtypes)["b"] == "binary"
    one = F.lit(bytearray(rows[0][1]))
    got = {r.n: r.d for r in cache.select("n", codecs.hamming(F.col("b"), one, 100).alias("d")).collect()}
    assert got == {n: sum((x ^ y).bit_count() for x, y in zip(b, rows[0][1], strict=True)) if b and len(b) == 13 else None for n, b in rows}
    text = {r.n: r.t for r in df.where("n < 40").select("n", pixels.bits_text(F.col("b"), 101).alias("t")).collect()}
    assert all(text[n] == "".join(f"{x:08b}" for x in b)[:101] for n, b in rows[:40])


def test_keypoints_round_trip(spark):
    points = [[(1.5, 2.25, 3.0, -1.0, 0.5, 257, -1), (0.0, -4.0, 1e9, 359.5, 0.0, -3, 7)], [], None, [(1.0, None, 1.0, 1.0, 1.0, None, None)]]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(points)], f"n int, p {codecs.KEYPOINT.simpleString()}").select("n", codecs.pack_keypoints("p").alias("b"))
    sizes = {r.n: r.b and len(r.b) for r in df.collect()}
    assert sizes == {0: 64, 1: 8, 2: None, 3: 36}
    odd = spark.createDataFrame([(4, b"KP1\0\x02\0\0\0"), (5, b"other"), (6, b"")], "n int, b binary")
    got = {r.n: r.p and [tuple(k) for k in r.p] for r in df.unionByName(odd).select("n", codecs.unpack_keypoints("b").alias("p")).collect()}
    assert got == {0: points[0], 1: [], 2: None, 3: [(1.0, 0.0, 1.0, 1.0, 1.0, 0, -1)], 4: None, 5: None, 6: None}


# --- homographies -----------------------------------------------------------------------------------------------------


def planted(spark, groups, share, noise=0.0, seed=4):
    rng = np.random.default_rng(seed)
    rows, maps = [], {}
    for g, n in groups.items():
        h = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1]]) + rng.normal(0, 1, (3, 3)) * [[0.2, 0.2, 30], [0.2, 0.2, 30], [2e-4, 2e-4, 0]]
        maps[g] = h / h[2, 2]
        xy = rng.random((n, 2)) * (640, 480)
        u, v, w = maps[g] @ np.concatenate([xy, np.ones((n, 1))], axis=1).T
        uv = np.stack([u / w, v / w], axis=1) + rng.normal(0, noise, (n, 2)) * (noise > 0)
        wrong = rng.permutation(n) < share * n
        uv[wrong] = rng.random((wrong.sum(), 2)) * 2000 - 500
        rows += [(g, *map(float, p), *map(float, q)) for p, q in zip(xy, uv, strict=True)]
    return rows, maps


SCHEMA = "g string, x double, y double, u double, v double"
FIT = lambda df, s=homography.Settings(): {r.g: r for r in homography.fit_homographies(df, "g", *[F.col(c) for c in "xyuv"], s).collect()}


def test_maps_are_found_among_outliers(spark):
    rows, maps = planted(spark, {"a": 40, "b": 300, "c": 6000, "d": 12}, 0.4)
    got = FIT(spark.createDataFrame(rows, SCHEMA).repartition(5))
    for g, h in maps.items():
        assert np.allclose(np.array(got[g].h).reshape(3, 3), h, rtol=1e-6, atol=1e-7), g
        n = sum(r[0] == g for r in rows)
        assert got[g].matches == n and 0.6 * n - 1 <= got[g].inliers <= 0.6 * n + 3 + 0.001 * n and got[g].miss < 1e-3 + got[g].inliers
    again = FIT(spark.createDataFrame(rows[::-1], SCHEMA).repartition(2))
    assert all(np.allclose(again[g].h, got[g].h, rtol=1e-9) and again[g].inliers == got[g].inliers for g in maps)


def test_noisy_maps(spark):
    rows, maps = planted(spark, {"a": 400}, 0.3, noise=0.5)
    got = FIT(spark.createDataFrame(rows, SCHEMA))["a"]
    corners = np.array([(0, 0, 1), (640, 0, 1), (640, 480, 1), (0, 480, 1)], float).T
    project = lambda h: (h @ corners)[:2] / (h @ corners)[2]
    assert np.abs(project(np.array(got.h).reshape(3, 3)) - project(maps["a"])).max() < 1.5 and 260 <= got.inliers <= 285 and 0.3 < got.miss < 1.2


def test_steps_of_maps_are_done_once(spark):
    """No hypothesis is made again, nor a match copied for each, when the result is read; the map is the direct solution's."""
    rows, _ = planted(spark, {"a": 400}, 0.3, noise=0.5)
    found = homography.fit_homographies(spark.createDataFrame(rows, SCHEMA), "g", *[F.col(c) for c in "xyuv"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Generate" not in plan
    got = found.first()
    m = np.array([r[1:] for r in rows])
    inside = homography._misses(np.array([got.h]).reshape(1, 3, 3), m[:, :2], m[:, 2:])[0] <= 3
    assert inside.sum() == got.inliers and got.matches == 400


def test_groups_without_a_map(spark):
    line = [("line", float(i), 2.0 * i, 3.0 * i, float(i)) for i in range(30)]
    odd = [("few", 0.0, 0.0, 1.0, 1.0)] * 3 + [("same", 1.0, 1.0, 2.0, 2.0)] * 50 + [("nulls", None, 1.0, 1.0, 1.0), ("nulls", float("nan"), 1.0, 1.0, 1.0)]
    rng = random.Random(2)
    noise = [("noise", *[rng.random() * 1000 for _ in range(4)]) for _ in range(8)]
    none = [(None, float(x), float(y), x + 5.0, y - 2.0) for x in range(4) for y in range(4)]
    got = FIT(spark.createDataFrame(line + odd + noise + none, SCHEMA), homography.Settings(least=6))
    assert np.allclose(got[None].h, [1, 0, 5, 0, 1, -2, 0, 0, 1], atol=1e-9) and got[None].inliers == 16
    assert {g: got[g].matches for g in ("few", "same", "nulls", "line", "noise")} == {"few": 3, "same": 50, "nulls": 0, "line": 30, "noise": 8}
    assert all(got[g].h is None and got[g].inliers == 0 and got[g].miss is None for g in ("few", "same", "nulls", "line", "noise"))
    assert FIT(spark.createDataFrame([], SCHEMA)) == {}


def test_four_points_equal_a_solver(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(30):
        source, target = (np.array(WHOLE) * 10 + rng.normal(0, 1.5, (4, 2)) for _ in range(2))
        rows.append((i, source, target))
    df = spark.createDataFrame([(i, *quads(s, t)) for i, s, t in rows], "n int, s array<struct<x:double,y:double>>, t array<struct<x:double,y:double>>")
    h = G.quad_to_quad(F.col("s"), F.col("t"))
    got = {r.n: np.array(r.h).reshape(3, 3) for r in df.select("n", F.array(*h).alias("h")).collect()}
    for i, s, t in rows:
        u, v, w = got[i] @ np.concatenate([s, np.ones((4, 1))], axis=1).T
        assert np.allclose(np.stack([u / w, v / w], axis=1), t) and np.allclose(homography.four_point_maps(s[None], t[None])[0], got[i])


# --- heads ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("classes, rows", [(2048, 4096), (2, 3)])
def test_margin_loss(spark, classes, rows):
    rng = np.random.default_rng(6)
    w, v, labels = rng.normal(size=(7, 5)), rng.normal(size=(40, 5)), rng.integers(0, 7, 40)
    v[0], v[1] = -w[labels[0]], w[labels[1]]  # behind the turning point, and on the class itself
    table = [(i, int(y), x.tolist()) for i, (x, y) in enumerate(zip(v, labels, strict=True))]
    df = spark.createDataFrame([*table, table[3], (90, 99, v[0].tolist()), (91, None, v[0].tolist()), (92, 1, None)], "id long, label int, v array<double>")
    cls = spark.createDataFrame([*[(i, x.tolist()) for i, x in enumerate(w)], (None, w[0].tolist())], "class int, w array<double>")
    got = {r.id: r for r in margin.margin_loss(df, cls, id_col="id", label_col="label", vector_col="v", class_col="class", weight_col="w", settings=margin.Settings(classes=classes, rows=rows)).collect()}
    assert set(got) == set(range(40))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    for i, (c, y) in enumerate(zip(unit(v) @ unit(w).T, labels, strict=True)):
        own = c[y]
        c[y] = math.cos(math.acos(min(1, max(-1, own))) + 0.3) if own > math.cos(math.pi - 0.3) else own - 0.3 * math.sin(0.3)
        logits = 30 * c
        loss = np.log(np.exp(logits - logits.max()).sum()) + logits.max() - logits[y]
        assert abs(got[i].cosine - own) < 1e-9 and abs(got[i].logit - logits[y]) < 1e-5 and abs(got[i].loss - loss) < 1e-5


def test_heatmaps(spark):
    rng = np.random.default_rng(7)
    z, axes, corner = rng.normal(0, 300, (6, 4, 5)), rng.normal(0, 3, (6, 8, 11)), rng.random((6, 8))
    rows = [(i, z[i].ravel().tolist(), axes[i].tolist(), corner[i].tolist()) for i in range(6)] + [(6, [], [], []), (7, None, None, None)]
    df = spark.createDataFrame(rows, "n int, z array<double>, axes array<array<double>>, c array<double>")
    columns = [heatmaps.soft_argmax(F.col("z"), 5).alias("at"), heatmaps.map_loss(F.col("z"), heatmaps.gaussian_map(F.lit(0.3), F.lit(0.6), 5, 4, 2.0)).alias("map"), heatmaps.corner_loss(F.col("axes"), F.col("c"), 11, 1.5).alias("loss"), heatmaps.axis_mean(F.col("axes")[0]).alias("mean")]
    got = {r.n: r for r in df.where("n < 6").select("n", *columns).collect()}
    bell = np.exp(-((np.arange(5)[None] - 1.5) ** 2 + (np.arange(4)[:, None] - 2.4) ** 2) / 8)
    for i in range(6):
        p = np.exp(z[i] - z[i].max())
        p /= p.sum()
        assert np.allclose([got[i]["at"].x, got[i]["at"].y], [(p * (np.arange(5) + 0.5) / 5).sum(), (p * ((np.arange(4) + 0.5) / 4)[:, None]).sum()])
        assert abs(got[i]["map"] - np.mean(np.maximum(z[i], 0) - z[i] * bell + np.log1p(np.exp(-abs(z[i]))))) < 1e-9
        total = 0
        for logits, at in zip(axes[i], corner[i], strict=True):
            t = np.exp(-0.5 * ((np.arange(11) - at * 10) / 1.5) ** 2)
            t /= t.sum()
            total += (t * (np.log(t) - (logits - np.log(np.exp(logits).sum())))).sum()
        q = np.exp(axes[i][0]) / np.exp(axes[i][0]).sum()
        assert abs(got[i]["loss"] - total / 8) < 1e-9 and abs(got[i]["mean"] - (q * np.arange(11) / 10).sum()) < 1e-9
    empty = df.where("n >= 6").select(heatmaps.soft_argmax(F.col("z"), 5).alias("at")).collect()
    assert [r["at"] for r in empty] == [None, None]


def test_views_are_the_same_in_any_partitioning(spark):
    rng = np.random.default_rng(8)
    rows = [(i, *quads((np.array(WHOLE) * rng.uniform(0.1, 0.6) + rng.uniform(0.1, 0.3)).tolist())) for i in range(300)] + [(900, None)]
    df = spark.createDataFrame(rows, "id int, q array<struct<x:double,y:double>>")

    def views(frame, epoch):
        key = augment.draw_key(1, F.col("id"), F.lit(epoch))
        frame = frame.withColumn("t", augment.turned(F.col("q"), key)).withColumn("p", augment.tilted(F.col("t.corners"), key, 200, 100)).withColumn("c", augment.cropped(F.col("p.corners"), augment.crop_box(key)))
        return {r.id: r for r in frame.collect()}

    one, other, later = views(df.repartition(7), 0), views(df.orderBy(F.desc("id")), 0), views(df, 1)
    assert one == other and sum(one[i].t.degrees == later[i].t.degrees for i in one) == 0
    degrees = [one[i].t.degrees for i in one]
    assert 0 <= min(degrees) < 20 and 340 < max(degrees) < 360 and 0.3 < np.mean([one[i].t.applied for i in one]) < 1
    for i, r in one.items():
        if r.q is None:
            assert r.t.applied and r.p.applied and r.c is None
            continue
        centred = np.array([(p.x - 0.5, p.y - 0.5) for p in r.q])
        if r.t.applied:  # turning keeps distances to the centre, and corners inside
            now = np.array([(p.x - 0.5, p.y - 0.5) for p in r.t.corners])
            assert np.allclose(np.linalg.norm(now, axis=1), np.linalg.norm(centred, axis=1)) and np.abs(now).max() <= 0.5
        else:
            assert r.t.corners == r.q
        ends = np.array([(p.x, p.y) for p in r.p.ends])
        assert (ends >= 0).all() and (ends <= (199, 99)).all() and np.abs(ends - np.array([(0, 0), (199, 0), (199, 99), (0, 99)])).max() <= 35
        if r.p.applied:
            h = homography.four_point_maps(np.array([[(0, 0), (199, 0), (199, 99), (0, 99)]], float), ends[None])[0]
            u, v, w = h @ np.array([(p.x * 200, p.y * 100, 1) for p in r.t.corners]).T
            assert np.allclose([(p.x, p.y) for p in r.p.corners], np.stack([u / w / 200, v / w / 100], axis=1))
        assert all(c.visible == (0 <= c.x <= 1 and 0 <= c.y <= 1) for c in r.c)


def test_blur_score_and_keep_rule(spark):
    rng = np.random.default_rng(9)
    images = [rng.random((6, 9)) * 255, np.full((4, 4), 3.0), rng.random((1, 5))]
    df = picture(spark, *images, None).select("n", pixels.blur_score(P(), H(), W()).alias("b"))
    df = df.select("n", "b", pixels.sharp_enough(F.col("b"), 1.0).alias("kept"), pixels.sharp_enough(F.col("b"), 0).alias("all"))
    got = {r.n: r for r in df.collect()}
    mirror = lambda i, n: i if 0 <= i < n else (0 if n == 1 else (-i if i < 0 else 2 * n - 2 - i))
    for n, x in enumerate(images):
        h, w = x.shape
        at = lambda i, j, x=x, h=h, w=w: x[mirror(i, h), mirror(j, w)]
        v = [at(i - 1, j) + at(i + 1, j) + at(i, j - 1) + at(i, j + 1) - 4 * x[i, j] for i in range(h) for j in range(w)]
        assert abs(got[n].b - np.var(v)) < 1e-9 * max(1, np.var(v))
    assert [got[n].kept for n in range(4)] == [True, False, got[2].b >= 1, False] and all(got[n]["all"] for n in range(4))
