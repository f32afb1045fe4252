"""Random views of labelled corners, drawn from a hash of (seed, id, epoch): the same in any order and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions import geometry as G
from lumenfold.functions.binding import let


def uniform(key: Column, name: str, low: float | Column = 0.0, high: float | Column = 1.0) -> Column:
    """A number between low and high, from 52 bits of a hash of the key and the draw's name."""
    part = F.conv(F.substring(F.md5(F.concat_ws("|", key, F.lit(name))), 1, 13), 16, 10).cast("bigint") / 16.0**13
    return (F.lit(low) if isinstance(low, float) else low) + part * (high - low)


def draw_key(seed: int, row_id: Column, epoch: Column) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), row_id.cast("string"), epoch.cast("string"))


def _inside(q: Column) -> Column:
    return F.forall(q, lambda p: p["x"].between(0.0, 1.0) & p["y"].between(0.0, 1.0))


def turned(corners: Column, key: Column) -> Column:
    """struct(degrees, applied, corners): turned about the centre by any angle, unless a corner would leave the picture.

    Pictures without corners (null) are always turned; an angle of half a degree or less is left out.
    """

    def judged(degrees: Column, moved: Column) -> Column:
        return F.struct(degrees.alias("degrees"), moved.alias("moved"), ((degrees > 0.5) & F.coalesce(_inside(moved), F.lit(True))).alias("fine"))

    drawn = let(uniform(key, "degrees", 0.0, 360.0), lambda d: F.struct(d.alias("degrees"), G.rotate_points(corners, d, 0.5, 0.5).alias("moved")))
    chosen = let(drawn, lambda t: judged(t["degrees"], t["moved"]))
    return let(chosen, lambda t: F.struct(t["degrees"].alias("degrees"), t["fine"].alias("applied"), F.when(t["fine"], t["moved"]).otherwise(corners).alias("corners")))


def tilted(corners: Column, key: Column, width: int, height: int, least: float = 0.05, most: float = 0.35) -> Column:
    """struct(ends, applied, corners): a perspective that moves the picture's corners inwards, unless a corner would leave.

    Each of the picture's corners (pixel centres) moves by up to a drawn share of the shorter side along either axis;
    ``ends`` are their pixels after it, clockwise from the top left.
    """
    reach = uniform(key, "tilt", least, most) * min(width, height)
    right, bottom, zero = F.lit(float(width - 1)), F.lit(float(height - 1)), F.lit(0.0)
    draw = lambda n, axis, far: uniform(key, f"{n}{axis}", far - reach, far) if far is not zero else uniform(key, f"{n}{axis}", zero, reach)
    places = ((zero, zero), (right, zero), (right, bottom), (zero, bottom))
    ends = F.array(*[G.point(draw(n, "x", x), draw(n, "y", y)) for n, (x, y) in enumerate(places)])
    h = G.square_to_quad(ends)
    scaled = F.transform(corners, lambda p: G.point(p["x"] * width / (width - 1), p["y"] * height / (height - 1)))
    moved = F.transform(G.apply_homography(scaled, h), lambda p: G.point(p["x"] / width, p["y"] / height))
    fine = F.coalesce(_inside(moved), F.lit(True))
    return F.struct(ends.alias("ends"), fine.alias("applied"), F.when(fine, moved).otherwise(corners).alias("corners"))


def crop_box(key: Column, least: float = 0.6) -> list[Column]:
    """x, y, width, height in shares of the picture: a crop of a drawn size at a drawn place."""
    w, h = uniform(key, "crop_w", least, 1.0), uniform(key, "crop_h", least, 1.0)
    return [uniform(key, "crop_x", F.lit(0.0), 1 - w), uniform(key, "crop_y", F.lit(0.0), 1 - h), w, h]


def cropped(corners: Column, box: list[Column]) -> Column:
    """array of struct(x, y, visible): corners in shares of the crop, and whether they lie in it."""
    x, y, w, h = box
    bounds = F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    shifted = let(bounds, lambda b: F.transform(corners, lambda p: G.point((p["x"] - b["x"]) / b["w"], (p["y"] - b["y"]) / b["h"])))
    return F.transform(shifted, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), (p["x"].between(0.0, 1.0) & p["y"].between(0.0, 1.0)).alias("visible")))
