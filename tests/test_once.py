"""Expressions whose parts are evaluated once a row: plans hold each of them a bounded number of times."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.plans import registry

SMALL = "/root/testdata/sf0.001"


def plan(spark, name: str) -> str:
    return registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_wiki_pages_are_read_once(spark):
    """The header's codes of a page are found once, not for each cell."""
    assert "transform(array(filter(" in plan(spark, "wiki_tick_matrix")


def test_draws_are_made_once(spark):
    """Five draws a row; the crop's size is needed for its place too."""
    assert plan(spark, "augmented_corners").count("md5") <= 12


def test_maps_are_made_in_steps(spark):
    from lumenfold.functions import geometry as G

    assert len(plan(spark, "homography_four_points")) < 60_000
    places = [F.lit(float(c)) for c in (0, 0, 63, 0, 63, 87, 0, 87)], [F.lit(c) for c in (0.1, 0.2, 0.9, 0.1, 0.8, 0.7, 0.2, 0.9)]
    source, target = (G.quad(*p) for p in places)
    row = G.with_quad_to_quad(spark.range(1).select("id", target.alias("t")), source, F.col("t")).first()
    assert [row[f"h{i}"] for i in range(9)] == list(spark.range(1).select(*[c.alias(f"h{i}") for i, c in enumerate(G.quad_to_quad(source, target))]).first())


def test_polygons_travel_as_arrays():
    import pyarrow as pa

    from lumenfold.functions import geometry as G

    square = lambda x: [{"x": x + dx, "y": dy} for dx, dy in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]
    found = G.polygon_iou.func(pa.array([square(0.0), None, square(0.0)]), pa.array([square(0.5), square(0.0), square(0.0)])).to_pylist()
    assert abs(found[0] - 1 / 3) < 1e-12 and found[1:] == [None, 1.0]
