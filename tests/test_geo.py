"""Covers, splits, radii and parsing."""

import math
import random

import pytest
from pyspark.sql import functions as F

from placeloom.functions import geo
from placeloom.operators import cover

BOX = "area_id string, south double, west double, north double, east double, cell_radius_m double"
DISC = (
    "area_id string, center_lat double, center_lng double, area_radius_m double,"
    " cell_radius_m double"
)


def haversine(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2
    h += math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6_371_008.8 * math.asin(min(1.0, math.sqrt(h)))


def covered(cells, lat, lng):
    return any(haversine(c.lat, c.lng, lat, lng) <= c.radius_m for c in cells)


def test_every_point_of_a_box_is_covered(spark):
    boxes = [("town", 59.40, 24.60, 59.43, 24.68, 400.0), ("south", -33.9, 151.1, -33.88, 151.13, 300.0)]
    cells = cover.cover_bbox(spark.createDataFrame(boxes, BOX)).collect()
    rng = random.Random(1)
    for name, south, west, north, east, _ in boxes:
        mine = [c for c in cells if c.area_id == name]
        for _ in range(300):
            assert covered(mine, rng.uniform(south, north), rng.uniform(west, east))
        for corner in ((south, west), (south, east), (north, west), (north, east)):
            assert covered(mine, *corner)
    positions = [(c.area_id, c.queue_pos) for c in cells]
    assert len(positions) == len(set(positions))


def test_every_point_of_a_disc_is_covered_and_far_cells_are_dropped(spark):
    disc = spark.createDataFrame([("d", 40.0, 49.0, 2000.0, 350.0)], DISC)
    cells = cover.cover_disc(disc).collect()
    rng = random.Random(2)
    for _ in range(300):
        r, a = 2000.0 * math.sqrt(rng.random()) * 0.999, rng.uniform(0, 2 * math.pi)
        lat = 40.0 + r * math.sin(a) / 111_320.0
        lng = 49.0 + r * math.cos(a) / (111_320.0 * math.cos(math.radians(40.0)))
        if haversine(40.0, 49.0, lat, lng) <= 2000.0:
            assert covered(cells, lat, lng)
    assert all(haversine(40.0, 49.0, c.lat, c.lng) <= 2000.0 + c.radius_m + 1e-6 for c in cells)


def test_a_disc_never_uses_cells_larger_than_itself(spark):
    disc = spark.createDataFrame([("d", 40.0, 49.0, 200.0, 5000.0)], DISC)
    assert {c.radius_m for c in cover.cover_disc(disc).collect()} == {200.0}


def test_children_cover_their_parent_in_order(spark):
    schema = "queue_pos bigint, lat double, lng double, radius_m double, depth int"
    parent = spark.createDataFrame([(7, 59.4, 24.7, 500.0, 2)], schema)
    children = sorted(cover.split_children(parent).collect(), key=lambda c: c.queue_pos)
    assert [c.queue_pos for c in children] == [28, 29, 30, 31]
    assert all(c.depth == 3 for c in children)
    assert all(abs(c.radius_m - 500.0 / math.sqrt(2) / 0.98) < 1e-9 for c in children)
    west_south, west_north, east_south, _ = children
    assert west_south.lat < west_north.lat and west_south.lng < east_south.lng
    rng = random.Random(3)
    for _ in range(400):
        r, a = 500.0 * math.sqrt(rng.random()), rng.uniform(0, 2 * math.pi)
        lat = 59.4 + r * math.sin(a) / 111_320.0
        lng = 24.7 + r * math.cos(a) / (111_320.0 * math.cos(math.radians(59.4)))
        if haversine(59.4, 24.7, lat, lng) <= 500.0:
            assert covered(children, lat, lng)


@pytest.mark.parametrize("row", [("x", 2.0, 0.0, 1.0, 1.0, 100.0), ("x", 0.0, 0.0, 1.0, 1.0, 0.0)])
def test_bad_boxes_fail(spark, row):
    with pytest.raises(Exception, match="need south|must be positive"):
        cover.cover_bbox(spark.createDataFrame([row], BOX)).collect()


def test_cell_identity_ignores_depth_and_noise(spark):
    rows = [(59.4, 24.7, 250.25, 0), (59.4 + 1e-9, 24.7 - 1e-9, 250.2500001, 5)]
    df = spark.createDataFrame(rows, "lat double, lng double, radius_m double, depth int")
    keys = geo.with_cell_identity(df).select(*geo.CELL_KEY).distinct().collect()
    assert len({(k.lat_e6, k.lng_e6) for k in keys}) == 1


def test_parsing(spark):
    rows = [("40.4093,49.8671", "1,2,3,4"), (" 40.4 ; 49.8 ", "3,2,1,4"), ("40.4", "1,2,3"),
            ("91,0", "1,9,3,4"), ("x,1", "a,b,c,d"), ("0,181", None)]
    df = spark.createDataFrame(rows, "p string, b string")
    got = df.select(geo.parse_latlng(F.col("p")).alias("p"), geo.parse_bbox(F.col("b")).alias("b"))
    got = got.collect()
    assert [r.p.valid for r in got] == [True, True, False, False, False, False]
    assert (got[1].p.lat, got[1].p.lng) == (40.4, 49.8)
    assert [r.b.valid for r in got] == [True, False, False, False, False, False]


def test_default_types(spark):
    df = spark.createDataFrame([(None,), ("",), (" , ",), ("bar, cafe",)], "t string")
    got = [r[0] for r in df.select(geo.parse_types(F.col("t"))).collect()]
    assert got == [["restaurant"], ["restaurant"], ["restaurant"], ["bar", "cafe"]]


def test_budgets_fit(spark):
    rows = []
    for n, (radius, budget) in enumerate(
        (r, b) for r in (800.0, 3000.0, 12000.0) for b in (10, 50, 200, 1000)
    ):
        rows.append((n, 59.4, 24.7, radius, None, None, None, None, 1000.0, budget))
    rows.append((99, None, None, None, 59.4, 24.6, 59.5, 24.8, 1000.0, 60))
    rows.append((100, None, None, None, 59.4, 24.6, 59.5, 24.8, 1000.0, None))
    schema = (
        "area_id int, center_lat double, center_lng double, area_radius_m double, south double,"
        " west double, north double, east double, cell_radius_m double, budget int"
    )
    fitted = cover.fit_areas(spark.createDataFrame(rows, schema)).collect()
    assert len(fitted) == len(rows)
    for area in fitted:
        if area.budget is None:
            assert area.cell_radius_m == 1000.0
        elif area.budget >= 50:
            assert area.n_cells <= max(1, int(area.budget * 0.7))
        if area.budget:
            assert area.cell_radius_m >= 25.0
        assert area.fits == (area.budget is None or area.n_cells <= max(1, int(area.budget * 0.7)))
    first = cover.fit_areas(spark.createDataFrame(rows, schema), passes=0).collect()
    assert not all(a.fits for a in first) and all(a.fits for a in first if a.budget is None)


def test_estimates(spark):
    rows = [(1, 100, None), (2, 100, 120), (3, 100, 80)]
    fitted = spark.createDataFrame(rows, "area_id int, n_cells bigint, budget int")
    bar = {r.area_id: (r.low_calls, r.high_calls) for r in
           cover.estimate_cost(fitted, 25, 0.035).collect()}
    assert bar == {1: (100, 250), 2: (100, 120), 3: (80, 80)}
    census = cover.estimate_cost(fitted, 0, 0.035).where("area_id = 1").first()
    assert (census.low_calls, census.high_calls) == (100, 1200)
    assert cover.price_for_tier("full") == 0.040 and cover.price_for_tier("full", 0.1) == 0.1
