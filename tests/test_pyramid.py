"""Nearest circle edges by a pyramid of tiles, held against every pair."""

import math
import random

import pytest
from placeloom import fixed
from placeloom.operators import pyramid as pyr

CELL = "lat double, lng double, radius_m double"
POINT = "target_id long, p_lat double, p_lng double"


def distance(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * fixed.EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(h)))


def everywhere(rng, n):
    return [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(n)]


def held(spark, points, cells, **options):
    targets = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], POINT)
    got = pyr.nearest_edges(targets, spark.createDataFrame(cells, CELL), **options).collect()
    return {r.target_id: r.gap_m for r in got}


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0, "side_rows": 5}])
def test_equals_every_pair_on_the_globe(spark, options):
    rng = random.Random(1)
    cells = [(lat, lng, rng.choice([50.0, 800.0, 40_000.0])) for lat, lng in everywhere(rng, 120)]
    cells += [(89.99, 10.0, 500.0), (-89.9, -170.0, 500.0), (10.0, 180.0, 90.0), (10.0, -180.0, 90.0), cells[0]]
    cells += [(None, 1.0, 5.0), (1.0, 1.0, None)]
    points = everywhere(rng, 60) + [(90.0, 0.0), (-90.0, 5.0), (10.0, 179.9), (10.0, -179.9), (89.9, -170.0)]
    got = held(spark, points, cells, **options)
    real = [c for c in cells if None not in c]
    assert len(got) == len(points)
    for k, p in enumerate(points):
        assert got[k] == pytest.approx(min(distance(*p, a, b) - r for a, b, r in real), abs=0.02)


def test_lower_bound_never_exceeds_a_distance(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(2000):
        south, north = sorted(rng.uniform(-90, 90) for _ in range(2))
        west, east = sorted(rng.uniform(-180, 180) for _ in range(2))
        inside = (rng.uniform(south, north), rng.uniform(west, east))
        rows.append((*everywhere(rng, 1)[0], south, north, west, east, *inside))
    df = spark.createDataFrame(rows, "y double, x double, south double, north double, west double, east double, a double, b double")
    for r in df.withColumn("low", pyr.box_distance_m(df.y, df.x)).collect():
        assert r.low <= distance(r.y, r.x, r.a, r.b) + 1e-3


def test_far_points_meet_few_tiles(spark):
    """Fifty points a thousand kilometres from three thousand cells of one city."""
    rng = random.Random(3)
    cells = [(59.3 + 0.004 * (k // 60), 24.4 + 0.007 * (k % 60), rng.choice([300.0, 600.0])) for k in range(3000)]
    points = [(50.0 + rng.uniform(-1, 1), 24.0 + rng.uniform(-3, 3)) for _ in range(50)]
    targets = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], POINT)
    built = pyr.build(spark.createDataFrame(cells, CELL))
    tiles = pyr.candidates(targets, built)
    met = tiles.join(built.cells, ["t_row", "t_col"]).count()
    assert tiles.count() < 50 * 12 and met < 50 * 3000 / 20
    got = {r.target_id: r.gap_m for r in pyr.nearest_edges(targets, None, pyramid=built).collect()}
    for k, p in enumerate(points):
        assert got[k] == pytest.approx(min(distance(*p, a, b) - r for a, b, r in cells), abs=0.02)


def test_no_circles_or_points(spark):
    assert held(spark, [(1.0, 2.0)], []) == {}
    assert held(spark, [], [(1.0, 2.0, 50.0)]) == {}
