"""The grid join must find exactly the pairs a brute-force scan finds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from placeloom.operators.grid import MOST_BUCKETS, bucket_circles, profile_circles, within_circles
from placeloom.operators.skew import balanced_join
from test_geo import haversine

CIRCLE = "c bigint, lat double, lng double, radius_m double"
POINT = "p bigint, p_lat double, p_lng double"


def on_edges(rng, lat0, lat1, lng0, lng1, radii, n_circles, n_points):
    """Random circles; half of the points sit just inside or outside an edge."""
    wrap = lambda x: (x + 180.0) % 360.0 - 180.0
    circles = [
        (k, rng.uniform(lat0, lat1), wrap(rng.uniform(lng0, lng1)), rng.choice(radii))
        for k in range(n_circles)
    ]
    points = []
    for k in range(n_points):
        if k % 2:
            _, lat, lng, radius = rng.choice(circles)
            bearing, reach = rng.uniform(0, 2 * math.pi), radius * rng.choice([0.9999, 1.0001])
            lat = max(-90.0, min(90.0, lat + reach * math.sin(bearing) / 111_195.0))
            shrink = max(math.cos(math.radians(lat)), 1e-6)
            points.append((k, lat, wrap(lng + reach * math.cos(bearing) / 111_195.0 / shrink)))
        else:
            points.append((k, rng.uniform(lat0, lat1), wrap(rng.uniform(lng0, lng1))))
    return circles, points


def brute(circles, points):
    return sorted(
        (c, p)
        for c, lat, lng, radius in circles
        for p, plat, plng in points
        if haversine(lat, lng, plat, plng) <= radius
    )


REGIONS = {
    "city": (59.4, 59.5, 24.6, 24.8, [200.0, 1000.0, 721.5]),
    "antimeridian": (-1.0, 1.0, 179.0, 181.0, [3000.0, 20000.0]),
    "north": (80.0, 89.0, -180.0, 180.0, [20000.0, 50000.0]),
    "pole": (88.9, 90.0, -180.0, 180.0, [5000.0, 50000.0]),
    "south pole": (-90.0, -88.9, -180.0, 180.0, [5000.0, 50000.0]),
}


REGIONS["below the pole"] = (89.49, 89.51, -180.0, 180.0, [100.0, 700.0, 1100.0])
REGIONS["at the pole"] = (89.98, 90.0, -180.0, 180.0, [60.0, 500.0, 1000.0])


def test_no_circle_lists_more_buckets_than_stated(spark):
    """The count is exact, and small wherever the circle lies."""
    rng = random.Random(6)
    lats = [0.0, 60.0, 89.0, 89.4995, 89.5, 89.99, 89.9999, 90.0, -89.4995, -90.0]
    lats += [90 - 10 ** rng.uniform(-6, 1) for _ in range(400)]
    radii = [1.0, 1.01, 64.0, 65.0, 100.0, 999.0, 1024.0, 50_000.0, 33_000.0]
    rows = [(k, lat, rng.choice([180.0, -180.0, 179.99, 0.0, 24.7]), rng.choice(radii)) for k, lat in enumerate(lats)]
    circles = spark.createDataFrame(rows, CIRCLE)
    listed = bucket_circles(circles, "lat", "lng", F.col("radius_m"))
    counts = {r.c: r["count"] for r in listed.groupBy("c").count().collect()}
    assert max(counts.values()) <= MOST_BUCKETS
    assert max(n for c, n in counts.items() if abs(rows[c][1]) <= 89.0 and rows[c][3] <= 1024) <= 15
    assert listed.distinct().count() == listed.count() == profile_circles(circles, F.col("radius_m")).buckets


@pytest.mark.parametrize("region", sorted(REGIONS))
@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_same_pairs_as_brute_force(spark, region, broadcast_rows):
    lat0, lat1, lng0, lng1, radii = REGIONS[region]
    circles, points = on_edges(random.Random(region), lat0, lat1, lng0, lng1, radii, 60, 400)
    # A block size of 5 makes almost every bucket hot on the shuffled path.
    pairs = within_circles(
        spark.createDataFrame(circles, CIRCLE),
        spark.createDataFrame(points, POINT),
        ["c"], ["p"], broadcast_rows=broadcast_rows, side_rows=5,
    )
    got = sorted((r.c, r.p) for r in pairs.select("c", "p").collect())
    assert got == brute(circles, points)


def test_circles_above_the_limit_are_searched_to_the_limit(spark):
    circles = spark.createDataFrame([(1, 0.0, 0.0, 80_000.0)], CIRCLE)
    points = spark.createDataFrame([(1, 0.4, 0.0), (2, 0.6, 0.0)], POINT)
    got = within_circles(circles, points, ["c"], ["p"]).collect()
    assert [r.p for r in got] == [1]


def test_no_cartesian_product(spark):
    circles, points = on_edges(random.Random(5), 59.4, 59.5, 24.6, 24.8, [300.0], 20, 50)
    for rows in (200_000, 0):
        pairs = within_circles(
            spark.createDataFrame(circles, CIRCLE), spark.createDataFrame(points, POINT),
            ["c"], ["p"], broadcast_rows=rows,
        )
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_both_sides_are_read_once(spark, tmp_path):
    """Counting rows, finding hot keys and joining take one scan of each side's source."""
    for name, rows in (("l", spark.range(400)), ("r", spark.range(900))):
        rows.selectExpr(f"id as {name}", "if(id < 200, 0, id) as k").write.parquet(f"{tmp_path}/{name}")
    left, right = (spark.read.parquet(f"{tmp_path}/{name}") for name in "lr")
    joined = balanced_join(left, right, ["k"], ["l"], ["r"], broadcast_rows=0, side_rows=16)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path) not in plan and plan.count("side-") >= 2
    assert joined.count() == left.join(right, "k").count()


def test_hot_keys_are_cut_and_whole(spark):
    """One key holds most rows of both sides; every pair still meets once."""
    left = spark.range(300).selectExpr("id as l", "if(id < 200, 0, id) as k")
    right = spark.range(500).selectExpr("id as r", "if(id < 400, 0, id) as k")
    joined = balanced_join(left, right, ["k"], ["l"], ["r"], broadcast_rows=0, side_rows=16)
    plain = left.join(right, "k")
    assert joined.count() == plain.count() == joined.select("l", "r").distinct().count()
    assert joined.select("k", "l", "r").exceptAll(plain.select("k", "l", "r")).isEmpty()


def test_points_of_one_task_are_spread(spark):
    """Points read by a single task meet their circles in several."""
    circles = spark.createDataFrame([(k, 59.0, 24.0, 500.0) for k in range(3)], "c int, lat double, lng double, radius_m double")
    points = spark.range(400).coalesce(1).selectExpr("id as p", "59D as p_lat", "24D + id * 1e-6D as p_lng")
    pairs = within_circles(circles, points, ["c"], ["p"])
    per_task = pairs.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per_task) == 1200 and max(r["count"] for r in per_task) <= 600
