"""Sweeps against a plain simulation of the same rules on small fixtures."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from placeloom.functions.geo import CELL_KEY, with_cell_identity
from placeloom.operators import sweep
from placeloom.operators.search import DISTANCE, POPULARITY, capped_search, rank_for
from test_geo import haversine

PLACE = (
    "place_id string, latitude double, longitude double, user_rating_count bigint,"
    " primary_type string"
)
CELL = "queue_pos bigint, lat double, lng double, radius_m double, depth int"
M = 111_320.0


def cluster(count, lat=40.0, lng=49.0, spread=120.0, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(count):
        r, a = spread * math.sqrt(rng.random()), rng.uniform(0, 2 * math.pi)
        rows.append((
            f"p{k:03d}", lat + r * math.sin(a) / M,
            lng + r * math.cos(a) / (M * math.cos(math.radians(lat))),
            None if k % 11 == 0 else rng.randrange(120),
            [None, "restaurant", "cafe", "hotel", "supermarket"][k % 5],
        ))
    return rows


def simulate(rows, circles, s, log=None, known=(), budget=None):
    """The rules, one cell at a time; returns (log, places, counters)."""
    log, places = dict(log or {}), set(known)
    n = dict.fromkeys([*sweep.COUNTERS, "max_depth"], 0)
    key = lambda c: (round(c[0], 6), round(c[1], 6), round(c[2], 1))
    popular = rank_for(s.min_reviews, s.rank) == POPULARITY
    queue = list(circles)
    while queue:
        following = []
        for lat, lng, radius, depth in queue:
            kids = [
                (lat + b / M, lng + a / max(M * math.cos(math.radians(lat)), 1.0),
                 radius / math.sqrt(2) / 0.98, depth + 1)
                for a in (-radius / 2, radius / 2) for b in (-radius / 2, radius / 2)
            ]
            cell = key((lat, lng, radius))
            if s.resume and cell in log:
                n["cells_skipped"] += 1
                following += kids if log[cell] else []
                continue
            if budget is not None and n["cells_searched"] >= budget:
                return log, places, n, True
            inside = [(haversine(lat, lng, p[1], p[2]), p) for p in rows]
            inside = [(d, p) for d, p in inside if d <= radius]
            if popular:
                inside.sort(key=lambda x: (x[1][3] is None, -(x[1][3] or 0), x[1][0]))
            else:
                inside.sort(key=lambda x: (x[0], x[1][0]))
            low = new = 0
            for _, p in inside[:20]:
                if s.min_reviews and (p[3] or 0) < s.min_reviews:
                    low += 1
                elif s.restaurants_only and p[4] in ("hotel", "supermarket") and (
                    p[4] not in s.included_types
                ):
                    n["skipped_not_restaurant"] += 1
                elif p[0] not in places:
                    places.add(p[0])
                    new += 1
            count = len(inside[:20])
            split = count >= 20
            if split and s.min_reviews and low:
                n["cells_below_bar"] += 1
                split = False
            elif split and s.split_only_if_new and not new:
                n["cells_pruned"] += 1
                split = False
            elif split and (depth >= s.max_depth or radius / 2 < s.min_radius_m):
                split = False
            n["cells_searched"] += 1
            n["results_seen"] += count
            n["skipped_below_bar"] += low
            n["new_places"] += new
            n["cells_split"] += split
            n["max_depth"] = max(n["max_depth"], depth)
            log[cell] = split
            following += kids if split else []
        queue = following
    return log, places, n, False


def run(spark, rows, circles, settings, **options):
    places = spark.createDataFrame(rows, PLACE)
    cells = spark.createDataFrame([(k, *c) for k, c in enumerate(circles)], CELL)
    return sweep.run_sweep(
        cells, sweep.place_table_search(places, settings), settings, **options
    )


def agree(result, simulated):
    _, places, counters, stopped = simulated
    totals = result.totals()
    assert {c: totals[c] for c in counters} == counters
    assert bool(result.stopped_early) == stopped
    return places


CIRCLES = [(40.0, 49.0, 400.0, 0), (40.003, 49.0, 400.0, 0), (40.0, 49.0, 400.0, 0)]
SETTINGS = {
    "census": sweep.SweepSettings(min_radius_m=30.0, max_depth=3, restaurants_only=False),
    "bar": sweep.SweepSettings(min_reviews=25, min_radius_m=70.0),
    "only if new": sweep.SweepSettings(min_radius_m=30.0, split_only_if_new=True, max_depth=4),
    "asked for": sweep.SweepSettings(included_types=("hotel", "bar"), max_depth=2),
    "no resume": sweep.SweepSettings(resume=False, max_depth=1),
}


@pytest.mark.parametrize("name", sorted(SETTINGS))
def test_agrees_with_simulation(spark, name):
    rows = cluster(70)
    result = run(spark, rows, CIRCLES, SETTINGS[name])
    places = agree(result, simulate(rows, CIRCLES, SETTINGS[name]))
    found = {r.place_id for r in result.observations.collect()}
    assert found == places


def test_dense_cluster_is_found_completely_whatever_the_parallelism(spark):
    rows = cluster(60)
    settings = sweep.SweepSettings(min_radius_m=5.0, max_depth=8, restaurants_only=False)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        result = run(spark, rows, [(40.0, 49.0, 150.0, 0)], settings)
        assert {r.place_id for r in result.observations.collect()} == {p[0] for p in rows}
        assert result.totals()["cells_split"] > 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_bar_is_cheaper_than_census(spark):
    rows = cluster(60)
    bar = simulate(rows, CIRCLES[:1], sweep.SweepSettings(min_reviews=25, min_radius_m=5.0))
    census = simulate(rows, CIRCLES[:1], sweep.SweepSettings(min_radius_m=5.0))
    assert bar[2]["cells_searched"] < census[2]["cells_searched"]


def test_budget_stops_and_a_resumed_run_finishes(spark):
    rows, settings = cluster(60), sweep.SweepSettings(min_radius_m=30.0, restaurants_only=False)
    limited = sweep.SweepSettings(min_radius_m=30.0, restaurants_only=False, budget=3)
    first = run(spark, rows, CIRCLES[:1], limited)
    simulated = simulate(rows, CIRCLES[:1], limited, budget=3)
    agree(first, simulated)
    assert first.stopped_early and first.totals()["cells_searched"] == 3
    known = first.observations.select("place_id").distinct()
    second = run(spark, rows, CIRCLES[:1], settings, log=first.log, known_ids=known)
    again = simulate(rows, CIRCLES[:1], settings, log=simulated[0], known=simulated[1])
    agree(second, again)
    found = known.union(second.observations.select("place_id")).distinct().count()
    assert found == len(again[1])
    # A third run has nothing to search, but walks the whole log.
    third = run(spark, rows, CIRCLES[:1], settings, log=first.log.unionByName(second.log))
    assert third.totals()["cells_searched"] == 0 and third.totals()["cells_skipped"] > 3
    # Another type scope shares nothing with it.
    bars = sweep.SweepSettings(included_types=("bar",), max_depth=0)
    other = run(spark, rows, CIRCLES[:1], bars, log=first.log)
    assert other.totals()["cells_searched"] == 1


def test_failed_cells_are_counted_and_not_logged(spark):
    cells = spark.createDataFrame(
        [(0, 40.0, 49.0, 500.0, 0), (1, 40.01, 49.0, 500.0, 0), (2, 40.02, 49.0, 500.0, 0)], CELL
    )
    keyed = with_cell_identity(cells)
    answer = lambda pos, place, status: keyed.where(F.col("queue_pos") == pos).select(
        *CELL_KEY, F.lit(place).cast("string").alias("place_id"),
        F.lit(30).cast("bigint").alias("user_rating_count"),
        F.lit("cafe").alias("primary_type"), F.lit(status).alias("status"),
    )
    landed = answer(0, "a", "ok").unionByName(answer(1, None, "failed"))
    landed = landed.unionByName(answer(2, None, "empty"))
    settings = sweep.SweepSettings()
    result = sweep.run_sweep(cells, sweep.landed_results_search(landed), settings)
    totals = result.totals()
    assert (totals["cells_failed"], totals["cells_searched"]) == (1, 2)
    assert result.log.count() == 2
    again = sweep.run_sweep(
        cells, sweep.landed_results_search(landed), settings, log=result.log
    )
    assert (again.totals()["cells_failed"], again.totals()["cells_skipped"]) == (1, 2)


def test_cap_can_be_lowered_but_not_raised_and_limits_early(spark):
    rows = cluster(50)
    places = spark.createDataFrame(rows, PLACE)
    cells = spark.createDataFrame([(0, 40.0, 49.0, 400.0, 0)], CELL)
    for asked, got in ((5, 5), (500, 20)):
        hits = capped_search(cells, places, ["queue_pos"], DISTANCE, max_results=asked)
        assert hits.count() == got
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_log_keeps_the_latest_row_and_old_keys_migrate(spark):
    rows = [
        ("restaurant", 40.0, 49.0, 500.0, 0, 20, True, True, datetime(2020, 1, 1)),
        (None, 40.0, 49.0, 500.0, 1, 3, False, False, datetime(2021, 1, 1)),
        ("bar", 40.0, 49.0, 500.0, 0, 7, False, False, datetime(2019, 1, 1)),
    ]
    from placeloom.schemas import CELL_LOG

    log = sweep.with_scope(spark.createDataFrame(rows, CELL_LOG))
    latest = {r.scope: (r.result_count, r.split) for r in sweep.latest_log(log).collect()}
    assert latest == {"restaurant": (3, False), "bar": (7, False)}
    keys = spark.createDataFrame([("1.0,2.0,3.0",), ("bar|1.0,2.0,3.0",)], "cell_key string")
    moved = [r[0] for r in sweep.migrate_keys(keys).collect()]
    assert moved == ["restaurant|1.0,2.0,3.0", "bar|1.0,2.0,3.0"]
    assert [r[0] for r in sweep.migrate_keys(sweep.migrate_keys(keys)).collect()] == moved


AREA_CELL = "area_id string, " + CELL


def test_areas_swept_together_equal_single_sweeps(spark):
    """Each area's cells are numbered from 0; no cap, claim or counter is shared."""
    near = cluster(60)
    moved = lambda r: (f"far-{r[0]}", r[1], r[2] + 3.0, *r[3:])
    rows = near + [moved(r) for r in near]
    settings = sweep.SweepSettings(min_radius_m=30.0, max_depth=3, restaurants_only=False)
    places = spark.createDataFrame(rows, PLACE)
    cells = [("a", k, *c) for k, c in enumerate(CIRCLES)]
    cells += [("b", k, c[0], c[1] + 3.0, *c[2:]) for k, c in enumerate(CIRCLES)]
    search = sweep.place_table_search(places, settings)
    both = sweep.run_sweep(spark.createDataFrame(cells, AREA_CELL), search, settings)
    found, totals = set(), {}
    for area in "ab":
        own = spark.createDataFrame([c for c in cells if c[0] == area], AREA_CELL)
        one = sweep.run_sweep(own, search, settings)
        found |= {r.place_id for r in one.observations.select("place_id").distinct().collect()}
        for name in sweep.COUNTERS:
            totals[name] = totals.get(name, 0) + one.totals()[name]
    assert {name: both.totals()[name] for name in sweep.COUNTERS} == totals
    assert {r.place_id for r in both.observations.select("place_id").distinct().collect()} == found
    with pytest.raises(ValueError):
        sweep.start_frontier(spark.createDataFrame([c[1:] for c in cells], CELL))


def test_failed_cell_is_done_once_an_answer_lands(spark):
    cells = spark.createDataFrame([(0, 40.0, 49.0, 500.0, 0), (1, 40.01, 49.0, 500.0, 0)], CELL)
    keyed = with_cell_identity(cells)
    row = lambda pos, place, status, day: keyed.where(F.col("queue_pos") == pos).select(
        *CELL_KEY, F.lit(place).cast("string").alias("place_id"),
        F.lit(30).cast("bigint").alias("user_rating_count"), F.lit("cafe").alias("primary_type"),
        F.lit(status).alias("status"), F.lit(datetime(2020, 1, day)).alias("answered_at"),
    )
    landed = row(0, None, "failed", 1).unionByName(row(0, "a", "ok", 2))
    landed = landed.unionByName(row(1, "b", "ok", 1)).unionByName(row(1, None, "failed", 2))
    settings = sweep.SweepSettings()
    timed = sweep.run_sweep(cells, sweep.landed_results_search(landed), settings).totals()
    assert (timed["cells_searched"], timed["cells_failed"], timed["new_places"]) == (1, 1, 1)
    untimed = landed.drop("answered_at")
    plain = sweep.run_sweep(cells, sweep.landed_results_search(untimed), settings).totals()
    assert (plain["cells_searched"], plain["cells_failed"], plain["new_places"]) == (2, 0, 2)


def test_nothing_behind_a_budget_cut_is_skipped(spark):
    places = spark.createDataFrame(cluster(5), PLACE)
    circles = [(40.0, 49.0, 400.0, 0), (40.1, 49.0, 400.0, 0), (40.2, 49.0, 400.0, 0), (40.2, 49.0, 400.0, 0)]
    cells = spark.createDataFrame([(k, *c) for k, c in enumerate(circles)], CELL)
    settings = sweep.SweepSettings(budget=1, max_depth=0)
    totals = sweep.run_sweep(cells, sweep.place_table_search(places, settings), settings).totals()
    assert (totals["cells_searched"], totals["cells_skipped"]) == (1, 0)


@pytest.mark.parametrize("lat,radius", [(59.0, 120_000.0), (72.0, 60_000.0), (0.0, 400_000.0)])
def test_wide_cells_leave_no_ring(spark, lat, radius):
    """Every point of a cell wider than a search reaches lies in one of the cells that replace it."""
    cells = spark.createDataFrame(
        [(0, lat, 20.0, radius, 0), (1, lat, 20.0, 900.0, 0)], "queue_pos bigint, lat double, lng double, radius_m double, depth int"
    )
    start = sweep.start_frontier(cells).collect()
    assert sorted(r.queue_pos for r in start) == list(range(len(start)))
    assert max(r.radius_m for r in start) <= 50_000.0 and sum(r.radius_m == 900.0 for r in start) == 1
    rng, missed, tried = random.Random(1), 0, 0
    while tried < 3000:
        p = (lat + rng.uniform(-radius, radius) / 111_000, 20.0 + rng.uniform(-radius, radius) / 111_000 / math.cos(math.radians(lat + 1)))
        if haversine(lat, 20.0, *p) <= radius:
            tried += 1
            missed += not any(haversine(r.lat, r.lng, *p) <= r.radius_m for r in start)
    assert missed == 0
