"""The sweep as a stream of landed answers, held against the rules cell by cell."""

import json
import random
from datetime import datetime, timedelta

import pytest
from placeloom.operators.cover import cover_bbox, split_children
from placeloom.operators.sweep import SweepSettings
from placeloom.session import shared_root
from placeloom.sources.tables import CellLog, PlaceStore
from placeloom.streaming import sweep
from pyspark.sql import functions as F

SETTINGS = SweepSettings(min_reviews=25, max_depth=2, min_radius_m=1.0)
NOW = datetime(2024, 5, 1)


def cells_of(spark):
    """Two areas, and all their cells down to the last level."""
    areas = spark.createDataFrame(
        [("a", 59.0, 24.0, 59.02, 24.03, 900.0), ("b", 10.0, 5.0, 10.01, 5.01, 500.0)],
        "area_id string, south double, west double, north double, east double, cell_radius_m double",
    )
    level = cover_bbox(areas).select("area_id", "queue_pos", "lat", "lng", "radius_m", "depth")
    every = level
    for _ in range(3):
        level = split_children(level)
        every = every.unionByName(level.select(*every.columns))
    return every.collect()


def answers_of(cells, seed=1):
    """An answer to every cell, asked for or not; some are full, some reach below the bar."""
    rng = random.Random(seed)
    out = []
    for k, c in enumerate(cells):
        n = rng.choice([0, 3, 20, 20, 20])
        low = rng.random() < 0.3
        payloads = [
            json.dumps({"id": f"p{rng.randrange(400)}", "userRatingCount": 5 if low and j == 0 else 30 + k % 7,
                        "primaryType": rng.choice(["restaurant", "hotel"]), "displayName": {"text": f"n{k}"}})
            for j in range(n)
        ]
        status = "failed" if rng.random() < 0.05 else "ok"
        out.append((c.area_id, c.queue_pos, c.depth, c.lat, c.lng, c.radius_m, status, NOW + timedelta(seconds=k), k, payloads))
    return out


def expected(answers):
    """The cells taken, and the places they leave, by walking down from the first level."""
    by_cell = {a[:3]: a for a in answers}  # numbers repeat from level to level
    todo = [a[:3] for a in answers if a[2] == 0]
    taken, requests, places = [], [], {}
    while todo:
        cell = todo.pop()
        a = by_cell[cell]
        if a[6] != "ok":
            continue
        found = [json.loads(p) for p in a[9]]
        split = len(found) == 20 and all(f["userRatingCount"] >= 25 for f in found) and a[2] < SETTINGS.max_depth
        taken.append((cell[1], len(found), split))
        for f in found:
            if f["userRatingCount"] >= 25 and f["primaryType"] == "restaurant":
                key = (a[7], f["displayName"]["text"])
                places[f["id"]] = max(places.get(f["id"], key), key)
        if split:
            children = [(cell[0], 4 * cell[1] + k, cell[2] + 1) for k in range(4)]
            requests += children
            todo += children
    return sorted(taken), sorted(requests), {p: name for p, (_, name) in places.items()}


def land(spark, answers, folder, files):
    for k in range(files):
        rows = spark.createDataFrame(answers[k::files], sweep.ANSWER).coalesce(1)
        rows.write.mode("append").parquet(folder)


def run(spark, root, per_trigger=2):
    stream = spark.readStream.schema(sweep.ANSWER).option("maxFilesPerTrigger", per_trigger).parquet(f"{root}/landed")
    store, log = PlaceStore(spark, f"{root}/store"), CellLog(spark, f"{root}/log")
    sweep.start_sweep(stream, store, log, f"{root}/requests", f"{root}/checkpoint", SETTINGS).awaitTermination()
    return store, log


def state_of(spark, root, store, log):
    logged = sorted((r.depth, r.result_count, r.split, round(r.lat, 7), round(r.lng, 7)) for r in log.rows().collect())
    asked = sorted((r.area_id, r.queue_pos, r.depth) for r in spark.read.parquet(f"{root}/requests").collect())
    places = {r.place_id: (r.name, r.first_seen_at, r.last_seen_at) for r in store.places().collect()}
    return logged, asked, places


@pytest.mark.parametrize("shuffled", [False, True])
def test_stream_follows_the_rules_and_survives_a_restart(spark, tmp_path, shuffled):
    answers = answers_of(cells_of(spark))
    taken, requests, places = expected(answers)
    if shuffled:  # children land before their parents
        random.Random(7).shuffle(answers)
    else:
        answers = answers[::-1]
    land(spark, answers[: len(answers) // 2], f"{tmp_path}/landed", 2)
    run(spark, str(tmp_path))
    land(spark, answers[len(answers) // 2 :], f"{tmp_path}/landed", 2)
    store, log = run(spark, str(tmp_path), per_trigger=1)
    logged, asked, held = state_of(spark, str(tmp_path), store, log)
    assert sorted((c, s) for _, c, s, _, _ in logged) == sorted((c, s) for _, c, s in taken)
    assert asked == requests
    assert {p: v[0] for p, v in held.items()} == places
    # Answers that land again, and a run with nothing new, change nothing.
    land(spark, answers[:50], f"{tmp_path}/landed", 1)
    assert state_of(spark, str(tmp_path), *run(spark, str(tmp_path))) == (logged, asked, held)


def test_one_batch_is_the_same_as_many(spark, tmp_path):
    answers = answers_of(cells_of(spark), seed=3)
    _, requests, places = expected(answers)
    land(spark, answers, f"{tmp_path}/landed", 3)
    store, log = run(spark, str(tmp_path), per_trigger=100)
    _, asked, held = state_of(spark, str(tmp_path), store, log)
    assert asked == requests and {p: v[0] for p, v in held.items()} == places


def test_claims_cannot_be_judged_from_an_answer(spark):
    rows = spark.createDataFrame([], sweep.ANSWER)
    with pytest.raises(ValueError):
        sweep.judge_answers(rows, SweepSettings(split_only_if_new=True))
    assert shared_root(spark)
    assert sweep.judge_answers(rows, SETTINGS).where(F.col("split")).count() == 0
