"""Searching cells, judging results, splitting, resuming."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from placeloom.functions.geo import CELL_KEY
from placeloom.operators import report, sweep
from placeloom.operators.cover import cover_bbox, split_children
from placeloom.operators.numbering import first_rows
from placeloom.operators.search import DISTANCE, POPULARITY, capped_search, rank_for
from placeloom.plans.check_sql import (
    BOX,
    CELLS,
    DISTANCE_ORDER,
    POPULARITY_ORDER,
    children,
    cover as cover_sql,
    hits,
    judged,
    outcomes,
)
from placeloom.plans.cover_queries import CITY_BOXES, box_cells, city_boxes, rounded
from placeloom.plans.registry import query
from placeloom.plans.views import view, view_sql
from placeloom.session import scratch_path
from placeloom.sources.tables import CellLog, PlaceStore
from placeloom.streaming.sweep import ANSWER, start_sweep

_BAR = sweep.SweepSettings(min_reviews=25)
_HIT = "queue_pos, place_id, result_rank, round(distance_m, 3) as distance_m"


def _rounded_hits(found):
    return found.select(
        "queue_pos", "place_id", F.col("result_rank").cast("bigint").alias("result_rank"),
        F.round("distance_m", 3).alias("distance_m"),
    )


def _search(spark, sf_dir, rank, **options):
    cells = box_cells(spark, sf_dir)
    return capped_search(cells, view(spark, sf_dir, "places_v"), ["queue_pos"], rank, **options)


@query("capped_search_distance", f"select {_HIT} from {hits(CELLS, DISTANCE_ORDER)}")
def capped_search_distance(spark, sf_dir):
    return _rounded_hits(_search(spark, sf_dir, DISTANCE))


@query("capped_search_popularity", f"select {_HIT} from {hits(CELLS, POPULARITY_ORDER)}")
def capped_search_popularity(spark, sf_dir):
    return _rounded_hits(_search(spark, sf_dir, POPULARITY))


@query(
    "capped_search_types",
    f"""select {_HIT} from {hits(CELLS, DISTANCE_ORDER,
        "list_has_any(string_split(coalesce(p.types, ''), ','), ['restaurant', 'bar'])")}""",
)
def capped_search_types(spark, sf_dir):
    """Only places whose type list holds a requested type are found at all."""
    return _rounded_hits(
        _search(spark, sf_dir, DISTANCE, included_types=["restaurant", "bar"])
    )


_JUDGED = judged(hits(CELLS, POPULARITY_ORDER), 25)


def _level_outcomes(spark, sf_dir, settings=_BAR):
    cells = sweep.start_frontier(box_cells(spark, sf_dir))
    found = _search(spark, sf_dir, rank_for(settings.min_reviews))
    judged_rows = sweep.claim_new(sweep.judge_hits(found, settings))
    return sweep.cell_outcomes(cells, judged_rows, settings)


@query(
    "cell_outcomes",
    f"""select queue_pos, result_count, n_below_bar, n_not_restaurant, n_kept, n_new
    from {outcomes(CELLS, _JUDGED, 25, 6)}""",
)
def cell_outcomes(spark, sf_dir):
    return _level_outcomes(spark, sf_dir).select(
        "queue_pos", "result_count", "n_below_bar", "n_not_restaurant", "n_kept", "n_new"
    )


@query(
    "split_decision",
    f"""select queue_pos, result_count, saturated, n_below_bar, reason, split
    from {outcomes(CELLS, _JUDGED, 25, 6)}""",
)
def split_decision(spark, sf_dir):
    return _level_outcomes(spark, sf_dir).select(
        "queue_pos", "result_count", "saturated", "n_below_bar", "reason", "split"
    )


# Cells of all cities, numbered city by city.
_CITY_CELLS = f"""(select (row_number() over (order by area_id, queue_pos) - 1)::bigint as queue_pos,
    lat, lng, radius_m, depth from {cover_sql(CITY_BOXES)})"""


@query(
    "multi_area_cover",
    f"""select queue_pos, result_count, n_kept, n_new, saturated, split
    from {outcomes(_CITY_CELLS, judged(hits(_CITY_CELLS, POPULARITY_ORDER), 25), 25, 6)}""",
)
def multi_area_cover(spark, sf_dir):
    """One level over the covers of all cities: no cap, claim or counter is shared."""
    cells = sweep.start_frontier(cover_bbox(city_boxes(spark, sf_dir)))
    found = capped_search(cells, view(spark, sf_dir, "places_v"), ["queue_pos"], POPULARITY)
    claimed = sweep.claim_new(sweep.judge_hits(found, _BAR))
    return sweep.cell_outcomes(cells, claimed, _BAR).select(
        "queue_pos", "result_count", "n_kept", "n_new", "saturated", "split"
    )


_KNOWN = f"""(select distinct place_id from {view_sql('observations_v')}
  where website is not null)"""


@query(
    "first_claim_new",
    f"""select queue_pos, place_id from {judged(
        hits(CELLS, DISTANCE_ORDER), 0, known=_KNOWN)} where is_new""",
)
def first_claim_new(spark, sf_dir):
    """New places and the first cell in the queue that kept each of them."""
    settings = sweep.SweepSettings()
    known = (
        view(spark, sf_dir, "observations_v")
        .where("website is not null")
        .select("place_id")
        .distinct()
    )
    found = _search(spark, sf_dir, DISTANCE)
    claimed = sweep.claim_new(sweep.judge_hits(found, settings), known)
    return claimed.where("is_new").select("queue_pos", "place_id")


# The log of an interrupted run: every third cell was searched, and the full
# ones split.  The frontier repeats some cells.
_LOG = f"""(select c.lat, c.lng, c.radius_m, count(*) = 20 as split
  from (select * from {CELLS} where queue_pos % 3 = 0) as c
  left join {hits(CELLS, DISTANCE_ORDER)} as h on h.queue_pos = c.queue_pos
  group by all)"""
_FRONTIER = f"""(select queue_pos, lat, lng, radius_m, depth from {CELLS}
  union all select queue_pos + 1000000000, lat, lng, radius_m, depth from {CELLS}
  where queue_pos % 5 = 0)"""
_PLANNED = f"""(select f.*, l.lat is not null as searched_before,
    coalesce(l.split, false) as split_before
  from (select min(queue_pos) as queue_pos, lat, lng, radius_m, depth, count(*) as copies
    from {_FRONTIER} group by lat, lng, radius_m, depth) as f
  left join {_LOG} as l on l.lat = f.lat and l.lng = f.lng and l.radius_m = f.radius_m)"""


def _interrupted(spark, sf_dir):
    """(frontier, log) of a run cut short."""
    cells = sweep.start_frontier(box_cells(spark, sf_dir))
    again = cells.where("queue_pos % 5 = 0").withColumn(
        "queue_pos", F.col("queue_pos") + 1_000_000_000
    )
    done = cells.where("queue_pos % 3 = 0")
    n_found = _search(spark, sf_dir, DISTANCE).groupBy("queue_pos").agg(F.count("*").alias("n"))
    log = done.join(n_found, "queue_pos", "left").select(
        F.lit("restaurant").alias("scope"), "lat", "lng", "radius_m", "depth",
        F.coalesce(F.col("n"), F.lit(0)).alias("result_count"),
        F.coalesce(F.col("n") == 20, F.lit(False)).alias("saturated"),
        F.coalesce(F.col("n") == 20, F.lit(False)).alias("split"),
        F.lit(datetime(2001, 1, 1)).cast("timestamp").alias("searched_at"),
    )
    return cells.unionByName(again), log


@query(
    "resume_frontier",
    f"""select queue_pos, copies::bigint as copies, 'search' as step,
      round(lat, 6) as lat, round(lng, 6) as lng from {_PLANNED} where not searched_before
    union all
    select queue_pos, copies::bigint, 'child', round(lat, 6), round(lng, 6)
    from {children(f'(select * from {_PLANNED} where split_before)', keep='copies,')}""",
)
def resume_frontier(spark, sf_dir):
    """What a resumed run still has to do: unsearched cells, and the children of
    cells that were split before the interruption."""
    frontier, log = _interrupted(spark, sf_dir)
    planned = sweep.plan_level(frontier, sweep.cell_history(log, "restaurant"))
    todo = planned.where("not searched_before").withColumn("step", F.lit("search"))
    before = planned.where("split_before").select(*sweep.FRONTIER)
    again = split_children(before).withColumn("step", F.lit("child"))
    columns = ["queue_pos", "copies", "step", "lat", "lng"]
    work = todo.select(*columns).unionByName(again.select(*columns))
    return work.withColumns({"lat": F.round("lat", 6), "lng": F.round("lng", 6)})


@query(
    "budget_frontier",
    f"""select queue_pos, round(lat, 6) as lat, round(lng, 6) as lng from {_PLANNED}
    where not searched_before order by queue_pos limit 20""",
)
def budget_frontier(spark, sf_dir):
    """The cells a run with 20 calls left may still search."""
    frontier, log = _interrupted(spark, sf_dir)
    planned = sweep.plan_level(frontier, sweep.cell_history(log, "restaurant"))
    todo = planned.where("not searched_before")
    chosen = first_rows(todo.select("queue_pos", "lat", "lng"), [F.col("queue_pos")], 20)
    return chosen.withColumns({"lat": F.round("lat", 6), "lng": F.round("lng", 6)})


_TOP = outcomes(CELLS, _JUDGED, 25, 1)
_NEXT = children(f"(select * from {_TOP} where split)")
_KEPT = f"(select distinct place_id from {_JUDGED} where kept)"
# Cells of the second level that coincide are searched once.
_NEXT_ONCE = f"""(select arg_min(lat, queue_pos) as lat, arg_min(lng, queue_pos) as lng,
    arg_min(radius_m, queue_pos) as radius_m, arg_min(depth, queue_pos) as depth,
    min(queue_pos) as queue_pos, count(*) as copies
  from {_NEXT} group by round(lat * 1e6), round(lng * 1e6), round(radius_m * 10))"""
_SECOND = outcomes(
    f"(select queue_pos, lat, lng, radius_m, depth from next_level)",
    judged(hits("next_level", POPULARITY_ORDER), 25, known=_KEPT), 25, 1,
)
_NEXT_LEVEL = f"next_level as (select * from {_NEXT_ONCE})"
_TWO = f"""{_NEXT_LEVEL},
  both_levels as (select queue_pos, lat, lng, radius_m, depth, result_count, n_below_bar,
      n_not_restaurant, n_new, saturated, reason, split from {_TOP}
    union all select queue_pos, lat, lng, radius_m, depth, result_count, n_below_bar,
      n_not_restaurant, n_new, saturated, reason, split from {_SECOND})"""


def _two_levels(spark, sf_dir):
    settings = sweep.SweepSettings(min_reviews=25, max_depth=1)
    places = view(spark, sf_dir, "places_v")
    return sweep.run_sweep(
        box_cells(spark, sf_dir), sweep.place_table_search(places, settings), settings
    )


@query(
    "two_level_cover",
    f"""with {_TWO} select round(lat, 6) as lat, round(lng, 6) as lng,
      round(radius_m, 3) as radius_m, depth, result_count, saturated, split from both_levels""",
)
def two_level_cover(spark, sf_dir):
    """The cell log of a sweep that may split once."""
    log = _two_levels(spark, sf_dir).log
    return rounded(log, "depth", "result_count", "saturated", "split")


@query(
    "sweep_counters",
    f"""with {_TWO} select depth as level, count(*) as cells_searched,
      case depth when 0 then 0
        else (select coalesce(sum(copies - 1), 0) from next_level) end::bigint as cells_skipped,
      count(*) filter (where split) as cells_split,
      count(*) filter (where reason = 'nothing new') as cells_pruned,
      count(*) filter (where reason = 'below bar') as cells_below_bar,
      sum(n_below_bar)::bigint as skipped_below_bar,
      sum(n_not_restaurant)::bigint as skipped_not_restaurant,
      sum(result_count)::bigint as results_seen, sum(n_new)::bigint as new_places
    from both_levels group by depth""",
)
def sweep_counters(spark, sf_dir):
    levels = _two_levels(spark, sf_dir).levels
    names = [c for c in sweep.COUNTERS if c != "cells_failed"]
    rows = [(n, *[int(level[c]) for c in names]) for n, level in enumerate(levels)]
    schema = "level int, " + ", ".join(f"{c} bigint" for c in names)
    return spark.createDataFrame(rows, schema)


_LEVELS_KEPT = f"""(select place_id from {_JUDGED} where kept
    union select place_id from {judged(hits('next_level', POPULARITY_ORDER), 25)} where kept)"""


@query(
    "sweep_to_store",
    f"""with {_NEXT_LEVEL}
    select place_id, name, user_rating_count, primary_type, latitude
    from {view_sql('places_v')} where place_id in (select place_id from {_LEVELS_KEPT})""",
)
def sweep_to_store(spark, sf_dir):
    """Answers to all cells of two levels land in no order; the stream takes those asked for."""
    settings = sweep.SweepSettings(min_reviews=25, max_depth=1)
    cells = box_cells(spark, sf_dir)
    cells = cells.unionByName(split_children(cells).select(*cells.columns))
    keep = ("user_rating_count", "primary_type", "name")
    found = capped_search(
        cells, view(spark, sf_dir, "places_v"), ["depth", "queue_pos"], rank_for(settings.min_reviews), keep=keep
    )
    payload = F.to_json(
        F.struct(
            F.col("place_id").alias("id"),
            F.struct(F.col("name").alias("text")).alias("displayName"),
            F.col("user_rating_count").alias("userRatingCount"),
            F.col("primary_type").alias("primaryType"),
            F.struct(F.col("p_lat").alias("latitude")).alias("location"),
        )
    )
    found = found.join(
        view(spark, sf_dir, "places_v").select("place_id", F.col("latitude").alias("p_lat")), "place_id"
    )
    # At most twenty payloads a cell.
    payloads = found.groupBy("depth", "queue_pos").agg(F.collect_list(payload).alias("payloads"))
    answers = cells.join(payloads, ["depth", "queue_pos"], "left").select(
        F.lit("all").alias("area_id"), "queue_pos", "depth", "lat", "lng", "radius_m",
        F.lit("ok").alias("status"), F.lit(datetime(2001, 1, 1)).cast("timestamp").alias("seen_at"),
        F.col("queue_pos").alias("ingest_seq"), F.coalesce("payloads", F.array().cast("array<string>")).alias("payloads"),
    )
    root = scratch_path(spark, "sweep")
    answers.repartition(4, F.xxhash64("depth", "queue_pos")).write.parquet(f"{root}/landed")
    landed = spark.readStream.schema(ANSWER).option("maxFilesPerTrigger", 2).parquet(f"{root}/landed")
    store, log = PlaceStore(spark, f"{root}/store"), CellLog(spark, f"{root}/log")
    start_sweep(landed, store, log, f"{root}/requests", f"{root}/checkpoint", settings).awaitTermination()
    return store.places().select("place_id", "name", "user_rating_count", "primary_type", "latitude")


def _levels(last: int) -> str:
    """The levels of a census one after the other, each from the split cells of the one before."""
    parts = [f"l0 as materialized (select queue_pos, lat, lng, radius_m, depth from {CELLS})"]
    for level in range(last + 1):
        found = judged(hits(f"l{level}", DISTANCE_ORDER), 0)
        parts.append(f"h{level} as materialized (select * from {found})")
        parts.append(f"o{level} as materialized (select * from {outcomes(f'l{level}', f'h{level}', 0, last)})")
        if level < last:
            below = children(f"(select * from o{level} where split)")
            parts.append(f"""l{level + 1} as materialized (
              select min(queue_pos) as queue_pos, arg_min(lat, queue_pos) as lat, arg_min(lng, queue_pos) as lng,
                arg_min(radius_m, queue_pos) as radius_m, arg_min(depth, queue_pos) as depth
              from {below} group by round_even(lat * 1e6, 0), round_even(lng * 1e6, 0), round_even(radius_m * 10, 0))""")
    return ", ".join(parts)


_CENSUS = " union all ".join(f"select place_id, {n} as level, queue_pos from h{n} where kept" for n in range(7))


@query(
    "adaptive_cover",
    f"""with {_levels(6)}, seen as ({_CENSUS}),
      first as (select place_id, min(level) as level from seen group by place_id)
    select place_id, level, min(queue_pos) as queue_pos from seen join first using (place_id, level) group by all""",
)
def adaptive_cover(spark, sf_dir):
    """A full census of the places: every place found, and the level that found it."""
    settings = sweep.SweepSettings()
    places = view(spark, sf_dir, "places_v")
    result = sweep.run_sweep(
        box_cells(spark, sf_dir), sweep.place_table_search(places, settings), settings
    )
    return sweep.first_sightings(result)


@query(
    "queue_order_free",
    f"""with {_TWO} select round(lat, 6) as lat, round(lng, 6) as lng, depth, result_count, split
    from both_levels""",
)
def queue_order_free(spark, sf_dir):
    """The same two levels with the queue turned round: the same cells, counts and splits."""
    settings = sweep.SweepSettings(min_reviews=25, max_depth=1)
    turned = box_cells(spark, sf_dir).withColumn("queue_pos", F.lit(1 << 40) - F.col("queue_pos"))
    result = sweep.run_sweep(turned, sweep.place_table_search(view(spark, sf_dir, "places_v"), settings), settings)
    return result.log.select(
        F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "depth", "result_count", "split"
    )


@query(
    "landed_sweep_step",
    f"""with h as (select * from {hits(CELLS, DISTANCE_ORDER)} where queue_pos % 7 <> 3),
      j as (select * from {judged('h', 0)})
    select queue_pos, result_count, n_new, split from {outcomes(
        f"(select * from {CELLS} where queue_pos % 7 <> 3)", 'j', 0, 6)}""",
)
def landed_sweep_step(spark, sf_dir):
    """One step over landed results in which some cells failed: those are not
    logged and not split."""
    settings = sweep.SweepSettings()
    cells = sweep.plan_level(sweep.start_frontier(box_cells(spark, sf_dir)), None)
    found = _search(spark, sf_dir, DISTANCE)
    failed = cells.where("queue_pos % 7 = 3").select(*CELL_KEY, F.lit("failed").alias("status"))
    landed = cells.select("queue_pos", *CELL_KEY).join(found, "queue_pos", "left").select(
        *CELL_KEY, "place_id", "user_rating_count", "primary_type",
        F.when(F.col("place_id").isNull(), "empty").otherwise("ok").alias("status"),
    )
    landed = landed.join(failed.drop("status"), CELL_KEY, "left_anti").unionByName(
        failed, allowMissingColumns=True
    )
    answers, not_answered = sweep.landed_results_search(landed)(cells)
    done = cells.join(not_answered, "queue_pos", "left_anti")
    judged_rows = sweep.claim_new(sweep.judge_hits(answers, settings))
    return sweep.cell_outcomes(done.select(*sweep.FRONTIER), judged_rows, settings).select(
        "queue_pos", "result_count", "n_new", "split"
    )


_RUNS = [1, 2, 3]
_RUN_RADIUS = 2000.0


def _run_cells(run: int) -> str:
    box = BOX.replace("1000.0::double", f"{_RUN_RADIUS / run}::double")
    return f"(select queue_pos, lat, lng, radius_m, depth from {cover_sql(box)})"


_FOUND = " union all ".join(
    f"select {run} as run_id, place_id from {hits(_run_cells(run), POPULARITY_ORDER)}"
    " where user_rating_count >= 25"
    for run in _RUNS
)
_CALLS = " union all ".join(
    f"select {run} as run_id, count(*) as calls from {_run_cells(run)}" for run in _RUNS
)


@query(
    "recall_cost",
    f"""with found as ({_FOUND}), calls as ({_CALLS}),
      truth as (select place_id from {view_sql('places_v')} where user_rating_count >= 25),
      f as (select place_id, min(run_id) as run_id from found group by place_id),
      n as (select run_id, count(*) as n, count(t.place_id) as h
        from f left join truth as t using (place_id) group by run_id)
    select 'bar 25' as setting, run_id, calls, sum(calls) over w::bigint as cumulative_calls,
      sum(coalesce(n, 0)) over w::bigint as rows_stored,
      sum(coalesce(h, 0)) over w::bigint as true_found,
      round(sum(coalesce(h, 0)) over w / (select count(*) from truth), 6) as recall
    from calls left join n using (run_id)
    window w as (order by run_id rows unbounded preceding)""",
)
def recall_cost(spark, sf_dir):
    """Three runs with finer and finer cells: what each costs and what it finds."""
    places = view(spark, sf_dir, "places_v")
    found, calls = None, None
    for run in _RUNS:
        cells = box_cells(spark, sf_dir, _RUN_RADIUS / run)
        names = {"setting": F.lit("bar 25"), "run_id": F.lit(run)}
        hit = (
            capped_search(cells, places, ["queue_pos"], POPULARITY)
            .where("user_rating_count >= 25")
            .select("place_id")
            .withColumns(names)
        )
        n = cells.agg(F.count("*").alias("calls")).withColumns(names)
        found = hit if found is None else found.unionByName(hit)
        calls = n if calls is None else calls.unionByName(n)
    truth = places.where("user_rating_count >= 25").select("place_id")
    return report.recall_cost(found, calls, truth).withColumn("recall", F.round("recall", 6))


_KEYED = f"""(select *, round_even(lat * 1e6, 0)::bigint as lat_e6,
  round_even(lng * 1e6, 0)::bigint as lng_e6, round_even(radius_m * 10, 0)::bigint as radius_dm
  from {view_sql('cell_log_v')})"""


@query(
    "cell_log_latest",
    f"""select scope, lat_e6, lng_e6, radius_dm, arg_max(depth, searched_at) as depth,
      arg_max(result_count, searched_at) as result_count,
      arg_max(saturated, searched_at) as saturated, arg_max(split, searched_at) as split,
      max(searched_at) as searched_at
    from (select * replace (coalesce(scope, 'restaurant') as scope) from {_KEYED})
    group by scope, lat_e6, lng_e6, radius_dm""",
)
def cell_log_latest(spark, sf_dir):
    """One row per scope and cell; unscoped rows belong to the default scope."""
    log = sweep.with_scope(view(spark, sf_dir, "cell_log_v")).drop("seq")
    return sweep.latest_log(log).drop("lat", "lng", "radius_m")


_LOGGED = f"""(select *, row_number() over (
    partition by coalesce(scope, 'restaurant'), lat_e6, lng_e6, radius_dm order by searched_at desc, seq % 2 desc) as n
  from {_KEYED})"""


@query(
    "cell_log_table",
    f"""select coalesce(scope, 'restaurant') as scope, lat_e6, lng_e6, radius_dm, result_count, saturated, split,
      searched_at from {_LOGGED} where n = 1""",
)
def cell_log_table(spark, sf_dir):
    """Two appends and a resume read of a stored log; what it held before a reset is gone."""
    log = CellLog(spark, scratch_path(spark, "cell-log"))
    rows = view(spark, sf_dir, "cell_log_v")
    log.append(rows.limit(10).drop("seq").withColumn("result_count", F.lit(-1).cast("bigint")))
    log.reset()
    log.append(rows.where("seq % 2 = 0").drop("seq"))
    log.append(rows.where("seq % 2 = 1").drop("seq"))
    return log.latest().select(
        "scope", *CELL_KEY, "result_count", "saturated", "split", "searched_at"
    )


@query(
    "migrate_scope",
    f"""select seq, case when instr(cell_key, '|') = 0 then 'restaurant|' || cell_key
        else cell_key end as cell_key
    from (select seq, case when scope is null then k else scope || '|' || k end as cell_key
      from (select seq, scope, lat::decimal(9,6)::varchar || ',' || lng::decimal(9,6)::varchar
        as k from {view_sql('cell_log_v')}))""",
)
def migrate_scope(spark, sf_dir):
    text = F.concat_ws(
        ",",
        F.col("lat").cast("decimal(9,6)").cast("string"),
        F.col("lng").cast("decimal(9,6)").cast("string"),
    )
    key = F.when(F.col("scope").isNull(), text).otherwise(F.concat_ws("|", "scope", text))
    log = view(spark, sf_dir, "cell_log_v").select("seq", key.alias("cell_key"))
    return sweep.migrate_keys(log)


@query(
    "cell_summary",
    f"""select count(*) as cells, coalesce(sum(saturated::int), 0)::bigint as saturated,
      coalesce(max(depth), 0) as max_depth from {view_sql('cell_log_v')}""",
)
def cell_summary(spark, sf_dir):
    return report.cell_summary(view(spark, sf_dir, "cell_log_v"))
