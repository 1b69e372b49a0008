"""The adaptive cover: search cells level by level, split those that stay full.

One level is a fixed chain of DataFrame steps (``plan_level`` -> search ->
``judge_hits`` -> ``cell_outcomes`` -> ``next_frontier``); the driver only
repeats it, at most once per depth, and reads one row of counters per level.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeloom import fixed
from placeloom.functions.geo import CELL_KEY, with_cell_identity
from placeloom.operators.cover import split_children, within_limit
from placeloom.operators.filters import below_bar, has_key, wanted_kind
from placeloom.operators.grid import CircleProfile, class_set, search_radius
from placeloom.operators.numbering import first_rows, number_rows
from placeloom.operators.search import capped_search, rank_for
from placeloom.operators.skew import BROADCAST_ROWS
from placeloom.schemas import CELL_LOG
from placeloom.session import materialize, materialize_with, shuffle_width

FRONTIER = ["queue_pos", "lat", "lng", "radius_m", "depth", "copies"]

REASON_NOT_FULL = "not full"
REASON_BELOW_BAR = "below bar"
REASON_NOTHING_NEW = "nothing new"
REASON_DEPTH = "depth limit"
REASON_RADIUS = "radius floor"
REASON_SPLIT = "split"


@dataclass(frozen=True)
class SweepSettings:
    included_types: tuple[str, ...] = tuple(fixed.DEFAULT_TYPES)
    min_reviews: int = 0
    rank: str | None = None
    max_depth: int = fixed.DEFAULT_MAX_DEPTH
    min_radius_m: float = fixed.DEFAULT_MIN_RADIUS_M
    restaurants_only: bool = True
    resume: bool = True
    split_only_if_new: bool = False
    budget: int | None = None
    max_results: int = fixed.MAX_RESULTS_PER_SEARCH
    filter_types: bool = False

    @property
    def scope(self) -> str:
        return ",".join(sorted(self.included_types))


@dataclass
class SweepResult:
    log: DataFrame
    observations: DataFrame
    levels: list[dict] = field(default_factory=list)
    stopped_early: str | None = None

    def totals(self) -> dict:
        """Counters summed over levels; the deepest level searched."""
        out = {name: sum(level[name] for level in self.levels) for name in COUNTERS}
        out["max_depth"] = max((level["max_depth"] for level in self.levels), default=0)
        out["stopped_early"] = self.stopped_early
        return out


COUNTERS = [
    "cells_searched", "cells_skipped", "cells_split", "cells_failed",
    "cells_pruned", "cells_below_bar", "skipped_below_bar",
    "skipped_not_restaurant", "results_seen", "new_places",
]


def latest_log(log: DataFrame) -> DataFrame:
    """One row per scope and cell: the most recently searched one.

    A log with ``run_seq`` orders rows searched at the same time by it.
    """
    keyed = with_cell_identity(log)
    columns = [c for c in log.columns if c != "scope"]
    order = F.struct(*[c for c in ("searched_at", "run_seq") if c in log.columns])
    newest = F.max_by(F.struct(*columns), order).alias("_row")
    return keyed.groupBy("scope", *CELL_KEY).agg(newest).select(
        "scope", *CELL_KEY, *[F.col(f"_row.{c}").alias(c) for c in columns]
    )


def with_scope(log: DataFrame) -> DataFrame:
    """Rows logged before scopes existed belong to the default scope."""
    scope = F.coalesce(F.col("scope"), F.lit(fixed.LEGACY_SCOPE))
    return log.withColumn("scope", scope)


def migrate_keys(log: DataFrame) -> DataFrame:
    """Same rule for logs keyed by text: ``scope|lat,lng,radius``."""
    key = F.col("cell_key")
    scoped = F.when(
        F.instr(key, "|") == 0, F.concat(F.lit(f"{fixed.LEGACY_SCOPE}|"), key)
    ).otherwise(key)
    return log.withColumn("cell_key", scoped)


def merge_copies(frontier: DataFrame) -> DataFrame:
    """One row per geometry: the earliest in the queue, and how many there are.

    Later copies of a cell are searched by nobody (the first one is in the log
    by then) but still count as skipped, and so do the copies of its children.
    """
    first = F.min_by(F.struct("lat", "lng", "radius_m", "depth"), F.col("queue_pos"))
    merged = with_cell_identity(frontier).groupBy(*CELL_KEY).agg(
        F.min("queue_pos").alias("queue_pos"),
        F.sum("copies").cast("bigint").alias("copies"),
        first.alias("_cell"),
    )
    return merged.select(
        "queue_pos", "_cell.lat", "_cell.lng", "_cell.radius_m", "_cell.depth", "copies", *CELL_KEY
    )


def cell_history(log: DataFrame, scope: str) -> DataFrame:
    """One row per cell of a scope, (identity, split), from a raw log."""
    return latest_log(log.where(F.col("scope") == scope)).select(*CELL_KEY, "split")


def plan_level(
    frontier: DataFrame, history: DataFrame | None, resume: bool = True
) -> DataFrame:
    """Frontier x history: adds ``searched_before`` and ``split_before``.

    Cells meet on their geometry alone: depth and all search parameters except
    the scope the history was taken for are ignored.
    """
    cells = merge_copies(frontier) if resume else with_cell_identity(frontier)
    if not resume or history is None:
        return cells.withColumns(
            {"searched_before": F.lit(False), "split_before": F.lit(False)}
        )
    seen = history.select(*CELL_KEY, F.col("split").alias("_split"))
    joined = cells.join(seen, CELL_KEY, "left")
    return joined.withColumns(
        {
            "searched_before": F.col("_split").isNotNull(),
            "split_before": F.coalesce(F.col("_split"), F.lit(False)),
        }
    ).drop("_split")


def judge_hits(hits: DataFrame, settings: SweepSettings) -> DataFrame:
    """Flag every result: under the bar, wrong kind, kept.

    The bar is checked first, so a place under it never counts as a wrong kind.
    """
    low = below_bar(F.col("user_rating_count"), settings.min_reviews)
    wanted = F.lit(True)
    if settings.restaurants_only:
        wanted = wanted_kind(F.col("primary_type"), list(settings.included_types))
    return hits.withColumns(
        {
            "is_below_bar": low,
            "is_wrong_kind": ~low & ~wanted,
            "is_kept": ~low & wanted & has_key(F.col("place_id")),
        }
    )


def claim_new(
    judged: DataFrame, known_ids: DataFrame | None = None, max_hits: int | None = None
) -> DataFrame:
    """Flag new places, credited to the earliest cell in the queue that kept them.

    ``max_hits`` is the counted number of results; when it
    is small the ids in play are broadcast, so the ids ever stored are scanned
    but not shuffled.
    """
    kept = F.when(F.col("is_kept"), F.col("queue_pos"))
    # Results that are not kept (no id, wrong kind) claim nothing; they are
    # spread by cell instead of meeting under one missing id.
    by_place = Window.partitionBy(
        F.when(F.col("is_kept"), F.col("place_id")).otherwise(F.col("queue_pos").cast("string"))
    )
    claimed = judged.withColumn(
        "is_new", F.coalesce(F.min(kept).over(by_place) == F.col("queue_pos"), F.lit(False))
    ).withColumn("is_new", F.col("is_new") & F.col("is_kept"))
    if known_ids is None:
        return claimed
    known = known_ids.select("place_id")
    if max_hits is not None and max_hits <= BROADCAST_ROWS:
        in_play = judged.select("place_id")
        known = known.join(F.broadcast(in_play), "place_id", "left_semi")
    known = known.distinct().withColumn("_known", F.lit(True))
    return claimed.join(known, "place_id", "left").withColumn(
        "is_new", F.col("is_new") & F.col("_known").isNull()
    ).drop("_known")


def split_reason(settings: SweepSettings) -> Column:
    """Why a searched cell is or is not split; the order of checks matters."""
    count, low, new = F.col("result_count"), F.col("n_below_bar"), F.col("n_new")
    reason = F.when(count < fixed.MAX_RESULTS_PER_SEARCH, REASON_NOT_FULL)
    if settings.min_reviews:
        reason = reason.when(low > 0, REASON_BELOW_BAR)
    if settings.split_only_if_new:
        reason = reason.when(new == 0, REASON_NOTHING_NEW)
    reason = reason.when(F.col("depth") >= settings.max_depth, REASON_DEPTH)
    reason = reason.when(F.col("radius_m") / 2 < settings.min_radius_m, REASON_RADIUS)
    return reason.otherwise(REASON_SPLIT)


def cell_outcomes(cells: DataFrame, judged: DataFrame, settings: SweepSettings) -> DataFrame:
    """Per searched cell: counters, saturation and the split decision."""
    count = lambda flag: F.count_if(F.col(flag))
    per_cell = judged.groupBy("queue_pos").agg(
        F.count("*").alias("result_count"),
        count("is_below_bar").alias("n_below_bar"),
        count("is_wrong_kind").alias("n_not_restaurant"),
        count("is_kept").alias("n_kept"),
        count("is_new").alias("n_new"),
    )
    counters = ["result_count", "n_below_bar", "n_not_restaurant", "n_kept", "n_new"]
    outcome = cells.join(per_cell, "queue_pos", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in counters}
    )
    outcome = outcome.withColumn(
        "saturated", F.col("result_count") >= fixed.MAX_RESULTS_PER_SEARCH
    )
    outcome = outcome.withColumn("reason", split_reason(settings))
    return outcome.withColumn("split", F.col("reason") == REASON_SPLIT)


def next_frontier(skipped: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Children of cells split now and of skipped cells that were split before."""
    now = outcomes.where("split").select(*FRONTIER)
    before = skipped.where("split_before").select(*FRONTIER)
    return split_children(now.unionByName(before)).select(*FRONTIER)


def log_rows(outcomes: DataFrame, scope: str, searched_at: datetime) -> DataFrame:
    return outcomes.select(
        F.lit(scope).alias("scope"), "lat", "lng", "radius_m", "depth", "result_count",
        "saturated", "split", F.lit(searched_at).cast("timestamp").alias("searched_at"),
    )


def level_counters() -> dict[str, Column]:
    """Counters over searched cells.

    Pruned and below-bar cells are counted among full cells only.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    reason = F.col("reason")
    return {
        "cells_searched": F.count(F.lit(1)),
        "cells_split": F.count_if(F.col("split")),
        "cells_pruned": F.count_if(reason == REASON_NOTHING_NEW),
        "cells_below_bar": F.count_if(reason == REASON_BELOW_BAR),
        "skipped_below_bar": total("n_below_bar"),
        "skipped_not_restaurant": total("n_not_restaurant"),
        "results_seen": total("result_count"),
        "new_places": total("n_new"),
        "max_depth": F.coalesce(F.max("depth"), F.lit(0)),
    }


def plan_measures() -> dict[str, Column]:
    """What the driver must know about a planned level before searching it."""
    before, copies = F.col("searched_before"), F.col("copies")
    skipped = F.sum(F.when(before, copies).otherwise(copies - 1))
    radius = search_radius(F.col("radius_m"), fixed.MAX_SEARCH_RADIUS_M)
    return {
        "cells": F.count(F.lit(1)),
        "todo": F.count_if(~before),
        "skipped": F.coalesce(skipped, F.lit(0)).cast("bigint"),
        "classes": class_set(radius),
    }


def start_frontier(cells: DataFrame) -> DataFrame:
    """Level-0 cells as a frontier, whose ``queue_pos`` is unique.

    Covers number the cells of each area on their own.  Cells of several areas are
    numbered anew, area by area; without ``area_id`` repeated numbers are an error,
    because results, claims and counters are kept by them.  Cells wider than a search
    reaches are replaced by covers of cells that are not, and all are numbered anew.
    """
    n = cells.agg(
        F.count("*").alias("rows"),
        F.count_distinct("queue_pos").alias("numbers"),
        F.count_if(F.col("radius_m") > fixed.MAX_SEARCH_RADIUS_M).alias("wide"),
    ).first()
    if n.wide:
        order = [c for c in ("area_id", "queue_pos", "part") if c == "part" or c in cells.columns]
        if n.rows != n.numbers and "area_id" not in cells.columns:
            raise ValueError("queue_pos repeats and there is no area_id to tell cells apart")
        parted = within_limit(cells).withColumnRenamed("queue_pos", "_area_pos")
        cells = number_rows(parted, [F.col("_area_pos" if c == "queue_pos" else c) for c in order], "queue_pos")
    elif n.rows != n.numbers:
        if "area_id" not in cells.columns:
            raise ValueError("queue_pos repeats and there is no area_id to tell cells apart")
        cells = number_rows(
            cells.withColumnRenamed("queue_pos", "_area_pos"), [F.col("area_id"), F.col("_area_pos")], "queue_pos"
        )
    return cells.select("queue_pos", "lat", "lng", "radius_m", "depth").withColumn(
        "copies", F.lit(1).cast("bigint")
    )


# (cells, profile or None) -> (hits, cells that failed or None)
SearchFn = Callable[[DataFrame, CircleProfile | None], tuple[DataFrame, DataFrame | None]]


def place_table_search(places: DataFrame, settings: SweepSettings) -> SearchFn:
    """Search a place table; nothing fails.

    Every level scans the places, so the few columns a search needs are written
    once, evenly spread by place.
    """
    types = list(settings.included_types) if settings.filter_types else None
    columns = ["place_id", "latitude", "longitude", "user_rating_count", "primary_type"]
    if types and "types" in places.columns:
        columns.append("types")
    width = shuffle_width(places.sparkSession)
    narrow = materialize(places.select(*columns).repartition(width, "place_id"), "points")

    def search(cells: DataFrame, profile: CircleProfile | None = None):
        hits = capped_search(
            cells,
            narrow,
            ["queue_pos"],
            rank=rank_for(settings.min_reviews, settings.rank),
            max_results=settings.max_results,
            included_types=types,
            profile=profile,
        )
        return hits, None

    return search


def landed_results_search(results: DataFrame) -> SearchFn:
    """Join landed results, one row per cell identity and result.

    ``results``: lat_e6, lng_e6, radius_dm, place_id, user_rating_count,
    primary_type, status ('ok' | 'failed').  An empty answer is one row with
    NULL place_id and status 'empty'.  Cells without any row have not been
    answered yet and count as failed: they are not logged, so the next run
    asks again.  With ``answered_at`` only the newest answer of a cell counts;
    without it a failure counts only while nothing else has landed.
    """
    if "answered_at" in results.columns:
        newest = results.groupBy(*CELL_KEY).agg(F.max("answered_at").alias("answered_at"))
        results = results.join(newest, [*CELL_KEY, "answered_at"], "left_semi")

    def search(cells: DataFrame, profile: CircleProfile | None = None):
        answered = cells.select("queue_pos", *CELL_KEY).join(results, CELL_KEY, "left")
        answered = materialize(answered, "landed")
        failed = (
            answered.groupBy("queue_pos")
            .agg(F.count_if(F.col("status") != "failed").alias("answers"))
            .where("answers = 0")
            .select("queue_pos")
        )
        hits = answered.where("status = 'ok'").join(failed, "queue_pos", "left_anti")
        return hits.select("queue_pos", "place_id", "user_rating_count", "primary_type"), failed

    return search


def run_sweep(
    cells: DataFrame,
    search: SearchFn,
    settings: SweepSettings,
    log: DataFrame | None = None,
    known_ids: DataFrame | None = None,
    as_of: datetime | None = None,
) -> SweepResult:
    """Sweep breadth-first until nothing is left to split or the budget ends.

    ``log`` is the resume log of earlier runs (any scope), ``known_ids`` the
    place ids already stored.  ``as_of`` is the time the cells are logged with; without
    it that is the time of the run, and a rerun logs another.  The budget counts searches of this run only;
    skipped cells are free.  Per level three narrow tables are written to the
    shared folder, so lineage never grows with depth.
    """
    spark = cells.sparkSession
    as_of = as_of or datetime.now()
    frontier = start_frontier(cells)
    history = []
    if log is not None:
        history = [materialize(cell_history(with_scope(log), settings.scope), "history")]
    stored = [] if known_ids is None else [known_ids.select("place_id").distinct()]
    logs: list[DataFrame] = []
    kept: list[DataFrame] = []
    levels: list[dict] = []
    stopped_early = None
    remaining = settings.budget

    while True:
        planned, level = materialize_with(
            plan_level(frontier, _union(history), settings.resume), "level", **plan_measures()
        )
        if not level["cells"]:
            break
        todo = planned.where(~F.col("searched_before"))
        n_todo = level["todo"]
        out_of_budget = remaining is not None and n_todo > remaining
        if out_of_budget:
            todo = materialize(first_rows(todo, [F.col("queue_pos")], remaining, [F.col("queue_pos")]), "in-budget")
            n_todo = remaining
            # The queue ends at the first cell not searched: nothing behind it is skipped.
            taken = F.coalesce(F.max("queue_pos"), F.lit(-1)).alias("last")
            last = todo.agg(taken).first()["last"]
            rest = planned.where(~F.col("searched_before") & (F.col("queue_pos") > last))
            end = rest.agg(F.min("queue_pos")).first()[0]
            level["skipped"] = planned.where(F.col("queue_pos") < end).agg(plan_measures()["skipped"]).first()[0]

        hits, failed = search(todo, CircleProfile(n_todo, tuple(sorted(level["classes"]))))
        done, n_failed, failed_copies = todo, 0, 0
        if failed is not None:
            failed, tried = materialize_with(
                todo.join(failed, "queue_pos", "left_semi").select("queue_pos", "copies"),
                "failed",
                n=F.coalesce(F.sum("copies"), F.lit(0)),
                cells=F.count(F.lit(1)),
            )
            n_failed, failed_copies = tried["n"], tried["n"] - tried["cells"]
            done = todo.join(failed, "queue_pos", "left_anti")
        judged, seen = materialize_with(judge_hits(hits, settings), "hits", n=F.count(F.lit(1)))
        claimed = materialize(claim_new(judged, _union(stored), seen["n"]), "claimed")
        outcomes, counters = materialize_with(
            cell_outcomes(done.select(*FRONTIER), claimed, settings),
            "outcomes",
            **level_counters(),
        )
        counters["cells_failed"] = n_failed
        # Copies of a failed cell are tried, and fail, like the first.
        counters["cells_skipped"] = level["skipped"] - failed_copies
        found = judged.where("is_kept").select(
            "place_id", "queue_pos", F.lit(len(levels)).alias("level")
        )
        levels.append(counters)
        history.append(with_cell_identity(outcomes).select(*CELL_KEY, "split"))
        logs.append(log_rows(outcomes, settings.scope, as_of))
        kept.append(found)
        # Only ids not stored before: each place is in the union once.
        stored.append(claimed.where("is_new").select("place_id"))
        if out_of_budget:
            stopped_early = f"request budget of {settings.budget} calls is used up"
            break
        if remaining is not None:
            remaining -= n_todo
        frontier = next_frontier(planned.where("searched_before"), outcomes)

    empty = "place_id string, queue_pos bigint, level int"
    return SweepResult(
        log=_union(logs) if logs else spark.createDataFrame([], CELL_LOG),
        observations=_union(kept) if kept else spark.createDataFrame([], empty),
        levels=levels,
        stopped_early=stopped_early,
    )


def first_sightings(result: SweepResult) -> DataFrame:
    """Each place of a sweep once, with the level and cell that found it first."""
    first = F.min(F.struct("level", "queue_pos")).alias("f")
    return result.observations.groupBy("place_id").agg(first).select(
        "place_id", "f.level", "f.queue_pos"
    )


def _union(frames: list[DataFrame]) -> DataFrame | None:
    out = None
    for frame in frames:
        out = frame if out is None else out.unionByName(frame)
    return out
