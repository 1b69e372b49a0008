"""Capped searches of a place table: the best few places inside each cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeloom import fixed
from placeloom.operators.filters import has_any_type
from placeloom.operators.grid import CircleProfile, within_circles
from placeloom.operators.skew import BROADCAST_ROWS, SIDE_ROWS

DISTANCE = "DISTANCE"
POPULARITY = "POPULARITY"


def rank_for(min_reviews: int, rank: str | None = None) -> str:
    """Popularity makes a review bar a usable stop; distance makes a census."""
    return rank or (POPULARITY if min_reviews else DISTANCE)


def _rank_order(rank: str) -> list:
    if rank == DISTANCE:
        return [F.col("distance_m").asc(), F.col("place_id").asc()]
    if rank == POPULARITY:
        return [F.col("user_rating_count").desc_nulls_last(), F.col("place_id").asc()]
    raise ValueError(f"rank must be {DISTANCE} or {POPULARITY}, not {rank!r}")


def capped_search(
    cells: DataFrame,
    places: DataFrame,
    cell_key: list[str],
    rank: str = DISTANCE,
    max_results: int = fixed.MAX_RESULTS_PER_SEARCH,
    included_types: list[str] | None = None,
    keep: tuple[str, ...] = ("user_rating_count", "primary_type"),
    broadcast_rows: int = BROADCAST_ROWS,
    side_rows: int = SIDE_ROWS,
    profile: CircleProfile | None = None,
) -> DataFrame:
    """The top places of every cell with ``result_rank`` and ``distance_m``.

    Only the columns that rank and judge a place travel through the join; the
    rank limit is applied per task before the shuffle (``WindowGroupLimit``),
    so a cell holding a large part of all places sends a few rows per task.
    """
    limit = min(int(max_results), fixed.MAX_RESULTS_PER_SEARCH)
    found = places
    if included_types and "types" in places.columns:
        found = found.where(has_any_type(F.col("types"), included_types))
    found = found.select(
        "place_id", F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lng"), *keep
    )
    circles = cells.select(*cell_key, "lat", "lng", "radius_m")
    pairs = within_circles(
        circles,
        found,
        cell_key,
        ["place_id"],
        broadcast_rows=broadcast_rows,
        side_rows=side_rows,
        profile=profile,
    )
    by_cell = Window.partitionBy(*cell_key).orderBy(*_rank_order(rank))
    ranked = pairs.select(*cell_key, "place_id", "distance_m", *keep).withColumn(
        "result_rank", F.row_number().over(by_cell)
    )
    return ranked.where(F.col("result_rank") <= limit)
