"""Covering areas with search cells, splitting cells, sizing to a budget."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom import fixed
from placeloom.functions.geo import (
    bbox_area_m2,
    cell_radius_for_budget,
    disc_area_m2,
    haversine_m,
    metres_per_degree_lng,
    offset_lat,
    offset_lng,
)
from placeloom.session import materialize_with, shuffle_width

# More columns than a row of the smallest allowed cells has around the equator.
ROW_STRIDE = 1 << 21
_STEP = math.sqrt(2.0) * fixed.COVERAGE_MARGIN


def _steps(extent, step):
    """Grid intervals over ``extent``: at least one."""
    return F.greatest(F.lit(1), F.ceil(extent / step)).cast("bigint")


def cover_bbox(areas: DataFrame) -> DataFrame:
    """Cells covering each box (area_id, south, west, north, east, cell_radius_m).

    Other columns of ``areas`` are kept.  ``queue_pos`` orders the cells of an
    area south to north, west to east: row number times ``ROW_STRIDE`` plus
    column number, so no task has to count the cells of another.  Latitude rows
    are generated first and spread over the cluster, so one huge area does not
    expand inside one task.
    """
    spacing = F.col("cell_radius_m") * F.lit(_STEP)
    bad_box = (F.col("north") < F.col("south")) | (F.col("east") < F.col("west"))
    checked = (
        F.when(bad_box, F.raise_error(F.lit("need south <= north and west <= east")))
        .when(F.col("cell_radius_m") <= 0, F.raise_error(F.lit("cell_radius_m must be positive")))
        .otherwise(spacing)
    )
    carried = areas.columns
    lat_step = F.col("_spacing") / F.lit(fixed.METRES_PER_DEGREE_LAT)
    zero = F.lit(0).cast("bigint")
    rows = areas.withColumn("_spacing", checked).select(
        "*",
        F.explode(
            F.sequence(zero, _steps(F.col("north") - F.col("south"), lat_step))
        ).alias("i"),
    )
    lat = F.col("south") + F.col("i") * lat_step
    lng_step = F.col("_spacing") / metres_per_degree_lng(F.col("lat"))
    rows = rows.withColumn("lat", lat).where(F.col("lat") <= F.col("north") + lat_step)
    rows = rows.select(
        *carried,
        "i",
        "lat",
        lng_step.alias("_lng_step"),
        _steps(F.col("east") - F.col("west"), lng_step).alias("_cols"),
    ).repartition(shuffle_width(areas.sparkSession), "area_id", "i")
    # Columns j = 0.._cols; the last may overshoot by at most one step.
    cells = rows.select("*", F.explode(F.sequence(zero, _kept_columns() - 1)).alias("j"))
    return cells.select(
        *carried,
        "i",
        "j",
        "lat",
        (F.col("west") + F.col("j") * F.col("_lng_step")).alias("lng"),
        F.col("cell_radius_m").alias("radius_m"),
        F.lit(0).alias("depth"),
        (F.col("i") * ROW_STRIDE + F.col("j")).alias("queue_pos"),
    )


def _kept_columns():
    """How many of the columns 0.._cols start no further than one step past east."""
    last = F.col("west") + F.col("_cols") * F.col("_lng_step")
    return F.when(
        last > F.col("east") + F.col("_lng_step"), F.col("_cols")
    ).otherwise(F.col("_cols") + 1)


def _disc_boxes(areas: DataFrame) -> DataFrame:
    radius = F.col("area_radius_m")
    checked = F.when(
        radius <= 0, F.raise_error(F.lit("area_radius_m must be positive"))
    ).otherwise(radius)
    lat_pad = checked / F.lit(fixed.METRES_PER_DEGREE_LAT)
    lng_pad = checked / metres_per_degree_lng(F.col("center_lat"))
    return areas.withColumns(
        {
            "cell_radius_m": F.least(F.col("cell_radius_m"), radius),
            "south": F.col("center_lat") - lat_pad,
            "north": F.col("center_lat") + lat_pad,
            "west": F.col("center_lng") - lng_pad,
            "east": F.col("center_lng") + lng_pad,
        }
    )


def touches_area():
    """Cells whose centre lies within area radius plus own radius."""
    distance = haversine_m(
        F.col("center_lat"), F.col("center_lng"), F.col("lat"), F.col("lng")
    )
    return distance <= F.col("area_radius_m") + F.col("radius_m")


def cover_disc(areas: DataFrame) -> DataFrame:
    """Cells covering each disc (area_id, center_lat, center_lng, area_radius_m,
    cell_radius_m)."""
    return cover_bbox(_disc_boxes(areas)).where(touches_area())


def within_limit(cells: DataFrame, limit_m: float = fixed.MAX_SEARCH_RADIUS_M) -> DataFrame:
    """Cells with those wider than a search may be replaced by a cover of smaller ones.

    A search is cut off at ``limit_m``, so a wider cell would leave a ring unsearched.
    ``part`` numbers the cells that stand for one; it is 0 for a cell kept as it is.
    """
    wide = F.col("radius_m") > limit_m
    named = [c for c in cells.columns if c not in ("lat", "lng", "radius_m", "depth", "queue_pos")]
    kept = cells.where(~wide).withColumn("part", F.lit(0).cast("bigint"))
    areas = cells.where(wide).select(
        F.struct("queue_pos", "depth", *named).alias("_of"),
        F.xxhash64("queue_pos", "lat", "lng").alias("area_id"),
        F.col("lat").alias("center_lat"),
        F.col("lng").alias("center_lng"),
        F.col("radius_m").alias("area_radius_m"),
        F.lit(float(limit_m)).alias("cell_radius_m"),
    )
    parts = cover_disc(areas).select(
        "_of.*", "lat", "lng", "radius_m", (F.col("queue_pos") + 1).alias("part")
    )
    return kept.unionByName(parts.select(*kept.columns))


def split_children(cells: DataFrame) -> DataFrame:
    """Four half-offset children per cell, in order, one level deeper.

    ``queue_pos`` of a child is ``4 * parent + k``: breadth-first order is kept
    without sorting anything.
    """
    half = F.col("radius_m") / 2
    corners = [(-half, -half), (-half, half), (half, -half), (half, half)]
    children = F.array(
        *[
            F.struct(
                offset_lat(F.col("lat"), north).alias("lat"),
                offset_lng(F.col("lat"), F.col("lng"), east).alias("lng"),
                (F.col("radius_m") / F.lit(math.sqrt(2.0)) / F.lit(fixed.COVERAGE_MARGIN)).alias(
                    "radius_m"
                ),
                (F.col("depth") + 1).alias("depth"),
                (F.col("queue_pos") * 4 + k).alias("queue_pos"),
            )
            for k, (east, north) in enumerate(corners)
        ]
    )
    made = ["lat", "lng", "radius_m", "depth", "queue_pos"]
    kept = [c for c in cells.columns if c not in made]
    return cells.select(*kept, F.explode(children).alias("_child")).select(
        *kept, *[F.col(f"_child.{c}").alias(c) for c in made]
    )


def with_area_m2(areas: DataFrame) -> DataFrame:
    """Area of a disc when it has a centre, else of its box."""
    disc = disc_area_m2(F.col("area_radius_m"))
    box = bbox_area_m2(F.col("south"), F.col("west"), F.col("north"), F.col("east"))
    return areas.withColumn(
        "area_m2", F.when(F.col("center_lat").isNotNull(), disc).otherwise(box)
    )


def count_cells(areas: DataFrame) -> DataFrame:
    """The areas (a mix of discs and boxes) with ``n_cells``; no cell is kept."""
    given = F.struct("cell_radius_m", "south", "west", "north", "east")
    named = areas.withColumn("_given", given)
    discs = _disc_boxes(named.where(F.col("center_lat").isNotNull()))
    boxes = named.where(F.col("center_lat").isNull())
    cells = cover_bbox(discs.unionByName(boxes))
    touching = cells.where(F.col("center_lat").isNull() | touches_area())
    plain = [c for c in areas.columns if c not in ("cell_radius_m", "south", "west", "north", "east")]
    counted = touching.groupBy(*plain, "_given").agg(F.count("*").alias("n_cells"))
    return counted.select(*plain, "_given.*", "n_cells")


def start_radius(areas: DataFrame) -> DataFrame:
    """Closed-form first guess: the given radius, or one sized to the budget."""
    guess = cell_radius_for_budget(F.col("area_m2"), F.col("budget"))
    return with_area_m2(areas).withColumn(
        "cell_radius_m", F.when(F.col("budget").isNull(), F.col("cell_radius_m")).otherwise(guess)
    )


def fit_areas(areas: DataFrame, passes: int = fixed.FIT_PASSES) -> DataFrame:
    """Grow starting radii until each area's grid fits its budget share.

    ``areas``: area_id, center_lat, center_lng, area_radius_m, south, west,
    north, east, cell_radius_m, budget (NULL keeps the given radius).  Areas
    that fit drop out of later passes; one whose radius hits the clamp may
    never fit and keeps its last radius, as with any fixed number of passes:
    ``fits`` is false for it.
    Returns the areas with their radius, area_m2, ``n_cells`` and ``fits``.
    """
    target = F.greatest(F.lit(1), F.floor(F.col("budget") * F.lit(fixed.BUDGET_GRID_SHARE)))
    pending = start_radius(areas)
    columns = pending.columns
    # greatest() skips NULLs, so an area without a budget needs its own test.
    over = F.col("budget").isNotNull() & (F.col("n_cells") > target)
    done = []
    for attempt in range(passes + 1):
        counted, seen = materialize_with(
            count_cells(pending), "fit", over=F.count_if(over)
        )
        if attempt == passes or not seen["over"]:
            done.append(counted)
            break
        done.append(counted.where(~over))
        grown = F.col("cell_radius_m") * (
            F.sqrt(F.col("n_cells") / target) * F.lit(fixed.FIT_GROWTH)
        )
        pending = counted.where(over).withColumn("cell_radius_m", grown).select(*columns)
    fitted = done[0]
    for part in done[1:]:
        fitted = fitted.unionByName(part)
    return fitted.withColumn("fits", ~over)


def estimate_cost(fitted: DataFrame, min_reviews: int, price_per_call: float) -> DataFrame:
    """Low and high number of searches per area, and what they cost."""
    base = F.col("n_cells")
    if min_reviews:
        high = F.floor(base * F.lit(fixed.ESTIMATE_HIGH_WITH_BAR))
    else:
        high = base * fixed.ESTIMATE_HIGH_CENSUS
    high = F.when(F.col("budget") < high, F.col("budget")).otherwise(high).cast("bigint")
    price = F.lit(float(price_per_call))
    estimated = fitted.withColumn("high_calls", high)
    estimated = estimated.withColumn("low_calls", F.least(base, F.col("high_calls")))
    return estimated.withColumns(
        {"low_cost": F.col("low_calls") * price, "high_cost": F.col("high_calls") * price}
    )


def price_for_tier(tier: str, override: float | None = None) -> float:
    if override is not None:
        return override
    return fixed.PRICE_PER_CALL.get(tier, fixed.DEFAULT_PRICE_PER_CALL)
