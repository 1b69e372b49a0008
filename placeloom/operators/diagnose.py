"""Why a target is missing, from the sweep's own cell log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom import fixed
from placeloom.functions.geo import position
from placeloom.operators.grid import within_circles
from placeloom.operators.pyramid import nearest_edges
from placeloom.operators.skew import BROADCAST_ROWS, SIDE_ROWS
from placeloom.session import materialize, materialize_with

_CELL = ["lat", "lng", "radius_m"]


def _positions(targets: DataFrame) -> DataFrame:
    lat, lng = position(F.col("lat"), F.col("lng"))
    return targets.select("target_id", lat.alias("p_lat"), lng.alias("p_lng"))


def diagnose(
    misses: DataFrame,
    cells: DataFrame,
    broadcast_rows: int = BROADCAST_ROWS,
    side_rows: int = SIDE_ROWS,
) -> DataFrame:
    """Reason and detail per missing target.

    ``misses``: target_id, lat, lng (numbers or text); ``cells``: lat, lng,
    radius_m, saturated.  Columns out: target_id, reason, circles,
    n_saturated, smallest_radius_m, gap_m.
    """
    options = {"broadcast_rows": broadcast_rows, "side_rows": side_rows}
    positions = materialize(_positions(misses), "misses")
    placed = positions.where("p_lat is not null and p_lng is not null")
    pairs = within_circles(cells, placed, _CELL, ["target_id"], max_radius_m=None, **options)
    covering = materialize(
        pairs.groupBy("target_id").agg(
            F.count("*").alias("circles"),
            F.count_if(F.coalesce(F.col("saturated"), F.lit(False))).alias("n_saturated"),
            F.min("radius_m").alias("smallest_radius_m"),
        ),
        "covering",
    )
    uncovered, seen = materialize_with(
        placed.join(covering, "target_id", "left_anti"), "uncovered", n=F.count(F.lit(1))
    )
    gaps = nearest_edges(uncovered, cells, **options) if seen["n"] else None

    out = positions.join(covering, "target_id", "left")
    if gaps is None:
        out = out.withColumn("gap_m", F.lit(None).cast("double"))
    else:
        out = out.join(gaps, "target_id", "left")
    unplaced = F.col("p_lat").isNull() | F.col("p_lng").isNull()
    reason = (
        F.when(unplaced, fixed.REASON_NO_POSITION)
        .when(F.col("circles").isNull(), fixed.REASON_NEVER_SEARCHED)
        .when(F.col("n_saturated") == F.col("circles"), fixed.REASON_SATURATED)
        .otherwise(fixed.REASON_NOT_RETURNED)
    )
    return out.select(
        "target_id",
        reason.alias("reason"),
        F.when(~unplaced, F.coalesce(F.col("circles"), F.lit(0))).alias("circles"),
        "n_saturated",
        "smallest_radius_m",
        "gap_m",
    )


def reason_counts(diagnosed: DataFrame) -> DataFrame:
    return diagnosed.groupBy("reason").agg(F.count("*").alias("n"))
