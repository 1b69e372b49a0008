"""The nearest circle edge of far points, by a pyramid of tiles.

Circles are summed up in tiles of latitude and longitude, sixteen to the next larger one:
the box of their centres, their largest radius, and one circle that has it.  The distance
to the box less that radius is a lower bound of a point's gap to any circle of the tile,
the gap to the one circle an upper bound of the nearest.  From the largest tiles down, a
point keeps those whose lower bound is not above its least upper bound, and looks into
their sixteen parts; only the circles of the last tiles kept are measured.  So a point
meets a few tiles per level however far away all circles are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeloom import fixed
from placeloom.functions.geo import haversine_m
from placeloom.operators.skew import BROADCAST_ROWS, SIDE_ROWS, balanced_join
from placeloom.session import materialize_with

# Tile sizes in degrees, largest first.
SIZES = [64.0, 16.0, 4.0, 1.0, 0.25, 0.0625, 0.015625]
_TILE = ["t_row", "t_col"]
# More than the rounding of any distance on the globe.
_SLACK_M = 0.01


@dataclass(frozen=True)
class Pyramid:
    """``levels[k]``: the tiles of ``SIZES[k]``; ``cells`` know their tile of the last level."""

    levels: list[DataFrame]
    cells: DataFrame
    n_cells: int
    n_tiles: int


def _tile_of(lat: Column, lng: Column, size: float) -> dict[str, Column]:
    return {
        "t_row": F.floor((lat + 90.0) / size).cast("int"),
        "t_col": F.floor(F.pmod(lng + 180.0, F.lit(360.0)) / size).cast("int"),
    }


def build(cells: DataFrame) -> Pyramid:
    """``cells``: lat, lng, radius_m; copies and rows without a position count once or not at all."""
    lng = F.pmod(F.col("lng") + 180.0, F.lit(360.0)) - 180.0
    placed = cells.where("lat is not null and lng is not null and radius_m is not null").select(
        "lat", lng.alias("lng"), F.col("radius_m").cast("double").alias("radius_m")
    )
    keyed = placed.distinct().withColumns(_tile_of(F.col("lat"), F.col("lng"), SIZES[-1]))
    keyed, seen = materialize_with(keyed, "pyramid-cells", n=F.count(F.lit(1)))
    box = [F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east")]
    widest = F.max(F.struct("radius_m", "lat", "lng")).alias("c")
    last, tiles = materialize_with(keyed.groupBy(*_TILE).agg(*box, widest), "pyramid-tiles", n=F.count(F.lit(1)))
    levels = [last]
    for size, below in zip(SIZES[-2::-1], SIZES[:0:-1]):
        parts = int(size / below)
        up = levels[0].withColumns({c: F.floor(F.col(c) / parts).cast("int") for c in _TILE})
        box = [F.min("south").alias("south"), F.max("north").alias("north"), F.min("west").alias("west"), F.max("east").alias("east")]
        levels.insert(0, up.groupBy(*_TILE).agg(*box, F.max("c").alias("c")))
    return Pyramid(levels, keyed, seen["n"], tiles["n"])


def _most_tiles(size: float) -> int:
    """Tiles of a size on the whole globe."""
    return int(360 / size + 1) * int(180 / size + 1)


def box_distance_m(lat: Column, lng: Column) -> Column:
    """The distance from a point to the box south..north, west..east.

    Beside the box the nearest point lies on its nearer meridian: where a great circle
    through the point meets it squarely, or at an end of the edge.
    """
    turn = lambda x: F.abs(F.pmod(x + 180.0, F.lit(360.0)) - 180.0)
    beside = F.least(turn(lng - F.col("west")), turn(lng - F.col("east")))
    foot = F.degrees(F.atan2(F.sin(F.radians(lat)), F.cos(F.radians(lat)) * F.cos(F.radians(beside))))
    on_edge = F.least(F.greatest(foot, F.col("south")), F.col("north"))
    to_edge = F.least(*[haversine_m(lat, F.lit(0.0), to, beside) for to in (on_edge, F.col("south"), F.col("north"))])
    above = F.radians(F.greatest(F.col("south") - lat, lat - F.col("north"), F.lit(0.0)))
    return F.when(lng.between(F.col("west"), F.col("east")), F.lit(fixed.EARTH_RADIUS_M) * above).otherwise(to_edge)


def _promising(pairs: DataFrame) -> DataFrame:
    """Pairs of a point and a tile that may hold its nearest edge, with the point's upper bound."""
    lat, lng, c = F.col("p_lat"), F.col("p_lng"), F.col("c")
    upper = haversine_m(lat, lng, c["lat"], c["lng"]) - c["radius_m"]
    lower = box_distance_m(lat, lng) - c["radius_m"]
    least = F.min("_upper").over(Window.partitionBy("target_id"))
    bounded = pairs.select("target_id", "p_lat", "p_lng", *_TILE, lower.alias("_lower"), upper.alias("_upper"))
    kept = bounded.withColumn("_least", least).where(F.col("_lower") <= F.col("_least") + _SLACK_M)
    return kept.select("target_id", "p_lat", "p_lng", *_TILE)


def candidates(targets: DataFrame, pyramid: Pyramid, **options) -> DataFrame:
    """target_id, p_lat, p_lng with the last tiles that may hold its nearest edge.

    ``targets``: target_id, p_lat, p_lng, one row per id, all placed.
    """
    top = pyramid.levels[0].select(F.struct(*_TILE, "south", "north", "west", "east", "c").alias("t"))
    tiles = [r.t for r in top.collect()]  # at most 21 on the whole globe
    if not tiles:
        return targets.limit(0).select("target_id", "p_lat", "p_lng", F.lit(0).alias("t_row"), F.lit(0).alias("t_col"))
    listed = targets.sparkSession.createDataFrame([(tiles,)], f"ts array<{top.schema['t'].dataType.simpleString()}>")
    # One row with the few largest tiles; each point takes all of them.
    pairs = targets.join(F.broadcast(listed)).select("target_id", "p_lat", "p_lng", F.explode("ts").alias("t"))
    pairs = _promising(pairs.select("target_id", "p_lat", "p_lng", "t.*"))
    for size, above, tiles in zip(SIZES[1:], SIZES, pyramid.levels[1:]):
        parts = int(above / size)
        inside = tiles.withColumns({f"u_{c}": F.floor(F.col(c) / parts).cast("int") for c in _TILE})
        named = pairs.select("target_id", "p_lat", "p_lng", *[F.col(c).alias(f"u_{c}") for c in _TILE])
        key = [f"u_{c}" for c in _TILE]
        if min(_most_tiles(size), pyramid.n_tiles) <= BROADCAST_ROWS:
            found = named.join(F.broadcast(inside), key)
        else:
            found = balanced_join(named, inside, key, ["target_id"], _TILE, **options)
        pairs = _promising(found)
    return pairs


def nearest_edges(
    targets: DataFrame,
    cells: DataFrame,
    broadcast_rows: int = BROADCAST_ROWS,
    side_rows: int = SIDE_ROWS,
    pyramid: Pyramid | None = None,
) -> DataFrame:
    """target_id, gap_m: how far each point is from the nearest circle's edge.

    The gap of a point inside a circle is negative.  No circles give no rows.
    """
    options = {"broadcast_rows": broadcast_rows, "side_rows": side_rows}
    pyramid = pyramid or build(cells)
    pairs = candidates(targets, pyramid, **options)
    met = balanced_join(pairs, pyramid.cells, _TILE, ["target_id"], ["lat", "lng", "radius_m"], **options)
    gap = haversine_m(F.col("p_lat"), F.col("p_lng"), F.col("lat"), F.col("lng")) - F.col("radius_m")
    return met.groupBy("target_id").agg(F.min(gap).alias("gap_m"))
