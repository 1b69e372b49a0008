"""Distances, offsets, cell identity and area expressions (all JVM-side)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeloom import fixed
from placeloom.functions.text import strip

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres; NULL when any coordinate is NULL."""
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    s_phi = F.sin((phi2 - phi1) / 2)
    s_lambda = F.sin(F.radians(lng2 - lng1) / 2)
    chord = F.sqrt(s_phi * s_phi + F.cos(phi1) * F.cos(phi2) * s_lambda * s_lambda)
    # least() would skip NULLs and invent a distance, so clamp with CASE.
    clamped = F.when(chord > 1.0, F.lit(1.0)).otherwise(chord)
    return F.lit(2 * fixed.EARTH_RADIUS_M) * F.asin(clamped)


def metres_per_degree_lng(lat: Column) -> Column:
    raw = F.lit(fixed.METRES_PER_DEGREE_LAT) * F.cos(F.radians(lat))
    return F.when(raw < 1.0, F.lit(1.0)).otherwise(raw)


def offset_lat(lat: Column, north_m: Column) -> Column:
    return lat + north_m / F.lit(fixed.METRES_PER_DEGREE_LAT)


def offset_lng(lat: Column, lng: Column, east_m: Column) -> Column:
    return lng + east_m / metres_per_degree_lng(lat)


def cell_identity(lat: Column, lng: Column, radius_m: Column) -> list[Column]:
    """Position to six decimals, radius to one, as exact integers."""
    return [
        F.bround(lat * 1e6).cast("bigint").alias("lat_e6"),
        F.bround(lng * 1e6).cast("bigint").alias("lng_e6"),
        F.bround(radius_m * 10.0).cast("bigint").alias("radius_dm"),
    ]


CELL_KEY = ["lat_e6", "lng_e6", "radius_dm"]


def with_cell_identity(df):
    lat_e6, lng_e6, radius_dm = cell_identity(F.col("lat"), F.col("lng"), F.col("radius_m"))
    return df.withColumns({"lat_e6": lat_e6, "lng_e6": lng_e6, "radius_dm": radius_dm})


def type_scope(types: Column) -> Column:
    """The resume scope of a list of requested types; order does not matter."""
    return F.array_join(F.array_sort(types), ",")


def to_number(text: Column) -> Column:
    """A plain decimal number; any other text, NaN and infinities are NULL."""
    trimmed = strip(text)
    return F.when(trimmed.rlike(_NUMBER), trimmed.try_cast("double"))


def position(lat: Column, lng: Column) -> tuple[Column, Column]:
    """Latitude and longitude, both NULL unless both are numbers on the globe."""
    lat, lng = to_number(lat.cast("string")), to_number(lng.cast("string"))
    placed = F.coalesce(lat.between(-90, 90) & lng.between(-180, 180), F.lit(False))
    return F.when(placed, lat), F.when(placed, lng)


def parse_latlng(text: Column) -> Column:
    """``"lat,lng"`` (or ``;``) as struct<lat, lng, valid>; bad text is flagged."""
    parts = F.split(F.replace(text, F.lit(";"), F.lit(",")), ",")
    lat, lng = to_number(F.get(parts, F.lit(0))), to_number(F.get(parts, F.lit(1)))
    valid = (F.size(parts) == 2) & lat.between(-90, 90) & lng.between(-180, 180)
    valid = F.coalesce(valid, F.lit(False))
    return F.struct(
        F.when(valid, lat).alias("lat"), F.when(valid, lng).alias("lng"), valid.alias("valid")
    )


def parse_bbox(text: Column) -> Column:
    """``"south,west,north,east"`` as struct<south, west, north, east, valid>."""
    parts = F.split(text, ",")
    south, west, north, east = (to_number(F.get(parts, F.lit(k))) for k in range(4))
    valid = F.coalesce((F.size(parts) == 4) & (south < north) & (west < east), F.lit(False))
    named = {"south": south, "west": west, "north": north, "east": east}
    return F.struct(
        *[F.when(valid, column).alias(name) for name, column in named.items()],
        valid.alias("valid"),
    )


def parse_types(text: Column) -> Column:
    """Comma list to array; nothing usable means the default type."""
    trimmed = F.transform(F.split(text, ","), lambda t: strip(t))
    cleaned = F.filter(trimmed, lambda t: t != "")
    default = F.array(*[F.lit(t) for t in fixed.DEFAULT_TYPES])
    return F.when(F.size(cleaned) > 0, cleaned).otherwise(default)


def disc_area_m2(radius_m: Column) -> Column:
    return F.lit(math.pi) * radius_m * radius_m


def bbox_area_m2(south: Column, west: Column, north: Column, east: Column) -> Column:
    height = (north - south) * F.lit(fixed.METRES_PER_DEGREE_LAT)
    return height * ((east - west) * metres_per_degree_lng((south + north) / 2))


def cell_radius_for_budget(area_m2: Column, budget: Column) -> Column:
    """Starting radius whose grid takes the grid share of ``budget`` searches."""
    checked = F.when(budget < 1, F.raise_error(F.lit("budget must be at least 1"))).otherwise(
        budget
    )
    searches = F.greatest(F.lit(1.0), checked * F.lit(fixed.BUDGET_GRID_SHARE))
    radius = F.sqrt(area_m2 / searches) / F.lit(math.sqrt(2.0) * fixed.COVERAGE_MARGIN)
    return F.greatest(F.lit(fixed.MIN_BUDGET_RADIUS_M), radius)
