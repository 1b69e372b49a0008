"""Circle-contains-point joins rewritten as equi joins on grid buckets.

Circles are sorted into power-of-two radius classes.  Each class has its own
grid: latitude rows of one class radius, and per row a whole number of columns
that shrinks towards the poles, so buckets keep roughly the same width and
longitude wraps at the antimeridian by arithmetic modulo the column count.  A
point lies in exactly one bucket per class; a circle lists the buckets its
bounding box touches (a handful, whatever its size).  Both sides then meet in
an equi join, each pair in exactly one bucket, and the exact distance decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom import fixed
from placeloom.functions.geo import haversine_m
from placeloom.operators.skew import BROADCAST_ROWS, SIDE_ROWS, balanced_join
from placeloom.session import shuffle_width

# Metres per degree used for bucket sizes and boxes.  Must not exceed what the
# distance formula implies (about 111,195), or boxes lose points on the edge.
_BOX_M_PER_DEGREE = 111_000.0
GRID_KEY = ["g_class", "g_row", "g_col"]


def radius_class(radius_m: Column) -> Column:
    """Smallest k with radius <= 2^k metres (at least 0)."""
    return F.ceil(F.log2(F.greatest(radius_m, F.lit(1.0)))).cast("int")


def class_of(radius_m: float) -> int:
    """The same for one known radius."""
    return math.ceil(math.log2(max(radius_m, 1.0)))


def _row_height(g_class: Column) -> Column:
    return F.pow(F.lit(2.0), g_class) / F.lit(_BOX_M_PER_DEGREE)


def _columns_in_row(g_row: Column, g_class: Column) -> Column:
    height = _row_height(g_class)
    poleward = F.greatest(F.abs(g_row * height), F.abs((g_row + 1) * height))
    around = F.floor(F.lit(360.0) * F.cos(F.radians(F.least(poleward, F.lit(90.0)))) / height)
    return F.greatest(F.lit(1), around).cast("bigint")


def _column_of(lng: Column, columns: Column) -> Column:
    turn = F.pmod(lng + 180.0, F.lit(360.0)) / 360.0
    return F.pmod(F.floor(turn * columns), columns)


# No circle lists more buckets: its box touches at most 3 rows, and of each at most 5
# columns, or, within three rows of a pole, where a row has no more, 18.
MOST_BUCKETS = 54


@dataclass(frozen=True)
class CircleProfile:
    """What a join must know about its circles: how many, which classes, how many buckets they list."""

    count: int
    classes: tuple[int, ...]
    buckets: int | None = None

    @property
    def rows(self) -> int:
        """A bound of the rows that ``bucket_circles`` makes: exact if counted."""
        return self.count * MOST_BUCKETS if self.buckets is None else self.buckets


def class_set(radius: Column) -> Column:
    """Aggregate: the radius classes in use, at most 26 whatever the row count."""
    return F.collect_set(radius_class(radius))


def search_radius(radius: Column, max_radius_m: float | None) -> Column:
    if max_radius_m is None:
        return radius
    return F.when(radius > max_radius_m, F.lit(max_radius_m)).otherwise(radius)


def profile_circles(circles: DataFrame, radius: Column, lat: str = "lat", lng: str = "lng") -> CircleProfile:
    n = F.aggregate(_spans(F.col(lat), F.col(lng), radius), F.lit(0).cast("bigint"), lambda x, s: x + s["listed"])
    row = circles.agg(
        F.count("*").alias("n"), class_set(radius).alias("k"), F.coalesce(F.sum(n), F.lit(0)).alias("buckets")
    ).first()
    return CircleProfile(row.n, tuple(sorted(row.k)), row.buckets)


def bucket_points(points: DataFrame, lat: str, lng: str, classes: list[int]) -> DataFrame:
    """One bucket per radius class for every point with a position."""
    placed = points.where(F.col(lat).isNotNull() & F.col(lng).isNotNull())
    if len(classes) == 1:
        k = F.lit(classes[0])
    else:
        placed = placed.withColumn("_k", F.explode(F.array(*[F.lit(c) for c in classes])))
        k = F.col("_k")
    row = F.floor(F.col(lat) / _row_height(k))
    return placed.withColumns(
        {
            "g_class": k,
            "g_row": row,
            "g_col": _column_of(F.col(lng), _columns_in_row(row, k)),
        }
    ).drop("_k")


def _spans(lat: Column, lng: Column, radius: Column, g_class: Column | None = None) -> Column:
    """The rows a circle's bounding box touches: per row its number of columns, the first and how many are listed."""
    g_class = radius_class(radius) if g_class is None else g_class
    reach = radius / F.lit(_BOX_M_PER_DEGREE)
    height = _row_height(g_class)
    rows = F.sequence(F.floor((lat - reach) / height), F.floor((lat + reach) / height))
    # Where the circle is widest in longitude, unless it holds the pole.
    widest = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(reach)) / F.cos(F.radians(lat)))))
    half = F.when(reach + F.abs(lat) >= 90.0, F.lit(180.0)).otherwise(widest + 1e-9)

    def span(row: Column) -> Column:
        n = _columns_in_row(row, g_class)
        turn = lambda x: F.floor((x + 180.0) / 360.0 * n)
        first = turn(lng - half)
        listed = F.least(turn(lng + half) - first + 1, n)
        return F.struct(row.alias("row"), n.alias("n"), first.alias("first"), listed.alias("listed"))

    return F.transform(rows, span)


def bucket_circles(
    circles: DataFrame, lat: str, lng: str, radius: Column, wider: int | None = None
) -> DataFrame:
    """Every bucket a circle's bounding box touches, in its own radius class or a ``wider`` one for all."""
    lat_c, lng_c = F.col(lat), F.col(lng)
    g_class = radius_class(radius) if wider is None else F.lit(wider)
    keyed = circles.where(lat_c.isNotNull() & lng_c.isNotNull() & radius.isNotNull()).select(
        "*", g_class.alias("g_class"), F.explode(_spans(lat_c, lng_c, radius, g_class)).alias("_span")
    )
    s = F.col("_span")
    columns = F.transform(F.sequence(F.lit(0).cast("bigint"), s["listed"] - 1), lambda k: F.pmod(s["first"] + k, s["n"]))
    return keyed.select(*circles.columns, "g_class", s["row"].alias("g_row"), F.explode(columns).alias("g_col"))


def within_circles(
    circles: DataFrame,
    points: DataFrame,
    circle_id: list[str],
    point_id: list[str],
    circle_at: tuple[str, str, str] = ("lat", "lng", "radius_m"),
    point_at: tuple[str, str] = ("p_lat", "p_lng"),
    max_radius_m: float | None = fixed.MAX_SEARCH_RADIUS_M,
    extra_keys: tuple[str, ...] = (),
    broadcast_rows: int = BROADCAST_ROWS,
    side_rows: int = SIDE_ROWS,
    profile: CircleProfile | None = None,
) -> DataFrame:
    """All (circle, point) pairs with distance <= radius, plus ``distance_m``.

    ``extra_keys`` are equality columns present on both sides (a shared phone
    or address key), joined together with the bucket.  ``profile`` saves the
    pass over the circles that counts them.
    """
    lat, lng, radius_name = circle_at
    radius = search_radius(F.col(radius_name), max_radius_m)
    if profile is None:
        profile = profile_circles(circles, radius, lat, lng)
    left = bucket_circles(circles, lat, lng, radius)
    if profile.rows <= broadcast_rows:
        # Each point meets its circles where it is read, and a file of millions of them may be one task.
        points = points.repartition(shuffle_width(points.sparkSession))
    right = bucket_points(points, point_at[0], point_at[1], list(profile.classes) or [0])
    pairs = balanced_join(
        left,
        right,
        [*GRID_KEY, *extra_keys],
        circle_id,
        point_id,
        broadcast_rows,
        side_rows,
        left_rows=profile.rows,
    )
    distance = haversine_m(F.col(lat), F.col(lng), F.col(point_at[0]), F.col(point_at[1]))
    return pairs.withColumn("distance_m", distance).where(
        F.col("distance_m") <= radius
    ).drop(*GRID_KEY)
