"""Areas and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeloom import fixed
from placeloom.functions.geo import parse_bbox, parse_latlng, parse_types, type_scope
from placeloom.operators import cover
from placeloom.plans.check_sql import M_LAT, STEP, children, cover as cover_sql, hav, m_lng
from placeloom.plans.registry import query
from placeloom.plans.views import view, view_sql

CITY_BOXES = f"""(select coalesce(city, '?') as area_id, min(latitude) as south,
  min(longitude) as west, max(latitude) as north, max(longitude) as east,
  500.0::double as cell_radius_m from {view_sql('places_v')} group by 1)"""


def box_area(spark, sf_dir, cell_radius_m=fixed.DEFAULT_CELL_RADIUS_M):
    """One box around all places."""
    return view(spark, sf_dir, "places_v").agg(
        F.lit("all").alias("area_id"),
        F.min("latitude").alias("south"),
        F.min("longitude").alias("west"),
        F.max("latitude").alias("north"),
        F.max("longitude").alias("east"),
        F.lit(float(cell_radius_m)).alias("cell_radius_m"),
    )


def box_cells(spark, sf_dir, cell_radius_m=fixed.DEFAULT_CELL_RADIUS_M):
    return cover.cover_bbox(box_area(spark, sf_dir, cell_radius_m)).select(
        "queue_pos", "lat", "lng", "radius_m", "depth"
    )


def city_boxes(spark, sf_dir):
    return (
        view(spark, sf_dir, "places_v")
        .groupBy(F.coalesce(F.col("city"), F.lit("?")).alias("area_id"))
        .agg(
            F.min("latitude").alias("south"),
            F.min("longitude").alias("west"),
            F.max("latitude").alias("north"),
            F.max("longitude").alias("east"),
            F.lit(500.0).alias("cell_radius_m"),
        )
    )


def rounded(cells, *keep):
    """Positions to six decimals, so engines agree on the last bits."""
    return cells.select(
        *keep,
        F.round("lat", 6).alias("lat"),
        F.round("lng", 6).alias("lng"),
        F.round("radius_m", 3).alias("radius_m"),
    )


_ROUNDED = "round(lat, 6) as lat, round(lng, 6) as lng, round(radius_m, 3) as radius_m"


@query(
    "cover_bbox",
    f"select area_id, i, j, queue_pos, {_ROUNDED} from {cover_sql(CITY_BOXES)}",
)
def cover_bbox(spark, sf_dir):
    cells = cover.cover_bbox(city_boxes(spark, sf_dir))
    return rounded(cells, "area_id", "i", "j", "queue_pos")


_DISCS = f"""(select target_id as area_id, lat as center_lat, lng as center_lng,
  600.0::double + (target_id % 5) * 200.0::double as area_radius_m,
  least(250.0::double, 600.0::double + (target_id % 5) * 200.0::double) as cell_radius_m
  from {view_sql('curated_v')})"""
_DISC_BOXES = f"""(select *, center_lat - area_radius_m / {M_LAT} as south,
  center_lat + area_radius_m / {M_LAT} as north,
  center_lng - area_radius_m / {m_lng('center_lat')} as west,
  center_lng + area_radius_m / {m_lng('center_lat')} as east from {_DISCS})"""


@query(
    "cover_disc",
    f"""select area_id, queue_pos, {_ROUNDED} from {cover_sql(_DISC_BOXES)}
    where {hav('center_lat', 'center_lng', 'lat', 'lng')} <= area_radius_m + radius_m""",
)
def cover_disc(spark, sf_dir):
    areas = view(spark, sf_dir, "curated_v").select(
        F.col("target_id").alias("area_id"),
        F.col("lat").alias("center_lat"),
        F.col("lng").alias("center_lng"),
        (F.lit(600.0) + F.col("target_id") % 5 * 200.0).alias("area_radius_m"),
        F.lit(250.0).alias("cell_radius_m"),
    )
    return rounded(cover.cover_disc(areas), "area_id", "queue_pos")


@query(
    "split_children",
    f"""select area_id, queue_pos, depth, {_ROUNDED}
    from {children(cover_sql(CITY_BOXES), keep='area_id,')}""",
)
def split_children(spark, sf_dir):
    cells = cover.cover_bbox(city_boxes(spark, sf_dir)).select(
        "area_id", "queue_pos", "lat", "lng", "radius_m", "depth"
    )
    return rounded(cover.split_children(cells), "area_id", "queue_pos", "depth")


def budget_areas(spark, sf_dir):
    """A disc for every other curated record, a box for the rest; budgets 5..104."""
    lat, lng = F.col("lat"), F.col("lng")
    is_disc = F.col("target_id") % 2 == 0
    reach = F.lit(0.005) + (F.col("target_id") % 7).cast("double") * 0.001
    empty = F.lit(None).cast("double")
    return view(spark, sf_dir, "curated_v").select(
        F.col("target_id").alias("area_id"),
        F.when(is_disc, lat).alias("center_lat"),
        F.when(is_disc, lng).alias("center_lng"),
        F.when(is_disc, F.lit(800.0) + F.col("target_id") % 7 * 150.0).alias("area_radius_m"),
        F.when(is_disc, empty).otherwise(lat - reach).alias("south"),
        F.when(is_disc, empty).otherwise(lng - reach * 2).alias("west"),
        F.when(is_disc, empty).otherwise(lat + reach).alias("north"),
        F.when(is_disc, empty).otherwise(lng + reach * 2).alias("east"),
        F.lit(300.0).alias("cell_radius_m"),
        (F.col("target_id") % 100 + 5).cast("int").alias("budget"),
    )


_REACH = "(0.005::double + (target_id % 7)::double * 0.001::double)"
_BUDGET_AREAS = f"""(select target_id as area_id, target_id % 2 = 0 as is_disc,
  lat as a_lat, lng as a_lng, 800.0::double + (target_id % 7) * 150.0::double as area_radius_m,
  lat - {_REACH} as south, lng - {_REACH} * 2 as west,
  lat + {_REACH} as north, lng + {_REACH} * 2 as east,
  (target_id % 100 + 5)::int as budget from {view_sql('curated_v')})"""
_AREA = f"""case when is_disc then pi() * area_radius_m * area_radius_m
  else ((north - south) * {M_LAT}) * ((east - west) * {m_lng('(south + north) / 2')}) end"""


@query(
    "area_start_radius",
    f"""select area_id, round(area, 1) as area_m2,
      round(greatest(25.0::double, sqrt(area / greatest(1.0::double, budget * 0.7::double))
        / {STEP}::double), 4) as cell_radius_m
    from (select area_id, budget, {_AREA} as area from {_BUDGET_AREAS})""",
)
def area_start_radius(spark, sf_dir):
    return cover.start_radius(budget_areas(spark, sf_dir)).select(
        "area_id",
        F.round("area_m2", 1).alias("area_m2"),
        F.round("cell_radius_m", 4).alias("cell_radius_m"),
    )


def _fitted(passes: int) -> str:
    """The passes one after the other: count the cells, grow the radius where they are too many."""
    parts = [f"""f0 as materialized (select area_id, is_disc, a_lat, a_lng, area_radius_m, south, west, north, east,
        budget, greatest(25.0::double, sqrt({_AREA} / greatest(1.0::double, budget * 0.7::double)) / {STEP}::double)
          as cell_radius_m, null::bigint as fitted from {_BUDGET_AREAS})"""]
    for n in range(passes + 1):
        boxes = f"""(select area_id, south, west, north, east, cell_radius_m from f{n} where not is_disc and fitted is null)"""
        discs = f"""(select area_id, a_lat - area_radius_m / {M_LAT} as south, a_lat + area_radius_m / {M_LAT} as north,
            a_lng - area_radius_m / {m_lng('a_lat')} as west, a_lng + area_radius_m / {m_lng('a_lat')} as east,
            least(cell_radius_m, area_radius_m) as cell_radius_m, a_lat, a_lng, area_radius_m
          from f{n} where is_disc and fitted is null)"""
        parts.append(f"""n{n} as materialized (
          select area_id, count(*) as n_cells from {cover_sql(boxes)} group by area_id
          union all select area_id, count(*) from {cover_sql(discs)}
          where {hav('a_lat', 'a_lng', 'lat', 'lng')} <= area_radius_m + radius_m group by area_id)""")
        over = f"n_cells > greatest(1, floor(budget * 0.7::double)) and {n} < {passes}"
        parts.append(f"""f{n + 1} as materialized (
          select f.* replace (
              case when fitted is null and {over} then cell_radius_m * (sqrt(n_cells
                / greatest(1, floor(budget * 0.7::double))) * 1.05::double) else cell_radius_m end as cell_radius_m,
              case when fitted is null and not ({over}) then n_cells else fitted end as fitted)
          from f{n} as f left join n{n} using (area_id))""")
    return ", ".join(parts)


@query(
    "fit_areas",
    f"""with {_fitted(12)} select area_id, budget, fitted as n_cells, round(cell_radius_m, 4) as cell_radius_m from f13""",
)
def fit_areas(spark, sf_dir):
    return cover.fit_areas(budget_areas(spark, sf_dir)).select(
        "area_id", "budget", "n_cells", F.round("cell_radius_m", 4).alias("cell_radius_m")
    )


# Given radii (no budget to fit): the number of cells is the base of the estimate.
_FIXED_BOXES = f"""(select area_id, south, west, north, east, 300.0::double as cell_radius_m
  from {_BUDGET_AREAS} where not is_disc)"""
_FIXED_DISCS = f"""(select area_id, a_lat - area_radius_m / {M_LAT} as south,
  a_lat + area_radius_m / {M_LAT} as north,
  a_lng - area_radius_m / {m_lng('a_lat')} as west,
  a_lng + area_radius_m / {m_lng('a_lat')} as east,
  300.0::double as cell_radius_m, a_lat, a_lng, area_radius_m from {_BUDGET_AREAS} where is_disc)"""


@query(
    "area_estimates",
    f"""with n as (
      select area_id, count(*) as n_cells from {cover_sql(_FIXED_BOXES)} group by area_id
      union all
      select area_id, count(*) from {cover_sql(_FIXED_DISCS)}
      where {hav('a_lat', 'a_lng', 'lat', 'lng')} <= area_radius_m + radius_m group by area_id)
    select area_id, n_cells, n_cells as low_calls, floor(n_cells * 2.5)::bigint as high_calls,
      round(n_cells * 0.035::double, 4) as low_cost,
      round(floor(n_cells * 2.5) * 0.035::double, 4) as high_cost
    from n""",
)
def area_estimates(spark, sf_dir):
    areas = budget_areas(spark, sf_dir).withColumn("budget", F.lit(None).cast("int"))
    estimated = cover.estimate_cost(
        cover.count_cells(areas), fixed.DEFAULT_MIN_REVIEWS, cover.price_for_tier("ratings")
    )
    return estimated.select(
        "area_id",
        "n_cells",
        "low_calls",
        "high_calls",
        F.round("low_cost", 4).alias("low_cost"),
        F.round("high_cost", 4).alias("high_cost"),
    )


_TEXTS = f"""(select record_pos,
  case record_pos % 6 when 0 then latitude::decimal(9,4)::varchar || ','
      || longitude::decimal(9,4)::varchar
    when 1 then ' ' || latitude::decimal(9,4)::varchar || ' ; '
      || longitude::decimal(9,4)::varchar
    when 2 then '95.5,' || longitude::decimal(9,4)::varchar
    when 3 then latitude::decimal(9,4)::varchar
    when 4 then 'north,' || longitude::decimal(9,4)::varchar
    else latitude::decimal(9,4)::varchar || ',-181' end as center,
  case record_pos % 3 when 0 then '59.1,24.1,' || latitude::decimal(9,4)::varchar || ',25.0'
    when 1 then latitude::decimal(9,4)::varchar || ',24.1,59.0,25.0'
    else '1,2,3' end as bbox,
  case record_pos % 4 when 0 then types when 1 then ' bar , ,cafe' when 2 then ' , ' end as kinds
  from {view_sql('places_v')})"""


@query(
    "parse_areas",
    f"""with c as (select *, string_split(replace(center, ';', ','), ',') as p,
        string_split(bbox, ',') as b from {_TEXTS}),
      v as (select *, try_cast(trim(p[1]) as double) as la, try_cast(trim(p[2]) as double) as ln,
        try_cast(b[1] as double) as s, try_cast(b[2] as double) as w,
        try_cast(b[3] as double) as n, try_cast(b[4] as double) as e,
        list_filter(list_transform(string_split(kinds, ','), lambda x: trim(x)), lambda x: x <> '') as t
        from c),
      k as (select *, coalesce(len(p) = 2 and la between -90 and 90
          and ln between -180 and 180, false) as center_ok,
        coalesce(len(b) = 4 and s < n and w < e, false) as bbox_ok,
        case when len(t) > 0 then t else ['restaurant'] end as u from v)
    select record_pos, case when center_ok then la end as lat, case when center_ok then ln end
      as lng, center_ok, case when bbox_ok then n end as north, bbox_ok,
      array_to_string(u, ',') as types, array_to_string(list_sort(u), ',') as scope from k""",
)
def parse_areas(spark, sf_dir):
    lat = F.col("latitude").cast("decimal(9,4)").cast("string")
    lng = F.col("longitude").cast("decimal(9,4)").cast("string")
    pos = F.col("record_pos")
    center = (
        F.when(pos % 6 == 0, F.concat(lat, F.lit(","), lng))
        .when(pos % 6 == 1, F.concat(F.lit(" "), lat, F.lit(" ; "), lng))
        .when(pos % 6 == 2, F.concat(F.lit("95.5,"), lng))
        .when(pos % 6 == 3, lat)
        .when(pos % 6 == 4, F.concat(F.lit("north,"), lng))
        .otherwise(F.concat(lat, F.lit(",-181")))
    )
    bbox = (
        F.when(pos % 3 == 0, F.concat(F.lit("59.1,24.1,"), lat, F.lit(",25.0")))
        .when(pos % 3 == 1, F.concat(lat, F.lit(",24.1,59.0,25.0")))
        .otherwise("1,2,3")
    )
    kinds = (
        F.when(pos % 4 == 0, F.col("types"))
        .when(pos % 4 == 1, " bar , ,cafe")
        .when(pos % 4 == 2, " , ")
    )
    parsed = view(spark, sf_dir, "places_v").select(
        "record_pos",
        parse_latlng(center).alias("c"),
        parse_bbox(bbox).alias("b"),
        parse_types(kinds).alias("t"),
    )
    return parsed.select(
        "record_pos",
        "c.lat",
        "c.lng",
        F.col("c.valid").alias("center_ok"),
        F.col("b.north").alias("north"),
        F.col("b.valid").alias("bbox_ok"),
        F.array_join("t", ",").alias("types"),
        type_scope(F.col("t")).alias("scope"),
    )
