"""SQL building blocks for the checks, written independently of the operators."""

from __future__ import annotations

import math

from placeloom import fixed
from placeloom.plans.views import view_sql

STEP = repr(math.sqrt(2.0) * 0.98)
M_LAT = "111320.0::double"


def hav(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return (
        f"(2 * 6371008.8::double * asin(least(1.0::double, sqrt("
        f"pow(sin((radians({lat2}) - radians({lat1})) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians({lng2} - {lng1}) / 2), 2)))))"
    )


def m_lng(lat: str) -> str:
    return f"greatest({M_LAT} * cos(radians({lat})), 1.0::double)"


def words(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def cover(areas: str) -> str:
    """Cells of boxes; ``areas`` is a relation with the box columns."""
    return f"""(
      with a as (select *, cell_radius_m * {STEP}::double as spacing,
          cell_radius_m * {STEP}::double / {M_LAT} as lat_step from {areas}),
      g as (select *, unnest(range(0, 1 + greatest(1, ceil((north - south) / lat_step))::bigint))
          as i from a),
      l as (select *, south + i * lat_step as lat from g),
      k as (select *, spacing / {m_lng('lat')} as lng_step from l where lat <= north + lat_step),
      h as (select *, unnest(range(0, 1 + greatest(1, ceil((east - west) / lng_step))::bigint))
          as j from k),
      c as (select *, west + j * lng_step as lng from h)
      select * exclude (spacing, lat_step, lng_step, cell_radius_m),
        cell_radius_m as radius_m, 0 as depth,
        i * 2097152 + j as queue_pos
      from c where lng <= east + lng_step)"""


BOX = f"""(select 'all' as area_id, min(latitude) as south, min(longitude) as west,
  max(latitude) as north, max(longitude) as east, 1000.0::double as cell_radius_m
  from {view_sql('places_v')})"""

CELLS = f"(select queue_pos, lat, lng, radius_m, depth from {cover(BOX)})"


def children(cells: str, keep: str = "") -> str:
    return f"""(
      select {keep}
        lat + (case when k % 2 = 0 then -radius_m / 2 else radius_m / 2 end) / {M_LAT} as lat,
        lng + (case when k < 2 then -radius_m / 2 else radius_m / 2 end) / {m_lng('lat')} as lng,
        radius_m / sqrt(2.0::double) / 0.98::double as radius_m,
        depth + 1 as depth, queue_pos * 4 + k as queue_pos
      from {cells}, range(0, 4) as ks(k))"""


DISTANCE_ORDER = "distance_m, place_id"
POPULARITY_ORDER = "user_rating_count desc nulls last, place_id"


def hits(cells: str, order: str, where: str = "true", places: str | None = None) -> str:
    places = places or view_sql("places_v")
    distance = hav("c.lat", "c.lng", "p.latitude", "p.longitude")
    return f"""(
      select * from (
        select *, row_number() over (partition by queue_pos order by {order}) as result_rank
        from (
          select c.queue_pos, p.place_id, p.user_rating_count, p.primary_type,
            {distance} as distance_m, c.radius_m as r
          from {cells} as c, {places} as p where {where})
        where distance_m <= least(r, 50000.0::double))
      where result_rank <= 20)"""


def judged(hit_rows: str, bar: int, included=("restaurant",), known: str | None = None) -> str:
    denied = words(fixed.NON_RESTAURANT_TYPES)
    low = f"coalesce(user_rating_count, 0) < {bar}" if bar else "false"
    known = known or "(select '' as place_id where false)"
    return f"""(
      with f as (select *, {low} as low,
          not ({low}) and coalesce(primary_type, '') in ({denied})
            and coalesce(primary_type, '') not in ({words(included)}) as wrong from {hit_rows}),
      k as (select *, not low and not wrong as kept from f)
      select *, kept and place_id not in (select place_id from {known})
          and queue_pos = min(case when kept then queue_pos end) over (partition by place_id)
          as is_new
      from k)"""


def outcomes(cells: str, judged_rows: str, bar: int, max_depth: int, only_new: bool = False) -> str:
    return f"""(
      with n as (select queue_pos, count(*) as result_count,
          count(*) filter (where low) as n_below_bar,
          count(*) filter (where wrong) as n_not_restaurant,
          count(*) filter (where kept) as n_kept,
          count(*) filter (where is_new) as n_new
        from {judged_rows} group by queue_pos),
      z as (select c.*, coalesce(result_count, 0) as result_count,
          coalesce(n_below_bar, 0) as n_below_bar,
          coalesce(n_not_restaurant, 0) as n_not_restaurant,
          coalesce(n_kept, 0) as n_kept, coalesce(n_new, 0) as n_new
        from {cells} as c left join n on n.queue_pos = c.queue_pos),
      d as (select *, result_count >= 20 as saturated,
          case when result_count < 20 then 'not full'
            when {bar} > 0 and n_below_bar > 0 then 'below bar'
            when {str(only_new).lower()} and n_new = 0 then 'nothing new'
            when depth >= {max_depth} then 'depth limit'
            when radius_m / 2 < 40 then 'radius floor'
            else 'split' end as reason from z)
      select *, reason = 'split' as split from d)"""
