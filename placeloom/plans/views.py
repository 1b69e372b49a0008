"""Input views over the given tables.

Each view is one SQL text that both Spark and the checking engine run, so the
inputs of a query and of its check are the same by construction.  ``{name}``
stands for a table or an earlier view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {}

VIEWS["places_v"] = """
select
  'P' || lpad(cast(c_custkey as string), 9, '0') as place_id,
  c_name as name,
  cast('59.40' as double) + cast((c_custkey * 7919) % 1000 as double) / cast(10000 as double)
    * (case when c_custkey % 3 = 0 then cast('0.2' as double) else cast(1 as double) end)
    as latitude,
  cast('24.60' as double)
    + cast((c_custkey * c_custkey * 31 + c_custkey * 104729) % 2000 as double)
    / cast(10000 as double)
    * (case when c_custkey % 3 = 0 then cast('0.2' as double) else cast(1 as double) end)
    as longitude,
  case when c_custkey % 11 = 0 then null
    else cast(1 as double) + cast((c_custkey * 31) % 41 as double) / cast(10 as double)
  end as rating,
  case when c_custkey % 13 = 0 then null else (c_custkey * c_custkey * 17) % 400 end
    as user_rating_count,
  case c_mktsegment when 'HOUSEHOLD' then 'restaurant' when 'BUILDING' then 'cafe'
    when 'MACHINERY' then 'supermarket' when 'FURNITURE' then 'hotel' end as primary_type,
  case c_mktsegment when 'HOUSEHOLD' then 'restaurant,food' when 'BUILDING' then 'cafe,food,bar'
    when 'MACHINERY' then 'supermarket,restaurant' when 'FURNITURE' then 'hotel' end as types,
  case when c_custkey % 29 = 0 then '' when c_custkey % 31 = 0 then null else n_name end as city,
  '+372 ' || cast(5000000 + c_custkey as string) as phone,
  case when c_custkey % 7 = 0 then '00372' || cast(5000000 + c_custkey as string)
    when c_custkey % 7 = 1 then '' end as phone_international,
  'Uus' || chr(cast(97 + c_custkey % 26 as int)) || ' tn '
    || cast(1 + c_custkey % 200 as string) || ', 10133 Tallinn' as formatted_address,
  case when c_custkey % 4 = 0 then '  https://p' || cast(c_custkey as string) || '.example '
    when c_custkey % 4 = 1 then '   ' end as website,
  case when c_custkey % 3 = 0 then true when c_custkey % 3 = 1 then false end as takeout,
  cast(case when c_custkey % 5 < 4 then c_custkey % 5 end as int) as price_level,
  case when c_custkey % 6 = 0 then 'a' || cast(c_custkey as string) end as salesforce_id,
  case when c_custkey % 6 = 0 then cast('2001-01-01 00:00:00' as timestamp) end
    as salesforce_synced_at,
  c_custkey as record_pos
from {customer} join {nation} on c_nationkey = n_nationkey
"""

VIEWS["curated_v"] = """
select
  s_suppkey as target_id,
  case when s_suppkey % 4 = 2 then p.name else s_name end as name,
  p.latitude + cast(s_suppkey % 5 as double) * cast('0.0004' as double) as lat,
  p.longitude as lng,
  case s_suppkey % 4 when 0 then p.phone
    when 3 then '+372 ' || cast(9000000 + s_suppkey as string) end as phone,
  case when s_suppkey % 4 = 1 then replace(p.formatted_address, ' tn ', ' ') end as address,
  s_suppkey % 17 = 0 as closed
from {supplier} join {places_v} as p on p.record_pos = s_suppkey * 15
"""

VIEWS["observations_v"] = """
select
  'P' || lpad(cast(o_custkey as string), 9, '0') as place_id,
  o_orderdate as seen_at,
  o_orderkey as ingest_seq,
  case when o_orderstatus = 'P' then o_totalprice end as rating,
  case when o_orderpriority like '1%' then o_orderpriority end as website,
  o_orderstatus as name
from {orders}
"""

# A raw cell log: every order is one search of a cell near its customer.
VIEWS["cell_log_v"] = """
select
  case when o_orderkey % 5 = 0 then null when o_orderkey % 2 = 0 then 'restaurant'
    else 'bar,cafe' end as scope,
  cast('59.40' as double) + cast(o_custkey % 10 as double) / cast(100 as double) as lat,
  cast('24.60' as double) + cast((o_custkey * 7) % 100 as double) / cast(500 as double) as lng,
  case when o_custkey % 3 = 0 then cast(400 as double) else cast(800 as double) end as radius_m,
  cast(o_orderkey % 4 as int) as depth,
  (o_orderkey * 7) % 21 as result_count,
  (o_orderkey * 7) % 21 >= 20 as saturated,
  (o_orderkey * 7) % 21 >= 20 and o_orderkey % 2 = 0 as split,
  o_orderdate + make_interval_seconds(o_orderkey % 86400) as searched_at,
  o_orderkey as seq
from {orders}
"""

VIEWS["payloads_v"] = """
select
  event_id,
  '{{"id":"E' || cast(event_id as string) || '"'
  || case when event_id % 7 = 0 then ''
       when event_id % 5 = 0 then ',"displayName":"' || event_type || '"'
       else ',"displayName":{{"text":"' || event_type || ' ' || cast(user_id as string)
         || '","languageCode":"en"}}' end
  || case when event_id % 4 = 0 then '' else ',"formattedAddress":"Street '
       || cast(user_id as string) || '"' end
  || ',"location":{{"latitude":' || cast(event_id % 90 as string) || '.5,"longitude":'
       || cast(event_id % 180 as string) || '.25}}'
  || case when event_id % 3 = 0 then '' else ',"types":["' || event_type || '","food"]' end
  || ',"primaryType":"' || event_type || '"'
  || case when event_id % 6 = 0 then ''
       else ',"userRatingCount":' || cast(user_id as string) || ',"rating":'
         || cast(1 + event_id % 4 as string) || '.5' end
  || case event_id % 8 when 0 then ',"priceLevel":"PRICE_LEVEL_FREE"'
       when 1 then ',"priceLevel":"PRICE_LEVEL_INEXPENSIVE"'
       when 2 then ',"priceLevel":"PRICE_LEVEL_VERY_EXPENSIVE"'
       when 3 then ',"priceLevel":"PRICE_LEVEL_UNHEARD_OF"' else '' end
  || case event_id % 3 when 0 then ',"takeout":true' when 1 then ',"takeout":false' else '' end
  || case when event_id % 2 = 0 then ',"addressComponents":['
       || '{{"longText":"' || case when event_id % 10 = 0 then '' else 'Old' end
       || '","shortText":"O","types":["postal_town"]}},'
       || '{{"longText":"Town ' || cast(user_id as string)
       || '","shortText":"T","types":["political","locality"]}},'
       || '{{"longText":"Estonia","shortText":"EE","types":["country","political"]}}]'
       else '' end
  || case event_id % 5 when 1 then ',"regularOpeningHours":{{"openNow":true,'
       || '"weekdayDescriptions":["Mon: 9-17","Tue: closed"]}}'
       when 2 then ',"regularOpeningHours":{{"openNow":false,"weekdayDescriptions":[]}}'
       else '' end
  || ',"props":' || props || '}}' as payload,
  ts as seen_at
from {events}
"""

# Payloads as they are collected: a user of the events is a place seen many times.
VIEWS["sightings_v"] = """
select
  ts as seen_at,
  event_id as ingest_seq,
  '{{"id":"U' || cast(user_id as string) || '"'
  || case when event_id % 7 = 0 then '' else ',"displayName":{{"text":"' || event_type || ' '
       || cast(event_id as string) || '"}}' end
  || case when event_id % 3 = 0 then ',"rating":' || cast(1 + event_id % 4 as string) || '.5'
       else '' end
  || case when event_id % 5 = 0 then ',"websiteUri":"https://s' || cast(event_id as string)
       || '.example"' else '' end
  || case event_id % 4 when 0 then ',"takeout":true' when 1 then ',"takeout":false' else '' end
  || '}}' as payload
from {events}
"""

# Payloads that fill every field, and the value each field is to have in a place row.
_KEY = "cast(event_id as string)"
_FLAGS = {
    "takeout": "takeout", "delivery": "delivery", "dine_in": "dineIn", "reservable": "reservable",
    "serves_breakfast": "servesBreakfast", "serves_lunch": "servesLunch", "serves_dinner": "servesDinner",
    "serves_beer": "servesBeer", "serves_wine": "servesWine", "serves_vegetarian_food": "servesVegetarianFood",
    "outdoor_seating": "outdoorSeating", "good_for_children": "goodForChildren",
}
FULL_VALUES = {
    "place_id": f"'F' || {_KEY}",
    "name": f"'N ' || {_KEY}",
    "formatted_address": f"'A' || {_KEY} || ', X'",
    "short_address": f"'a' || {_KEY}",
    "street_number": "cast(event_id % 50 as string)",
    "street": "'R' || cast(event_id % 9 as string)",
    "district": "'D' || cast(event_id % 7 as string)",
    "city": "'C' || cast(event_id % 5 as string)",
    "region": "'G' || cast(event_id % 4 as string)",
    "postal_code": "cast(10000 + event_id % 100 as string)",
    "country": "'Estonia'",
    "country_code": "'EE'",
    "latitude": "cast(event_id % 90 as double) + cast('0.5' as double)",
    "longitude": "cast(event_id % 180 as double) + cast('0.25' as double)",
    "google_maps_url": f"'https://m.example/' || {_KEY}",
    "website": f"case when event_id % 2 = 0 then 'https://w.example/' || {_KEY} end",
    "phone": f"'555 ' || {_KEY}",
    "phone_international": f"'+372 555 ' || {_KEY}",
    "rating": "cast(1 + event_id % 4 as double) + cast('0.5' as double)",
    "user_rating_count": "event_id % 300",
    "price_level": "cast(case when event_id % 6 < 5 then event_id % 6 end as int)",
    "price_label": "case event_id % 6 when 0 then 'Free' when 1 then '$' when 2 then '$$' when 3 then '$$$' when 4 then '$$$$' end",
    "business_status": "'OPERATIONAL'",
    "primary_type": "event_type",
    "primary_type_label": "'L ' || event_type",
    "types": "event_type || ',food'",
    "opening_hours": "'Mon: ' || cast(event_id % 12 as string) || chr(10) || 'Tue: closed'",
    "open_now": "event_id % 2 = 0",
    "editorial_summary": f"'E \"' || {_KEY} || '\"'",
    **{c: f"case (event_id + {n}) % 3 when 0 then true when 1 then false end" for n, c in enumerate(_FLAGS)},
    "wheelchair_accessible_entrance": "case (event_id + 12) % 3 when 0 then true when 1 then false end",
    "utc_offset_minutes": "cast(event_id % 5 * 60 as int)",
    "plus_code": f"'PC+' || {_KEY}",
}


def _full_payload() -> str:
    """SQL of the payload that carries those values."""
    value = FULL_VALUES
    text = lambda key, column: f"',\"{key}\":\"' || {value[column]} || '\"'"
    number = lambda key, column: f"',\"{key}\":' || cast({value[column]} as string)"
    flag = lambda key, n: f"case (event_id + {n}) % 3 when 0 then '\"{key}\":true' when 1 then '\"{key}\":false' else '\"_{key}\":0' end"
    part = lambda kind, column: f"'{{{{\"longText\":\"' || {value[column]} || '\",\"types\":[\"{kind}\"]}}}},'"
    price = "FREE INEXPENSIVE MODERATE EXPENSIVE VERY_EXPENSIVE NO_SUCH".split()
    cases = " ".join(f"when {n} then 'PRICE_LEVEL_{p}'" for n, p in enumerate(price))
    pieces = [
        f"'{{{{\"id\":\"' || {value['place_id']} || '\",\"displayName\":{{{{\"text\":\"' || {value['name']} || '\"}}}}'",
        text("formattedAddress", "formatted_address"), text("shortFormattedAddress", "short_address"),
        "',\"addressComponents\":['",
        part("street_number", "street_number"), part("route", "street"), part("administrative_area_level_2", "district"),
        part("postal_town", "city"), part("administrative_area_level_1", "region"), part("postal_code", "postal_code"),
        "'{{\"longText\":\"Estonia\",\"shortText\":\"EE\",\"types\":[\"country\",\"political\"]}}]'",
        f"',\"location\":{{{{\"latitude\":' || cast({value['latitude']} as string) || ',\"longitude\":' || cast({value['longitude']} as string) || '}}}}'",
        text("googleMapsUri", "google_maps_url"),
        f"case when event_id % 2 = 0 then ',\"websiteUri\":\"https://w.example/' || {_KEY} || '\"' else '' end",
        text("nationalPhoneNumber", "phone"), text("internationalPhoneNumber", "phone_international"),
        number("rating", "rating"), number("userRatingCount", "user_rating_count"),
        f"',\"priceLevel\":\"' || case event_id % 6 {cases} end || '\"'",
        text("businessStatus", "business_status"), text("primaryType", "primary_type"),
        f"',\"primaryTypeDisplayName\":{{{{\"text\":\"' || {value['primary_type_label']} || '\"}}}}'",
        "',\"types\":[\"' || event_type || '\",\"food\"]'",
        "',\"regularOpeningHours\":{{\"openNow\":' || case when event_id % 2 = 0 then 'true' else 'false' end"
        " || ',\"weekdayDescriptions\":[\"Mon: ' || cast(event_id % 12 as string) || '\",\"Tue: closed\"]}}'",
        f"',\"editorialSummary\":{{{{\"text\":\"E ' || chr(92) || '\"' || {_KEY} || chr(92) || '\"\"}}}}'",
        *[f"',' || {flag(key, n)}" for n, key in enumerate(_FLAGS.values())],
        "',\"accessibilityOptions\":{{' || " + flag("wheelchairAccessibleEntrance", 12) + " || '}}'",
        number("utcOffsetMinutes", "utc_offset_minutes"),
        f"',\"plusCode\":{{{{\"globalCode\":\"' || {value['plus_code']} || '\"}}}}}}}}'",
    ]
    return " || ".join(pieces)


VIEWS["full_payloads_v"] = f"select event_id, ts as seen_at, {_full_payload()} as payload from {{events}}"

_NEEDS = {
    "full_payloads_v": ["events"],
    "sightings_v": ["events"],
    "places_v": ["customer", "nation"],
    "curated_v": ["supplier", "places_v"],
    "observations_v": ["orders"],
    "cell_log_v": ["orders"],
    "payloads_v": ["events"],
}


def view_sql(name: str) -> str:
    """Checking-engine text of a view, as a parenthesised subquery."""
    text = VIEWS[name].replace(
        "make_interval_seconds(o_orderkey % 86400)", "to_seconds(o_orderkey % 86400)"
    )
    parts = {n: view_sql(n) if n in VIEWS else n for n in _NEEDS[name]}
    return f"({text.format(**parts)})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; unused columns are pruned down to the scan."""
    text = VIEWS[name].replace(
        "make_interval_seconds(o_orderkey % 86400)",
        "make_dt_interval(0, 0, 0, o_orderkey % 86400)",
    )
    parts = {
        n: view(spark, sf_dir, n) if n in VIEWS else table(spark, sf_dir, n)
        for n in _NEEDS[name]
    }
    return spark.sql(text, **parts)


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of one table, read as a stream of that table's files."""
    (source,) = _NEEDS[name]
    schema = table(spark, sf_dir, source).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{source}.parquet").parquet(sf_dir)
    return spark.sql(VIEWS[name], **{source: rows})
