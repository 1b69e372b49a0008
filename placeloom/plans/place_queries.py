"""Normalising payloads, folding observations, filters, summaries, exports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from placeloom import fixed
from placeloom.operators import filters, fold, normalize, report
from placeloom.operators.numbering import number_rows
from placeloom.plans.check_sql import words
from placeloom.plans.registry import query
from placeloom.plans.views import FULL_VALUES, stream, table, view, view_sql
from placeloom.schemas import place_type
from placeloom.session import scratch_path
from placeloom.sources import files
from placeloom.sources.tables import PlaceStore
from placeloom.streaming.upsert import start_upsert

_PLACES = view_sql("places_v")
_OBSERVED = view_sql("observations_v")
_PAYLOADS = view_sql("payloads_v")
_CUTOFF = datetime(2001, 6, 1)
_CONTENT = ["rating", "website", "name"]


def place_rows(spark, sf_dir):
    """The places with all 44 columns; those the view lacks are NULL."""
    places = view(spark, sf_dir, "places_v")
    return places.select(
        *[
            F.col(c).cast(place_type(c)).alias(c)
            if c in places.columns
            else F.lit(None).cast(place_type(c)).alias(c)
            for c in fixed.PLACE_COLUMNS
        ],
        "salesforce_id",
        "salesforce_synced_at",
    )


# --- normalisation ----------------------------------------------------------

_J = lambda path: f"json_extract_string(payload, '{path}')"
_KIND_OF = {column: kinds for column, kinds in fixed.ADDRESS_KINDS.items()}


def _component_sql(kinds: list[str], field: str) -> str:
    """First non-empty text of a component kind, else the last one."""
    wanted = "[" + words(kinds) + "]"
    listed = (
        "list_transform(list_filter(from_json(json_extract(payload, '$.addressComponents'),"
        ' \'[{"longText":"VARCHAR","shortText":"VARCHAR","types":["VARCHAR"]}]\'),'
        f" lambda c: list_has_any(c.types, {wanted})), lambda c: c.{field})"
    )
    return f"coalesce(list_filter({listed}, lambda t: t <> '')[1], ({listed})[-1])"


def _text_sql(field: str) -> str:
    return (
        f"case json_type(payload, '$.{field}') when 'OBJECT' then {_J(f'$.{field}.text')}"
        f" when 'VARCHAR' then {_J(f'$.{field}')} end"
    )


def _price_sql(values: dict) -> str:
    cases = " ".join(
        f"when '{k}' then {v if isinstance(v, int) else repr(v)}" for k, v in values.items()
    )
    return f"case {_J('$.priceLevel')} {cases} end"


_NORMALIZED = f"""(select event_id, {_J('$.id')} as place_id, {_text_sql('displayName')} as name,
  {_J('$.formattedAddress')} as formatted_address,
  {_component_sql(_KIND_OF['city'], 'longText')} as city,
  {_component_sql(['country'], 'longText')} as country,
  {_component_sql(['country'], 'shortText')} as country_code,
  json_extract(payload, '$.location.latitude')::double as latitude,
  json_extract(payload, '$.location.longitude')::double as longitude,
  json_extract(payload, '$.rating')::double as rating,
  json_extract(payload, '$.userRatingCount')::bigint as user_rating_count,
  {_price_sql(fixed.PRICE_LEVELS)} as price_level,
  {_price_sql(fixed.PRICE_LABELS)} as price_label,
  {_J('$.primaryType')} as primary_type,
  array_to_string(json_extract_string(payload, '$.types[*]'), ',') as types_raw,
  json_extract_string(payload, '$.regularOpeningHours.weekdayDescriptions[*]') as lines,
  json_extract(payload, '$.regularOpeningHours.openNow')::boolean as open_now,
  json_extract(payload, '$.takeout')::boolean as takeout
  from {_PAYLOADS})"""


@query(
    "normalize_payload",
    f"""select event_id, place_id, name, formatted_address, city, country, country_code,
      latitude, longitude, rating, user_rating_count, price_level, price_label, primary_type,
      nullif(types_raw, '') as types,
      case when len(lines) > 0 then array_to_string(lines, chr(10)) end as opening_hours,
      open_now, takeout from {_NORMALIZED}""",
)
def normalize_payload(spark, sf_dir):
    rows = normalize.normalize_payload(view(spark, sf_dir, "payloads_v"))
    return rows.select(
        "event_id", "place_id", "name", "formatted_address", "city", "country", "country_code",
        "latitude", "longitude", "rating", "user_rating_count", "price_level", "price_label",
        "primary_type", "types", "opening_hours", "open_now", "takeout",
    )


@query(
    "response_explode",
    f"""with r as (select event_id // 5 as page, event_id, payload from {_PAYLOADS}),
      n as (select page, row_number() over (partition by page order by event_id) - 1 as
        response_pos, {_J('$.id')} as place_id, event_id from r)
    select page, response_pos, place_id from n
    where page % 4 <> 3""",
)
def response_explode(spark, sf_dir):
    """Payloads landed as pages of a response; some pages have no places key."""
    pages = (
        view(spark, sf_dir, "payloads_v")
        .groupBy(F.expr("event_id div 5").alias("page"))
        .agg(F.array_sort(F.collect_list(F.struct("event_id", "payload"))).alias("rows"))
    )
    listed = F.array_join(F.transform("rows", lambda r: r["payload"]), ",")
    filled = F.concat(F.lit('{"places":['), listed, F.lit("]}"))
    responses = pages.select(
        "page", F.when(F.col("page") % 4 == 3, F.lit("{}")).otherwise(filled).alias("response")
    )
    exploded = files.explode_response(responses)
    doc = F.try_parse_json("payload")
    return exploded.select(
        "page",
        F.col("response_pos").cast("bigint").alias("response_pos"),
        F.try_variant_get(doc, "$.id", "string").alias("place_id"),
    )


@query(
    "payload_profile",
    f"""select count(*) as n_results, count(user_rating_count) as n_with_review_count,
      count(user_rating_count) > 0 as bar_usable from {_NORMALIZED}""",
)
def payload_profile(spark, sf_dir):
    return normalize.payload_profile(normalize.normalize_payload(view(spark, sf_dir, "payloads_v")))


@query(
    "probe_sample",
    f"""select place_id, name, rating, user_rating_count from {_NORMALIZED}
    order by place_id limit 5""",
)
def probe_sample(spark, sf_dir):
    return normalize.probe_sample(normalize.normalize_payload(view(spark, sf_dir, "payloads_v")))


_ALL = ", ".join(f"{value} as {column}" for column, value in FULL_VALUES.items())
_ALL_FLAT = ", ".join(
    f"({value})::int as {column}" if column in fixed.FLAG_COLUMNS else f"{value} as {column}"
    for column, value in FULL_VALUES.items()
)


def _full_places(spark, sf_dir):
    return normalize.normalize_payload(view(spark, sf_dir, "full_payloads_v"))


@query("normalize_all_columns", f"select {_ALL} from events")
def normalize_all_columns(spark, sf_dir):
    """All 44 columns of payloads that fill every field."""
    return _full_places(spark, sf_dir).select(*FULL_VALUES)


# What only the dearest tier carries, and what the cheapest does.
_FULL_ONLY = (
    "editorial_summary takeout delivery dine_in reservable serves_breakfast serves_lunch serves_dinner serves_beer "
    "serves_wine serves_vegetarian_food outdoor_seating good_for_children wheelchair_accessible_entrance"
).split()
_AS_RATED = ", ".join(
    f"case when {str(column not in _FULL_ONLY).lower()} then {value} end as {column}" for column, value in FULL_VALUES.items()
)


@query("ratings_tier", f"select {_AS_RATED} from events")
def ratings_tier(spark, sf_dir):
    """The columns of the ratings tier; those beyond it are NULL."""
    return normalize.project_tier(_full_places(spark, sf_dir).select(*fixed.PLACE_COLUMNS), "ratings").select(*FULL_VALUES)


def _typed(rows):
    kinds = {c: "int" if c in fixed.FLAG_COLUMNS else place_type(c).simpleString() for c in FULL_VALUES}
    return rows.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])


@query("export_csv_all_columns", f"select {_ALL_FLAT} from events")
def export_csv_all_columns(spark, sf_dir):
    """All 44 columns through the CSV export and back."""
    path = scratch_path(spark, "export-csv")
    files.export_csv(_full_places(spark, sf_dir).select(*fixed.PLACE_COLUMNS), path)
    back = spark.read.csv(
        path, header=True, multiLine=True, quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    return _typed(back)


@query("export_json_all_columns", f"select {_ALL_FLAT} from events")
def export_json_all_columns(spark, sf_dir):
    """All 44 columns through the JSON export and back."""
    path = scratch_path(spark, "export-json")
    files.export_json(_full_places(spark, sf_dir).select(*fixed.PLACE_COLUMNS), path)
    schema = ", ".join(
        f"{c} {'int' if c in fixed.FLAG_COLUMNS else place_type(c).simpleString()}" for c in FULL_VALUES
    )
    return _typed(spark.read.schema(schema).json(path))


_STANDARD = normalize.tier_columns("standard")
_SHOWN = ["place_id", "name", "city", "latitude", "primary_type", "types", "phone", "rating",
          "user_rating_count", "takeout"]


@query(
    "tier_projection",
    "select " + ", ".join(
        c if c in _STANDARD else f"null::{place_type(c).simpleString()} as {c}" for c in _SHOWN
    ) + f" from {_PLACES}",
)
def tier_projection(spark, sf_dir):
    return normalize.project_tier(place_rows(spark, sf_dir), "standard").select(*_SHOWN)


@query(
    "row_json",
    f"""select place_id, replace(to_json(struct_pack(city := city, name := name,
      place_id := place_id, price_level := price_level, takeout := takeout))::varchar,
      '\\/', '/') as row_json from {_PLACES}""",
)
def row_json(spark, sf_dir):
    columns = ["place_id", "name", "city", "price_level", "takeout"]
    return view(spark, sf_dir, "places_v").select(
        "place_id", normalize.row_json(columns).alias("row_json")
    )


# --- filters ----------------------------------------------------------------


@query(
    "kind_filter_export",
    f"""select place_id, primary_type from {_PLACES} where (rating >= 2.0)
    and (primary_type is null or primary_type not in ({words(fixed.NON_RESTAURANT_TYPES)}))""",
)
def kind_filter_export(spark, sf_dir):
    flat = normalize.flat_view(view(spark, sf_dir, "places_v"))
    return filters.select_places(flat, "rating >= 2.0", include_all=False).select(
        "place_id", "primary_type"
    )


_WHERE = "takeout = 1 and city <> 'NATION_3' or price_level = 0"


@query(
    "user_filter",
    f"""select place_id, takeout, price_level from (select * replace (takeout::int as takeout)
    from {_PLACES}) where {_WHERE}""",
)
def user_filter(spark, sf_dir):
    flat = normalize.flat_view(view(spark, sf_dir, "places_v"))
    return filters.select_places(flat, _WHERE).select("place_id", "takeout", "price_level")


@query(
    "wanted_kinds",
    f"""select place_id, primary_type from {_PLACES} where coalesce(user_rating_count, 0) >= 25
    and (coalesce(primary_type, '') in ('hotel', 'bar')
      or coalesce(primary_type, '') not in ({words(fixed.NON_RESTAURANT_TYPES)}))""",
)
def wanted_kinds(spark, sf_dir):
    """The sweep's own filter: the bar first, then kinds, asked-for kinds exempt."""
    places = view(spark, sf_dir, "places_v")
    return places.where(~filters.below_bar(F.col("user_rating_count"), 25)).where(
        filters.wanted_kind(F.col("primary_type"), ["hotel", "bar"])
    ).select("place_id", "primary_type")


# --- folding ----------------------------------------------------------------

_LATEST = ", ".join(
    f"arg_max({c}, row(seen_at, ingest_seq)) filter (where {c} is not null) as {c}"
    for c in _CONTENT
)
_FOLDED = f"""(select place_id, {_LATEST}, min(seen_at) as first_seen_at,
  max(seen_at) as last_seen_at from {_OBSERVED} group by place_id)"""
_FOLD_COLUMNS = ["place_id", *_CONTENT, "first_seen_at", "last_seen_at"]


@query("latest_non_null", f"select {', '.join(_FOLD_COLUMNS)} from {_FOLDED}")
def latest_non_null(spark, sf_dir):
    state = fold.fold_observations(view(spark, sf_dir, "observations_v"))
    return fold.places_of(state).select(*_FOLD_COLUMNS)


@query(
    "upsert_snapshot",
    f"""select f.*, f.first_seen_at >= timestamp '1998-01-01' as is_new from
      (select {', '.join(_FOLD_COLUMNS)} from {_FOLDED}) as f""",
)
def upsert_snapshot(spark, sf_dir):
    """Two batches: a snapshot of the early observations, then the later ones."""
    observed = view(spark, sf_dir, "observations_v")
    split = F.lit(datetime(1998, 1, 1))
    state = fold.fold_observations(observed.where(F.col("seen_at") < split))
    later = observed.where(F.col("seen_at") >= split)
    fresh = fold.new_places(state, later).withColumn("is_new", F.lit(True))
    merged = fold.places_of(fold.upsert(state, later)).select(*_FOLD_COLUMNS)
    return merged.join(fresh, "place_id", "left").withColumn(
        "is_new", F.coalesce(F.col("is_new"), F.lit(False))
    )


_BLANKED = ", ".join(
    f"case when last_seen_at < timestamp '2001-06-01' then null else {c} end as {c}"
    for c in _CONTENT
)


@query(
    "prune_stale",
    f"select place_id, {_BLANKED}, first_seen_at, last_seen_at from {_FOLDED}",
)
def prune_stale(spark, sf_dir):
    state = fold.fold_observations(view(spark, sf_dir, "observations_v"))
    return fold.places_of(fold.prune_stale(state, _CUTOFF)).select(*_FOLD_COLUMNS)


@query(
    "prune_count",
    f"""select count(*) filter (where last_seen_at < timestamp '2001-06-01') as n_pruned
    from {_FOLDED}""",
)
def prune_count(spark, sf_dir):
    state = fold.fold_observations(view(spark, sf_dir, "observations_v"))
    return fold.count_stale(state, _CUTOFF)


@query(
    "prune_refold",
    f"select place_id, {_BLANKED}, first_seen_at, last_seen_at from {_FOLDED}",
)
def prune_refold(spark, sf_dir):
    """Pruning the observation log, then folding it again, brings nothing back."""
    log = fold.prune_log(view(spark, sf_dir, "observations_v"), _CUTOFF)
    return fold.places_of(fold.fold_observations(log)).select(*_FOLD_COLUMNS)


@query("stream_upsert", f"select {', '.join(_FOLD_COLUMNS)} from {_FOLDED}")
def stream_upsert(spark, sf_dir):
    """The observations as a stream, folded into a store batch by batch."""
    orders = table(spark, sf_dir, "orders")
    stream = (
        spark.readStream.schema(orders.schema)
        .option("pathGlobFilter", "orders.parquet")
        .parquet(sf_dir)
    )
    observed = stream.select(
        F.concat(F.lit("P"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("place_id"),
        F.col("o_orderdate").alias("seen_at"),
        F.col("o_orderkey").alias("ingest_seq"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")).alias("rating"),
        F.when(F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")).alias(
            "website"
        ),
        F.col("o_orderstatus").alias("name"),
    )
    store = PlaceStore(spark, scratch_path(spark, "stream-store"), content=_CONTENT)
    running = start_upsert(observed, store, scratch_path(spark, "stream-checkpoint"))
    running.awaitTermination()
    return store.places().select(*_FOLD_COLUMNS)


_SEEN = view_sql("sightings_v")
_NEWEST = {
    "name": "json_extract_string(payload, '$.displayName.text')",
    "rating": "json_extract(payload, '$.rating')::double",
    "website": "json_extract_string(payload, '$.websiteUri')",
    "takeout": "json_extract(payload, '$.takeout')::boolean",
}


@query(
    "payload_upsert",
    f"""select json_extract_string(payload, '$.id') as place_id, {', '.join(
        f"arg_max({value}, (seen_at, ingest_seq)) filter (where {value} is not null) as {column}"
        for column, value in _NEWEST.items())},
      min(seen_at) as first_seen_at, max(seen_at) as last_seen_at
    from {_SEEN} group by 1""",
)
def payload_upsert(spark, sf_dir):
    """Raw payloads as a stream: parsed, folded batch by batch, the store compacted."""
    observed = normalize.normalize_payload(stream(spark, sf_dir, "sightings_v"))
    store = PlaceStore(spark, scratch_path(spark, "payload-store"), buckets=2)
    start_upsert(observed, store, scratch_path(spark, "payload-checkpoint")).awaitTermination()
    early = normalize.normalize_payload(view(spark, sf_dir, "sightings_v").where("ingest_seq % 10 = 0"))
    store.upsert(early, "again")  # what was seen before changes nothing
    store.compact()
    return store.places().select("place_id", *_NEWEST, "first_seen_at", "last_seen_at")


@query(
    "keyed_rows",
    f"""select place_id, count(*) as n_seen, max(seen_at) as last_seen_at
    from (select * replace (case ingest_seq % 9 when 0 then null when 1 then '' else place_id end as place_id)
      from {_OBSERVED}) where coalesce(place_id, '') <> '' group by place_id""",
)
def keyed_rows(spark, sf_dir):
    """Rows without a key are left out before the fold."""
    seq = F.col("ingest_seq")
    key = F.when(seq % 9 == 0, None).when(seq % 9 == 1, "").otherwise(F.col("place_id"))
    observed = view(spark, sf_dir, "observations_v").withColumn("place_id", key)
    places = fold.places_of(fold.fold_observations(observed))
    counts = observed.where(filters.has_key(F.col("place_id"))).groupBy("place_id").agg(F.count("*").alias("n_seen"))
    return places.join(counts, "place_id").select("place_id", "n_seen", "last_seen_at")


@query(
    "bar_by_tier",
    f"""select tier, tier in ('ids', 'standard') as refused, count(*) as n_results,
      count(case when tier not in ('ids', 'standard') then user_rating_count end) as n_with_review_count,
      count(case when tier not in ('ids', 'standard') then user_rating_count end) > 0 as bar_usable
    from {_PLACES}, (values ('ids'), ('standard'), ('ratings'), ('full')) as t(tier) group by tier""",
)
def bar_by_tier(spark, sf_dir):
    """Which field tiers refuse a review bar, and what the tier leaves of the counts it needs."""
    found = None
    for tier in fixed.TIERS:
        try:
            normalize.check_review_bar(tier, 25)
            refused = False
        except ValueError:
            refused = True
        profile = normalize.payload_profile(normalize.project_tier(place_rows(spark, sf_dir), tier))
        row = profile.select(F.lit(tier).alias("tier"), F.lit(refused).alias("refused"), "*")
        found = row if found is None else found.unionByName(row)
    return found


# --- ordering, summaries, exports -------------------------------------------

_FOLD_NAME = (
    "translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)


@query(
    "name_order_rank",
    f"""select place_id, row_number() over (order by {_FOLD_NAME} nulls first, place_id) - 1
      as name_rank from (select place_id, case when record_pos % 17 = 0 then null
        when record_pos % 2 = 0 then lower(name) else name end as name from {_PLACES})""",
)
def name_order_rank(spark, sf_dir):
    pos = F.col("record_pos")
    name = F.when(pos % 17 == 0, None).when(pos % 2 == 0, F.lower("name")).otherwise(F.col("name"))
    named = view(spark, sf_dir, "places_v").select("place_id", name.alias("name"))
    return number_rows(named, report.name_order(), "name_rank").select("place_id", "name_rank")


@query(
    "dataset_summary",
    f"""select count(*) as total, count(rating) as rated,
      round(coalesce(avg(rating), 0), 6) as mean_rating, count(salesforce_synced_at) as synced
    from {_PLACES}""",
)
def dataset_summary(spark, sf_dir):
    summary = report.dataset_summary(view(spark, sf_dir, "places_v"))
    return summary.withColumn("mean_rating", F.round("mean_rating", 6))


@query(
    "city_counts",
    f"""select coalesce(nullif(city, ''), '(unknown)') as city, count(*) as n_places
    from {_PLACES} group by 1""",
)
def city_counts(spark, sf_dir):
    return report.city_counts(view(spark, sf_dir, "places_v"))


@query(
    "top_cities",
    f"""select city, n_places from (
      select coalesce(nullif(city, ''), '(unknown)') as city, count(*) as n_places,
        min({_FOLD_NAME}) as k from {_PLACES} group by 1)
    order by n_places desc, k limit 10""",
)
def top_cities(spark, sf_dir):
    return report.top_cities(view(spark, sf_dir, "places_v"))


@query("row_count", f"select count(*) as n_rows from {_OBSERVED}")
def row_count(spark, sf_dir):
    return report.row_count(view(spark, sf_dir, "observations_v"))


_EXPORTED = ["place_id", "name", "city", "latitude", "rating", "price_level", "takeout", "website"]


@query(
    "export_csv_roundtrip",
    f"""select place_id, name, nullif(city, '') as city, latitude::double as latitude,
      round(rating, 1) as rating, price_level, takeout::int as takeout,
      nullif(website, '') as website from {_PLACES}""",
)
def export_csv_roundtrip(spark, sf_dir):
    """Write the CSV export, read it back; NULL and empty text are one there."""
    path = scratch_path(spark, "export-csv")
    files.export_csv(place_rows(spark, sf_dir), path)
    back = spark.read.csv(
        path, header=True, multiLine=True, quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    return back.select(
        "place_id", "name", "city", F.col("latitude").cast("double").alias("latitude"),
        F.round(F.col("rating").cast("double"), 1).alias("rating"),
        F.col("price_level").cast("int").alias("price_level"),
        F.col("takeout").cast("int").alias("takeout"), "website",
    )


@query(
    "export_json_roundtrip",
    f"""select place_id, name, city, latitude, round(rating, 1) as rating, price_level,
      takeout::int as takeout, website, true as keeps_nulls from {_PLACES}""",
)
def export_json_roundtrip(spark, sf_dir):
    """Write the JSON export, read it back; every row spells out its NULLs."""
    path = scratch_path(spark, "export-json")
    files.export_json(place_rows(spark, sf_dir), path)
    kinds = {"latitude": "double", "rating": "double", "price_level": "int", "takeout": "int"}
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in _EXPORTED)
    return spark.read.text(path).select(
        F.from_json("value", schema).alias("r"),
        F.contains(F.col("value"), F.lit('"plus_code":null')).alias("keeps_nulls"),
    ).select(
        *[F.col(f"r.{c}") for c in _EXPORTED if c != "rating"],
        F.round("r.rating", 1).alias("rating"),
        "keeps_nulls",
    )


@query(
    "collected_records",
    f"""select place_id, name, latitude as lat, longitude as lng,
      coalesce(nullif(phone_international, ''), phone) as phone, formatted_address as address,
      row_number() over (order by {_FOLD_NAME} nulls first, place_id) - 1 as record_pos
    from {_PLACES}""",
)
def collected_records(spark, sf_dir):
    return files.collected_records(place_rows(spark, sf_dir))
