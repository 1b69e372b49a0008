"""Linking the curated list to the places, and explaining what is missing."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeloom import fixed
from placeloom.functions.geo import haversine_m
from placeloom.functions.text import (
    address_key,
    name_norm,
    name_score,
    name_tokens,
    phone_key,
    token_score,
)
from placeloom.operators import diagnose as diag
from placeloom.operators import linkage, sweep
from placeloom.plans.check_sql import hav, words
from placeloom.plans.registry import query
from placeloom.plans.views import table, view, view_sql
from placeloom.session import scratch_path
from placeloom.sources import files

_PLACES = view_sql("places_v")
_CURATED = view_sql("curated_v")
_OPEN = f"(select * from {_CURATED} where not closed)"

_DIGITS = "ltrim(regexp_replace(coalesce({0}, ''), '\\D', '', 'g'), '0')"


def phone_key_sql(column: str) -> str:
    digits = _DIGITS.format(column)
    local = (
        f"case when starts_with({digits}, '372') and length({digits}) - 3 >= 6"
        f" then substr({digits}, 4) else {digits} end"
    )
    return f"(case when length({local}) >= 6 then {local} end)"


def address_key_sql(column: str) -> str:
    head = (
        f"regexp_replace(regexp_replace(split_part(lower(coalesce({column}, '')), ',', 1),"
        " '\\b(tn|tee|pst|mnt|tanav|street|road)\\b', ' ', 'g'), '[^a-z0-9\\- ]+', ' ', 'g')"
    )
    parts = f"list_filter(string_split({head}, ' '), lambda w: w <> '')"
    street = f"list_filter({parts}, lambda w: not regexp_matches(w, '^[0-9]'))"
    number = f"list_filter({parts}, lambda w: regexp_matches(w, '^[0-9]'))"
    return (
        f"(case when len({street}) > 0 and len({number}) > 0"
        f" then array_to_string({street}, ' ') || ' ' || {number}[1] end)"
    )


def norm_sql(column: str) -> str:
    return (
        f"trim(regexp_replace(replace(replace(lower(coalesce({column}, '')), '&', ' and '),"
        " '+', ' and '), '[^a-z0-9]+', ' ', 'g'))"
    )


def tokens_sql(norm: str) -> str:
    parts = f"list_distinct(list_filter(string_split({norm}, ' '), lambda w: w <> ''))"
    kept = f"list_filter({parts}, lambda w: not list_contains([{words(fixed.GENERIC_WORDS)}], w))"
    return f"(case when len({kept}) > 0 then {kept} else {parts} end)"


def _targets(spark, sf_dir):
    return view(spark, sf_dir, "curated_v")


def _open(spark, sf_dir):
    return linkage.split_closed(_targets(spark, sf_dir))[0]


def _records(spark, sf_dir):
    return view(spark, sf_dir, "places_v").select(
        "record_pos",
        "place_id",
        "name",
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lng"),
        "phone",
        F.col("formatted_address").alias("address"),
    )


_PHONES = f"""(select record_pos, case record_pos % 7 when 0 then phone
  when 1 then replace(phone, ' ', '') when 2 then '00372' || (5000000 + record_pos)::varchar
  when 3 then 'n/a' when 4 then (record_pos % 1000)::varchar
  when 5 then '(0) ' || (600000 + record_pos)::varchar end as phone from {_PLACES})"""


@query("phone_keys", f"select record_pos, {phone_key_sql('phone')} as phone_key from {_PHONES}")
def phone_keys(spark, sf_dir):
    pos = F.col("record_pos")
    mobile = (pos + 5000000).cast("string")
    written = (
        F.when(pos % 7 == 0, F.col("phone"))
        .when(pos % 7 == 1, F.replace("phone", F.lit(" "), F.lit("")))
        .when(pos % 7 == 2, F.concat(F.lit("00372"), mobile))
        .when(pos % 7 == 3, "n/a")
        .when(pos % 7 == 4, (pos % 1000).cast("string"))
        .when(pos % 7 == 5, F.concat(F.lit("(0) "), (pos + 600000).cast("string")))
    )
    return view(spark, sf_dir, "places_v").select(
        "record_pos", phone_key(written).alias("phone_key")
    )


_ADDRESSES = f"""(select record_pos, case record_pos % 6 when 0 then formatted_address
  when 1 then replace(formatted_address, ' tn ', ' ')
  when 2 then replace(formatted_address, ', 10133', '-' || (record_pos % 9)::varchar || ', 10133')
  when 3 then 'Tartu mnt, 10133 Tallinn' when 4 then '12, 10133 Tallinn' end as address
  from {_PLACES})"""


@query(
    "address_keys",
    f"select record_pos, {address_key_sql('address')} as address_key from {_ADDRESSES}",
)
def address_keys(spark, sf_dir):
    pos, address = F.col("record_pos"), F.col("formatted_address")
    unit = F.concat(F.lit("-"), (pos % 9).cast("string"), F.lit(", 10133"))
    written = (
        F.when(pos % 6 == 0, address)
        .when(pos % 6 == 1, F.replace(address, F.lit(" tn "), F.lit(" ")))
        .when(pos % 6 == 2, F.replace(address, F.lit(", 10133"), unit))
        .when(pos % 6 == 3, "Tartu mnt, 10133 Tallinn")
        .when(pos % 6 == 4, "12, 10133 Tallinn")
    )
    return view(spark, sf_dir, "places_v").select(
        "record_pos", address_key(written).alias("address_key")
    )


_NAMES = f"""(select record_pos, 'The ' || replace(name, '#', ' & ') as a,
  case record_pos % 4 when 0 then name || ' Bar' when 1 then city when 2 then 'Cafe'
    else 'and the ' || coalesce(city, '') || ' ' || name end as b from {_PLACES})"""


@query(
    "name_token_score",
    f"""with n as (select record_pos, {tokens_sql(norm_sql('a'))} as t,
        {tokens_sql(norm_sql('b'))} as u from {_NAMES}),
      s as (select *, list_intersect(t, u) as x,
        len(list_distinct(list_concat(t, u))) as n_union from n)
    select record_pos, round(case when len(t) = 0 or len(u) = 0 then 0 else greatest(
        len(x)::double / n_union,
        case when len(list_filter(x, lambda w: length(w) >= 5)) > 0 then 0.9 else 0 end,
        case when len(x) = len(t) and len(t) >= 2 then 0.95 else 0 end) end, 6) as token_score
    from s""",
)
def name_token_score(spark, sf_dir):
    pos, name = F.col("record_pos"), F.col("name")
    a = F.concat(F.lit("The "), F.replace(name, F.lit("#"), F.lit(" & ")))
    b = (
        F.when(pos % 4 == 0, F.concat(name, F.lit(" Bar")))
        .when(pos % 4 == 1, F.col("city"))
        .when(pos % 4 == 2, "Cafe")
        .otherwise(F.concat(F.lit("and the "), F.coalesce("city", F.lit("")), F.lit(" "), name))
    )
    pairs = view(spark, sf_dir, "places_v").select(
        "record_pos", name_tokens(name_norm(a)).alias("t"), name_tokens(name_norm(b)).alias("u")
    )
    score = token_score(F.col("t"), F.col("u"))
    return pairs.select("record_pos", F.round(score, 6).alias("token_score"))


@query("name_ratio_score")
def name_ratio_score(spark, sf_dir):
    """The full name score of every curated name against its source place."""
    pairs = (
        _targets(spark, sf_dir)
        .join(
            _records(spark, sf_dir).withColumnRenamed("name", "record_name"),
            F.col("record_pos") == F.col("target_id") * 15,
        )
        .select("target_id", name_norm(F.col("name")).alias("a"),
                name_norm(F.col("record_name")).alias("b"))
        .withColumns({"t": name_tokens(F.col("a")), "u": name_tokens(F.col("b"))})
    )
    score = name_score(F.col("a"), F.col("t"), F.col("b"), F.col("u"))
    return pairs.select("target_id", "a", "b", F.round(score, 6).alias("name_score"))


@query(
    "pair_distance",
    f"""select s.target_id, case when s.lat is not null then
      round({hav('s.lat', 's.lng', 'p.latitude', 'p.longitude')}, 3) end as distance_m from (select * replace (case when target_id % 9 = 0 then null else lat end
      as lat) from {_CURATED}) as s join {_PLACES} as p on p.record_pos = s.target_id * 15""",
)
def pair_distance(spark, sf_dir):
    """Distance from text coordinates; an unusable one makes it unknown."""
    lat = F.when(F.col("target_id") % 9 == 0, "").otherwise(F.col("lat").cast("string"))
    targets = _targets(spark, sf_dir).select("target_id", lat.alias("t_lat"), "lng")
    joined = targets.join(
        _records(spark, sf_dir).select("record_pos", F.col("lat").alias("r_lat"),
                                       F.col("lng").alias("r_lng")),
        F.col("record_pos") == F.col("target_id") * 15,
    )
    distance = haversine_m(
        F.col("t_lat").try_cast("double"), F.col("lng"), F.col("r_lat"), F.col("r_lng")
    )
    return joined.select("target_id", F.round(distance, 3).alias("distance_m"))


@query(
    "closed_split",
    f"""select target_id, coalesce(lower(trim(word)) in ('true', 'yes', '1'), false) as closed
    from (select target_id, case target_id % 6 when 0 then 'true' when 1 then ' YES '
      when 2 then '1' when 3 then 'no' when 4 then '' end as word from {_CURATED})""",
)
def closed_split(spark, sf_dir):
    key = F.col("target_id") % 6
    word = (
        F.when(key == 0, "true").when(key == 1, " YES ").when(key == 2, "1").when(key == 3, "no")
        .when(key == 4, "")
    )
    marked = _targets(spark, sf_dir).select("target_id", word.alias("closed"))
    opened, closed = linkage.split_closed(marked)
    return opened.select("target_id", F.lit(False).alias("closed")).unionByName(
        closed.select("target_id", F.lit(True).alias("closed"))
    )


@query(
    "curated_json_source",
    f"""select target_id::varchar as target_id, name, round(lat, 6) as lat, phone,
      closed::varchar as closed from {_CURATED}""",
)
def curated_json_source(spark, sf_dir):
    """The curated list written as JSON and read with the declared schema."""
    path = scratch_path(spark, "curated-json")
    _targets(spark, sf_dir).write.json(path)
    rows = files.curated_json(spark, path, lines=True)
    return rows.select(
        "target_id", "name", F.round(F.col("lat").cast("double"), 6).alias("lat"), "phone",
        "closed",
    )


def _nearest_sql(target_key: str, record_key: str, limit: int, extra: str = "true") -> str:
    """Nearest record with an equal key; all positions are known in these views."""
    return f"""select target_id, record_pos, round(distance_m, 3) as distance_m from (
      select *, row_number() over (partition by target_id order by distance_m, record_pos) as n
      from (
        select t.target_id, p.record_pos,
          {hav('t.lat', 't.lng', 'p.latitude', 'p.longitude')} as distance_m
        from (select *, {target_key} as k, {phone_key_sql('phone')} as tp from {_OPEN}) as t
        join (select *, {record_key} as k, {phone_key_sql('phone')} as rp from {_PLACES}) as p
          on p.k = t.k
        where {extra}) where distance_m <= {limit}) where n = 1"""


_PHONE_SQL = _nearest_sql(phone_key_sql("phone"), phone_key_sql("phone"), 2000)
# No curated record has both a phone and an address, so no veto can apply.
_ADDRESS_SQL = _nearest_sql(
    address_key_sql("address"), address_key_sql("formatted_address"), 400,
    "not coalesce(t.tp <> p.rp, false)",
)


def _rounded(links):
    return links.select("target_id", "record_pos", F.round("distance_m", 3).alias("distance_m"))


@query("link_by_phone", _PHONE_SQL)
def link_by_phone(spark, sf_dir):
    return _rounded(linkage.link_by_phone(_open(spark, sf_dir), _records(spark, sf_dir)))


@query("link_by_address", _ADDRESS_SQL)
def link_by_address(spark, sf_dir):
    return _rounded(linkage.link_by_address(_open(spark, sf_dir), _records(spark, sf_dir)))


@query("link_by_name_position")
def link_by_name_position(spark, sf_dir):
    links = linkage.link_by_name(_open(spark, sf_dir), _records(spark, sf_dir))
    return links.select(
        "target_id", "record_pos", F.round("distance_m", 3).alias("distance_m"),
        F.round("score", 6).alias("score"),
    )


@query("link_waterfall")
def link_waterfall(spark, sf_dir):
    links = linkage.link(_open(spark, sf_dir), _records(spark, sf_dir))
    return links.withColumn("distance_m", F.round("distance_m", 3))


@query("weak_name_links")
def weak_name_links(spark, sf_dir):
    targets, records = _open(spark, sf_dir), _records(spark, sf_dir)
    weak = linkage.weak_names(linkage.link(targets, records), targets, records)
    return weak.withColumn("name_score", F.round("name_score", 6))


@query("link_summary")
def link_summary(spark, sf_dir):
    compared = linkage.compare(_targets(spark, sf_dir), _records(spark, sf_dir))
    return linkage.link_summary(compared).withColumn("match_pct", F.round("match_pct", 4))


@query("evidence_counts")
def evidence_counts(spark, sf_dir):
    return linkage.evidence_counts(linkage.link(_open(spark, sf_dir), _records(spark, sf_dir)))


# Names of words without a letter in common, so that the sequence ratio never decides:
# without a shared word it is that of the blank between the words alone.
_W = lambda k: f"repeat(chr((98 + ({k}) % 12)::int), 5)"
_WORD_RECORDS = f"""(select record_pos, {_W('record_pos')} || ' ' || {_W('record_pos * 7 + 3')} as name,
    case when record_pos % 40 = 0 then null else latitude end as lat, longitude as lng, phone,
    formatted_address as address
  from {_PLACES})"""
_WORD_TARGETS = f"""(select s_suppkey as target_id,
    case s_suppkey % 5 when 0 then {_W('p.record_pos')} || ' ' || {_W('p.record_pos * 7 + 3')}
      when 1 then {_W('p.record_pos')}
      when 2 then {_W('p.record_pos * 7 + 3')} || ' ' || {_W('p.record_pos')}
      when 3 then 'zzzzz yyyyy' else '' end as name,
    case when s_suppkey % 23 = 0 then null
      else p.latitude + (s_suppkey % 4)::double * 0.0004::double end as lat,
    p.longitude as lng,
    case s_suppkey % 6 when 0 then p.phone
      when 1 then '+372 ' || (9000000 + s_suppkey)::varchar end as phone,
    case when s_suppkey % 4 = 1 then replace(p.formatted_address, ' tn ', ' ') end as address,
    s_suppkey % 17 = 0 as closed
  from supplier join {_PLACES} as p on p.record_pos = 1 + (s_suppkey * 13) % 1400)"""
_WORD_LINKS = f"""
  r as materialized (select *, {phone_key_sql('phone')} as r_phone, {address_key_sql('address')} as r_address,
    list_distinct(list_filter(string_split(name, ' '), lambda w: w <> '')) as rw from {_WORD_RECORDS}),
  t as materialized (select *, {phone_key_sql('phone')} as t_phone, {address_key_sql('address')} as t_address,
    list_distinct(list_filter(string_split(name, ' '), lambda w: w <> '')) as tw
    from {_WORD_TARGETS} where not closed),
  met as (select target_id, record_pos, t_phone, r_phone, t_address, r_address, t.name as t_name, r.name as r_name,
      tw, rw, len(list_intersect(tw, rw)) as shared,
      case when t.lat is not null and r.lat is not null then {hav('t.lat', 't.lng', 'r.lat', 'r.lng')} end as d
    from t, r),
  pairs as materialized (select *, coalesce(t_phone <> r_phone, false) as differ,
      case when len(tw) = 0 or len(rw) = 0 then 0
        when shared = 0 then 2.0 * least(length(t_name) - length(replace(t_name, ' ', '')),
          length(r_name) - length(replace(r_name, ' ', ''))) / (length(t_name) + length(r_name))
        else greatest(0.9, shared::double / len(list_distinct(list_concat(tw, rw))),
          case when shared = len(tw) and len(tw) >= 2 then 0.95 else 0 end) end::double as score
    from met where t_phone = r_phone or t_address = r_address or d <= 120),
  by_phone as (select target_id, record_pos, d from (select *, row_number() over (
      partition by target_id order by d is not null, d, record_pos) as n
    from pairs where t_phone = r_phone and (d is null or d <= 2000)) where n = 1),
  by_address as (select target_id, record_pos, d from (select *, row_number() over (
      partition by target_id order by d is not null, d, record_pos) as n
    from pairs where t_address = r_address and (d is null or d <= 400) and (not differ or score >= 0.8)) where n = 1),
  by_name as (select target_id, record_pos, d, score from (select *, row_number() over (
      partition by target_id order by score desc, record_pos) as n
    from pairs where d <= 120 and score >= case when differ then 0.8 else 0.55 end) where n = 1),
  links as (select target_id, 'phone' as evidence, record_pos, d from by_phone
    union all select target_id, 'address', record_pos, d from by_address
      where target_id not in (select target_id from by_phone)
    union all select target_id, 'name+position', record_pos, d from by_name
      where target_id not in (select target_id from by_phone union select target_id from by_address))"""


def _word(k):
    return F.repeat(F.chr((98 + k % 12).cast("int")), 5)


def _word_records(spark, sf_dir):
    pos = F.col("record_pos")
    return view(spark, sf_dir, "places_v").select(
        "record_pos",
        F.concat(_word(pos), F.lit(" "), _word(pos * 7 + 3)).alias("name"),
        F.when(pos % 40 == 0, None).otherwise(F.col("latitude")).alias("lat"),
        F.col("longitude").alias("lng"),
        "phone",
        F.col("formatted_address").alias("address"),
    )


def _word_targets(spark, sf_dir):
    places = view(spark, sf_dir, "places_v")
    key, pos = F.col("s_suppkey"), F.col("record_pos")
    pair = lambda a, b: F.concat(_word(a), F.lit(" "), _word(b))
    name = (
        F.when(key % 5 == 0, pair(pos, pos * 7 + 3)).when(key % 5 == 1, _word(pos))
        .when(key % 5 == 2, pair(pos * 7 + 3, pos)).when(key % 5 == 3, "zzzzz yyyyy").otherwise("")
    )
    phone = F.when(key % 6 == 0, F.col("phone")).when(
        key % 6 == 1, F.concat(F.lit("+372 "), (9000000 + key).cast("string"))
    )
    joined = table(spark, sf_dir, "supplier").join(places, pos == 1 + (key * 13) % 1400)
    return joined.select(
        key.alias("target_id"),
        name.alias("name"),
        F.when(key % 23 == 0, None).otherwise(F.col("latitude") + (key % 4) * 0.0004).alias("lat"),
        F.col("longitude").alias("lng"),
        phone.alias("phone"),
        F.when(key % 4 == 1, F.replace("formatted_address", F.lit(" tn "), F.lit(" "))).alias("address"),
        (key % 17 == 0).alias("closed"),
    )


def _word_links(spark, sf_dir):
    targets, records = linkage.split_closed(_word_targets(spark, sf_dir))[0], _word_records(spark, sf_dir)
    return linkage.link(targets, records), targets, records


@query(
    "word_name_links",
    f"with {_WORD_LINKS} select target_id, record_pos, round(d, 3) as distance_m, round(score, 6) as score from by_name",
)
def word_name_links(spark, sf_dir):
    """The best name within reach, where words decide."""
    targets = linkage.split_closed(_word_targets(spark, sf_dir))[0]
    links = linkage.link_by_name(targets, _word_records(spark, sf_dir))
    return links.select(
        "target_id", "record_pos", F.round("distance_m", 3).alias("distance_m"), F.round("score", 6).alias("score")
    )


@query(
    "word_waterfall",
    f"with {_WORD_LINKS} select target_id, evidence, record_pos, round(d, 3) as distance_m from links",
)
def word_waterfall(spark, sf_dir):
    """Phone, address with its veto, name: each stage only sees what is left."""
    links, _, _ = _word_links(spark, sf_dir)
    return links.withColumn("distance_m", F.round("distance_m", 3))


@query(
    "word_link_summary",
    f"""with {_WORD_LINKS}, n as (select count(*) as curated, count(*) filter (where closed) as closed,
        (select count(*) from links) as matched from {_WORD_TARGETS})
    select curated, closed, matched, curated - closed - matched as missing, curated - closed as comparable,
      round(100.0::double * matched / (curated - closed), 4) as match_pct from n""",
)
def word_link_summary(spark, sf_dir):
    compared = linkage.compare(_word_targets(spark, sf_dir), _word_records(spark, sf_dir))
    return linkage.link_summary(compared).withColumn("match_pct", F.round("match_pct", 4))


@query(
    "word_weak_names",
    f"""with {_WORD_LINKS} select l.target_id, t_name as target_name, l.record_pos, r_name as record_name, evidence,
      round(score, 6) as name_score
    from links as l join pairs as p on p.target_id = l.target_id and p.record_pos = l.record_pos where score < 0.55""",
)
def word_weak_names(spark, sf_dir):
    """Links by phone or address whose names alone would not have matched."""
    links, targets, records = _word_links(spark, sf_dir)
    return linkage.weak_names(links, targets, records).withColumn("name_score", F.round("name_score", 6))


@query("word_evidence_counts", f"with {_WORD_LINKS} select evidence, count(*) as n from links group by evidence")
def word_evidence_counts(spark, sf_dir):
    return linkage.evidence_counts(_word_links(spark, sf_dir)[0])


# Letters with marks fold to plain ones; some have no plain letter and part words.
_MARKED = f"""(select record_pos, chr((192 + record_pos % 64)::int) || 'hb ' || chr((256 + record_pos % 48)::int)
    || 'n' || name as name from {_PLACES})"""


@query(
    "folded_names",
    f"""select record_pos, trim(regexp_replace(strip_accents(lower(name)), '[^a-z0-9]+', ' ', 'g')) as norm
    from {_MARKED}""",
)
def folded_names(spark, sf_dir):
    pos = F.col("record_pos")
    letter = lambda code: F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")
    name = F.concat(letter(192 + pos % 64), F.lit("hb "), letter(256 + pos % 48), F.lit("n"), F.col("name"))
    return view(spark, sf_dir, "places_v").select("record_pos", name_norm(name).alias("norm"))


# Diagnosis treats every curated record as a miss: some lack a position, some
# lie far from all cells, the rest near the logged cells.
_MISSES = f"""(select target_id, case when target_id % 10 = 0 then null
    when target_id % 10 = 1 then lat + 0.5::double else lat end as lat, lng from {_CURATED})"""
_CELLS = f"""(select lat, lng, radius_m, arg_max(saturated, searched_at) as saturated
  from {view_sql('cell_log_v')} group by lat, lng, radius_m)"""
_DIAGNOSED = f"""(select target_id, lat is null as unplaced,
    count(*) filter (where d <= radius_m) as circles,
    count(*) filter (where d <= radius_m and saturated) as n_saturated,
    min(radius_m) filter (where d <= radius_m) as smallest_radius_m,
    min(d - radius_m) as gap_m
  from (select m.target_id, m.lat, c.radius_m, c.saturated,
      {hav('m.lat', 'm.lng', 'c.lat', 'c.lng')} as d from {_MISSES} as m, {_CELLS} as c)
  group by target_id, lat)"""
_REASON = f"""case when unplaced then '{fixed.REASON_NO_POSITION}'
  when circles = 0 then '{fixed.REASON_NEVER_SEARCHED}'
  when circles = n_saturated then '{fixed.REASON_SATURATED}'
  else '{fixed.REASON_NOT_RETURNED}' end"""


def _diagnosed(spark, sf_dir):
    key = F.col("target_id") % 10
    lat = F.when(key == 0, None).when(key == 1, F.col("lat") + 0.5).otherwise(F.col("lat"))
    misses = _targets(spark, sf_dir).select("target_id", lat.alias("lat"), "lng")
    log = view(spark, sf_dir, "cell_log_v")
    cells = log.groupBy("lat", "lng", "radius_m").agg(
        F.max_by("saturated", "searched_at").alias("saturated")
    )
    return diag.diagnose(misses, cells)


@query(
    "miss_diagnosis",
    f"""select target_id, {_REASON} as reason,
      case when not unplaced then circles end as circles,
      case when circles > 0 then n_saturated end as n_saturated, smallest_radius_m,
      case when not unplaced and circles = 0 then round(gap_m, 3) end as gap_m
    from {_DIAGNOSED}""",
)
def miss_diagnosis(spark, sf_dir):
    return _diagnosed(spark, sf_dir).withColumn("gap_m", F.round("gap_m", 3))


@query("miss_reasons", f"select {_REASON} as reason, count(*) as n from {_DIAGNOSED} group by 1")
def miss_reasons(spark, sf_dir):
    return diag.reason_counts(_diagnosed(spark, sf_dir))


@query(
    "search_log_cells",
    f"""select round(lat, 6) as lat, round(lng, 6) as lng, radius_m,
      arg_max(saturated, searched_at) as saturated
    from (select *, coalesce(scope, 'restaurant') as s from {view_sql('cell_log_v')})
    group by s, lat, lng, radius_m""",
)
def search_log_cells(spark, sf_dir):
    """What the diagnosis reads of a cell log."""
    log = sweep.with_scope(view(spark, sf_dir, "cell_log_v")).drop("seq")
    return sweep.latest_log(log).select(
        F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "radius_m", "saturated"
    )
