"""Target records, batches, deliveries and what they change."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from placeloom.operators import fold, outbound
from placeloom.plans.place_queries import place_rows
from placeloom.plans.registry import query
from placeloom.plans.views import view_sql
from placeloom.session import scratch_path
from placeloom.sources.sync import send_to, sync_places
from placeloom.sources.tables import TargetTable

_PLACES = view_sql("places_v")
_AS_OF = datetime(2001, 6, 1, 12, 0, 0)
_STAMP = "2001-06-01T12:00:00Z"
_NAME_KEY = "translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BATCH = 100


@query(
    "outbound_records",
    f"""select place_id as google_place_id, nullif(trim(name), '') as name,
      nullif(trim(website), '') as website, nullif(trim(city), '') as city,
      price_level, takeout, left(formatted_address, 255) as formatted_address,
      '{_STAMP}' as last_synced from {_PLACES}""",
)
def outbound_records(spark, sf_dir):
    records = outbound.outbound_records(place_rows(spark, sf_dir), stamped_at=_AS_OF)
    return records.select(
        F.col("Google_Place_Id__c").alias("google_place_id"),
        F.col("Name").alias("name"),
        F.col("Website__c").alias("website"),
        F.col("City__c").alias("city"),
        F.col("Price_Level__c").alias("price_level"),
        F.col("Takeout__c").alias("takeout"),
        F.col("Formatted_Address__c").alias("formatted_address"),
        F.col("Last_Synced__c").alias("last_synced"),
    )


@query(
    "outbound_account_payload",
    f"""select place_id, '{{' || array_to_string(list_filter([
        '"Google_Place_Id__c":"' || place_id || '"', '"Name":"' || trim(name) || '"',
        '"Website":"' || nullif(trim(website), '') || '"', '"Phone":"' || phone || '"',
        '"BillingCity":"' || nullif(trim(city), '') || '"'], lambda f: f is not null), ',')
      || '}}' as payload from {_PLACES} where salesforce_synced_at is null""",
)
def outbound_account_payload(spark, sf_dir):
    """The shorter map, unsynced places only, no stamp, NULL fields left out."""
    records = outbound.outbound_records(
        place_rows(spark, sf_dir), "Account", only_unsynced=True, stamped_at=_AS_OF
    )
    return outbound.payload(records).select(
        F.col("source_place_id").alias("place_id"), "payload"
    )


_BATCHES = f"""(select place_id, name, r // {_BATCH} as batch_id, r % {_BATCH} as pos,
    record_pos from (select *, row_number() over (order by {_NAME_KEY} nulls first, place_id) - 1
      as r from {_PLACES}))"""


def _batches(spark, sf_dir):
    records = outbound.outbound_records(place_rows(spark, sf_dir), stamped_at=_AS_OF)
    return outbound.number_batches(records, _BATCH)


@query("outbound_batches", f"select place_id, batch_id, pos from {_BATCHES}")
def outbound_batches(spark, sf_dir):
    return _batches(spark, sf_dir).select(
        F.col("source_place_id").alias("place_id"), "batch_id", "pos"
    )


@query(
    "outbound_limited",
    f"""select place_id from (select * from {_PLACES} order by {_NAME_KEY} nulls first, place_id
      limit 500)""",
)
def outbound_limited(spark, sf_dir):
    """A limit counts places in name order, before keyless ones are dropped."""
    records = outbound.outbound_records(place_rows(spark, sf_dir), limit=500)
    return records.select(F.col("source_place_id").alias("place_id"))


# Answers as a receiving system would give them, by batch and position.
_ANSWERS = f"""(select batch_id, pos, record_pos % 10 <> 0 as success,
  record_pos % 3 = 0 as created, case when record_pos % 10 <> 0 and record_pos % 4 <> 0
    then 'b' || record_pos::varchar end as id from {_BATCHES})"""


def _matched(spark, sf_dir):
    batches = _batches(spark, sf_dir)
    pos = F.substring("source_place_id", 2, 9).cast("bigint")
    answers = batches.select(
        "batch_id",
        "pos",
        (pos % 10 != 0).alias("success"),
        (pos % 3 == 0).alias("created"),
        F.when((pos % 10 != 0) & (pos % 4 != 0), F.concat(F.lit("b"), pos.cast("string"))).alias(
            "id"
        ),
    )
    return batches, outbound.match_results(batches, answers)


@query(
    "sync_summary",
    f"""select (select count(*) from {_BATCHES}) as total,
      count(*) filter (where success) as success,
      count(*) filter (where success and created) as created,
      count(*) filter (where not success) as failed from {_ANSWERS}""",
)
def sync_summary(spark, sf_dir):
    batches, matched = _matched(spark, sf_dir)
    return outbound.sync_summary(batches, matched)


@query(
    "mark_synced",
    f"""select p.place_id, coalesce(a.id, p.salesforce_id) as salesforce_id,
      case when a.success then timestamp '2001-06-01 12:00:00' else p.salesforce_synced_at end
        as salesforce_synced_at
    from {_PLACES} as p join {_BATCHES} as b using (place_id)
    join (select * replace (case when success then id end as id) from {_ANSWERS}) as a
      on a.batch_id = b.batch_id and a.pos = b.pos""",
)
def mark_synced(spark, sf_dir):
    _, matched = _matched(spark, sf_dir)
    marked = fold.mark_synced(place_rows(spark, sf_dir), outbound.delivered_ids(matched), _AS_OF)
    return marked.select("place_id", "salesforce_id", "salesforce_synced_at")


@query(
    "target_upsert",
    f"""select place_id as google_place_id,
      case when record_pos % 2 = 0 then 'old name' end as old_name,
      name, coalesce(nullif(trim(website), ''),
        case when record_pos % 2 = 0 then 'old site' end) as website,
      nullif(trim(city), '') as city,
      case when record_pos % 2 = 0 then 'updated' else 'created' end as change
    from {_PLACES}""",
)
def target_upsert(spark, sf_dir):
    """Half of the places exist in the target already; omitted fields stay."""
    places = place_rows(spark, sf_dir)
    records = outbound.outbound_records(places)
    even = F.substring("place_id", 2, 9).cast("bigint") % 2 == 0
    fields = ["Google_Place_Id__c", "Name", "Website__c", "City__c"]
    existing = places.where(even).select(
        F.col("place_id").alias("Google_Place_Id__c"),
        F.lit("old name").alias("Name"),
        F.lit("old site").alias("Website__c"),
        F.lit(None).cast("string").alias("City__c"),
    )
    table = TargetTable(
        spark, scratch_path(spark, "target"), existing.schema, "Google_Place_Id__c", 8
    )
    table.upsert(existing)
    merged = outbound.upsert_target(table.read(), records.select(*fields), "Google_Place_Id__c")
    table.upsert(records.select(*fields))
    stored = table.read()
    changes = merged.select("Google_Place_Id__c", "change")
    was = existing.select("Google_Place_Id__c", F.col("Name").alias("old_name"))
    return (
        stored.join(changes, "Google_Place_Id__c")
        .join(was, "Google_Place_Id__c", "left")
        .select(
            F.col("Google_Place_Id__c").alias("google_place_id"),
            "old_name",
            F.col("Name").alias("name"),
            F.col("Website__c").alias("website"),
            F.col("City__c").alias("city"),
            "change",
        )
    )


@query(
    "delivered_results",
    f"""select place_id, true as success, 'r' || place_id as id from {_PLACES}""",
)
def delivered_results(spark, sf_dir):
    """Batches handed to a sender on the executors; answers come back by position."""
    batches = outbound.payload(_batches(spark, sf_dir))

    def send(payloads):
        import json

        ids = [json.loads(p)["Google_Place_Id__c"] for p in payloads]
        return [{"success": True, "created": True, "id": "r" + i} for i in ids]

    results = outbound.deliver(batches, send)
    return outbound.match_results(batches, results).select("place_id", "success", "id")


@query(
    "sync_job",
    f"""select place_id, true as success, record_pos % 2 <> 0 as created, place_id as id
    from {_PLACES} where salesforce_synced_at is null""",
)
def sync_job(spark, sf_dir):
    """Unsynced places into a table that holds every other key already."""
    places = place_rows(spark, sf_dir)
    even = F.substring("place_id", 2, 9).cast("bigint") % 2 == 0
    existing = places.where(even).select(
        F.col("place_id").alias("Google_Place_Id__c"), F.lit("old name").alias("Name")
    )
    table = TargetTable(spark, scratch_path(spark, "sync-target"), existing.schema, "Google_Place_Id__c", 8)
    table.upsert(existing)
    result = sync_places(places, send_to(table), batch_size=_BATCH, only_unsynced=True, stamped_at=_AS_OF)
    return result.matched.select("place_id", "success", "created", "id")
