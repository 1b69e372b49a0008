"""Target records, batching, delivery."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from placeloom import fixed
from placeloom.operators import fold, outbound
from placeloom.schemas import SNAPSHOT
from placeloom.sources.tables import TargetTable

NOW = datetime(2024, 5, 1, 8, 30)


def place(place_id, **values):
    row = dict.fromkeys(SNAPSHOT.fieldNames())
    row.update(values, place_id=place_id)
    return tuple(row.values())


def payloads(df):
    return [json.loads(r.payload) for r in outbound.payload(df).orderBy("source_place_id").collect()]


def test_records(spark):
    rows = [
        place("a", name="  Cafe\t", website="  ", takeout=False, delivery=True, rating=4.5,
              formatted_address="x" * 300, price_level=0),
        place("b", name="n" * 90, salesforce_synced_at=NOW),
        place("", name="keyless"),
    ]
    places = spark.createDataFrame(rows, SNAPSHOT)
    first, second = payloads(outbound.outbound_records(places, stamped_at=NOW))
    assert first == {
        "Google_Place_Id__c": "a", "Name": "Cafe", "Takeout__c": False, "Delivery__c": True,
        "Rating__c": 4.5, "Formatted_Address__c": "x" * 255, "Price_Level__c": 0,
        "Last_Synced__c": "2024-05-01T08:30:00Z",
    }
    assert second["Name"] == "n" * 80
    account = outbound.outbound_records(places, "Account", only_unsynced=True, stamped_at=NOW)
    assert payloads(account) == [{"Google_Place_Id__c": "a", "Name": "Cafe"}]
    typed = outbound.build_records(places, fixed.RESTAURANT_FIELDS, typed=True)
    assert typed.schema["Rating__c"].dataType.simpleString() == "decimal(2,1)"
    with pytest.raises(ValueError):
        outbound.outbound_records(places, external_id="Other__c")


def test_limit_counts_before_keyless_rows_are_dropped(spark):
    places = spark.createDataFrame(
        [place("", name="a"), place("p", name="b"), place("q", name="c")], SNAPSHOT)
    assert outbound.outbound_records(places, limit=2).count() == 1
    assert outbound.outbound_records(places, limit=0).count() == 2


def test_delivery_by_position_and_write_back(spark):
    rows = [place(f"p{k}", name=f"{'Z' if k % 2 else 'y'}{k}") for k in range(7)]
    places = spark.createDataFrame(rows, SNAPSHOT).repartition(3)
    batches = outbound.number_batches(outbound.outbound_records(places, stamped_at=NOW), 3)
    sizes = {r.batch_id: r["count"] for r in batches.groupBy("batch_id").count().collect()}
    assert sizes == {0: 3, 1: 3, 2: 1}

    def send(texts):
        assert len(texts) <= 3
        keys = [json.loads(t)["Google_Place_Id__c"] for t in texts]
        return [{"success": k != "p3", "created": k == "p0", "id": "x" + k,
                 "errors": ["no"] if k == "p3" else []} for k in keys]

    matched = outbound.match_results(batches, outbound.deliver(outbound.payload(batches), send))
    summary = outbound.sync_summary(batches, matched).first().asDict()
    assert summary == {"total": 7, "success": 6, "created": 1, "failed": 1}
    marked = fold.mark_synced(places, outbound.delivered_ids(matched), NOW)
    links = {r.place_id: (r.salesforce_id, r.salesforce_synced_at) for r in marked.collect()}
    assert links["p0"] == ("xp0", NOW) and links["p3"] == (None, None)


def test_target_table(spark, tmp_path):
    rows = spark.createDataFrame([("a", "A", 1), ("b", None, 2)], "k string, v string, n int")
    table = TargetTable(spark, str(tmp_path / "t"), rows.schema, "k", 4)
    assert table.upsert(rows) == {"created": 2, "updated": 0}
    more = spark.createDataFrame([("a", None, 5), ("c", "C", None)], rows.schema)
    assert table.upsert(more) == {"created": 1, "updated": 1}
    got = {r.k: (r.v, r.n) for r in table.read().collect()}
    assert got == {"a": ("A", 5), "b": (None, 2), "c": ("C", None)}
    assert table.upsert(rows.limit(0)) == {"created": 0, "updated": 0}


def test_sync_of_a_store_and_dry_run(spark, tmp_path):
    from placeloom.schemas import OBSERVATION
    from placeloom.sources.sync import send_to, send_with, sync_store
    from placeloom.sources.tables import PlaceStore, TargetTable

    from test_places import observation

    store = PlaceStore(spark, str(tmp_path / "store"), buckets=2)
    rows = [observation(k, 1, name=n, primary_type="cafe") for k, n in (("a", "Uno"), ("b", "Dos"), ("c", "Tres"))]
    store.upsert(spark.createDataFrame(rows, OBSERVATION))
    key = "Google_Place_Id__c"
    table = TargetTable(spark, str(tmp_path / "target"), spark.createDataFrame([], f"{key} string, Name string").schema, key, 2)
    table.upsert(spark.createDataFrame([("b", "old"), ("b", "older")], f"{key} string, Name string"))
    assert table.read().count() == 1
    dry = sync_store(store, send_to(table), NOW, dry_run=True)
    assert dry.summary == {"total": 3, "success": 0, "created": 0, "failed": 0} and '"Dos"' in dry.first_record
    assert table.read().count() == 1 and store.places().where("salesforce_synced_at is not null").isEmpty()
    done = sync_store(store, send_to(table), NOW)
    assert done.summary == {"total": 3, "success": 3, "created": 2, "failed": 0}
    assert {r[key]: r.Name for r in table.read().collect()} == {"a": "Uno", "b": "Dos", "c": "Tres"}
    assert store.places().where("salesforce_synced_at is null").isEmpty()
    # A receiver that answers short: the rest counts as failed.
    short = sync_store(store, send_with(lambda payloads: [{"success": True, "id": "1"}]), NOW)
    assert (short.summary["success"], short.summary["failed"]) == (1, 2)
