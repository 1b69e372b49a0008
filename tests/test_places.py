"""Payloads, filters, folding, stores, exports, streaming."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from placeloom import fixed
from placeloom.operators import filters, fold, normalize, report
from placeloom import session
from placeloom.operators import numbering
from placeloom.operators.numbering import first_rows, number_rows
from placeloom.schemas import CELL_LOG, OBSERVATION
from placeloom.sources import files
from placeloom.sources.tables import CellLog, PlaceStore
from placeloom.streaming.upsert import LANDED, start_upsert, stream_payloads

RICH = {
    "id": "r1",
    "displayName": {"text": "Kohvik Põhjala", "languageCode": "et"},
    "formattedAddress": "Peetri 5, 10415 Tallinn",
    "addressComponents": [
        {"longText": "5", "shortText": "5", "types": ["street_number"]},
        {"longText": "", "shortText": "", "types": ["locality", "political"]},
        {"longText": "Tallinn", "shortText": "TLL", "types": ["postal_town"]},
        {"longText": "Second", "types": ["locality"]},
        {"longText": "Estonia", "shortText": "EE", "types": ["country", "political"]},
        {"longText": "untyped"},
    ],
    "location": {"latitude": 59.45, "longitude": 24.73},
    "types": ["cafe", "food"],
    "primaryType": "cafe",
    "primaryTypeDisplayName": {"text": "Cafe"},
    "rating": 4,
    "userRatingCount": 310,
    "priceLevel": "PRICE_LEVEL_MODERATE",
    "regularOpeningHours": {"openNow": False, "weekdayDescriptions": ["Mon: 9-17", "Tue: 9-17"]},
    "editorialSummary": "plain text",
    "takeout": False,
    "delivery": True,
    "accessibilityOptions": {"wheelchairAccessibleEntrance": True},
    "utcOffsetMinutes": 180,
    "plusCode": {"globalCode": "9GF6"},
}


def normalized(spark, *payloads):
    texts = [(k, p if isinstance(p, str) else json.dumps(p, ensure_ascii=False))
             for k, p in enumerate(payloads)]
    df = spark.createDataFrame(texts, "k int, payload string")
    return normalize.normalize_payload(df).orderBy("k").collect()


def test_payloads(spark):
    sparse = {"id": "s", "name": "places/s"}
    odd = {
        "id": "o", "displayName": "bare", "types": [], "priceLevel": "PRICE_LEVEL_NEW",
        "regularOpeningHours": {"weekdayDescriptions": []}, "primaryTypeDisplayName": 7,
        "addressComponents": [{"longText": "", "types": ["locality"]}],
    }
    rich, bare, strange, broken = normalized(spark, RICH, sparse, odd, "{not json")
    assert rich.name == "Kohvik Põhjala" and rich.primary_type_label == "Cafe"
    assert (rich.city, rich.street_number, rich.country, rich.country_code) == (
        "Tallinn", "5", "Estonia", "EE")
    assert (rich.latitude, rich.rating, rich.user_rating_count) == (59.45, 4.0, 310)
    assert (rich.price_level, rich.price_label) == (2, "$$")
    assert rich.types == "cafe,food" and rich.opening_hours == "Mon: 9-17\nTue: 9-17"
    assert (rich.open_now, rich.takeout, rich.delivery, rich.dine_in) == (False, False, True, None)
    assert rich.editorial_summary == "plain text" and rich.wheelchair_accessible_entrance is True
    assert (rich.utc_offset_minutes, rich.plus_code) == (180, "9GF6")
    assert json.loads(rich.raw_json) == RICH
    assert bare.place_id == "s"
    assert all(bare[c] is None for c in fixed.PLACE_COLUMNS if c != "place_id")
    assert strange.name == "bare" and strange.types is None and strange.opening_hours is None
    assert strange.price_level is None and strange.primary_type_label is None
    assert strange.city == ""
    assert broken.place_id is None


def test_responses(spark):
    rows = [('{"places":[{"id":"a"},{"id":"b"}]}',), ("{}",), ('{"places":[]}',)]
    got = files.explode_response(spark.createDataFrame(rows, "response string")).collect()
    assert [json.loads(r.payload)["id"] for r in got] == ["a", "b"]


def test_tiers():
    sizes = [set(normalize.tier_columns(t)) for t in fixed.TIERS]
    assert sizes[0] < sizes[1] < sizes[2] < sizes[3] == set(fixed.PLACE_COLUMNS)
    with pytest.raises(ValueError):
        normalize.tier_columns("everything")
    normalize.check_review_bar("ratings", 25)
    normalize.check_review_bar("ids", 0)
    with pytest.raises(ValueError):
        normalize.check_review_bar("standard", 25)


def test_tier_reads_only_its_columns(spark, tmp_path):
    store = PlaceStore(spark, str(tmp_path / "s"))
    store.upsert(spark.createDataFrame([observation("a", 1, name="A", rating=4.0)], OBSERVATION))
    projected = normalize.project_tier(store.places(), "ids")
    plan = projected._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema:")[1]
    assert "place_id" in schema and "rating" not in schema


def test_kinds_and_bar(spark):
    rows = [("restaurant",), ("hotel",), (None,), ("",), ("new_kind",), ("night_club",)]
    df = spark.createDataFrame(rows, "k string")
    kind = F.col("k")
    got = df.select(filters.is_restaurant(kind), filters.wanted_kind(kind, ["hotel"])).collect()
    assert [r[0] for r in got] == [True, False, True, True, True, False]
    assert [r[1] for r in got] == [True, True, True, True, True, False]
    counts = spark.createDataFrame([(None,), (24,), (25,)], "n bigint")
    low = counts.select(filters.below_bar(F.col("n"), 25), filters.below_bar(F.col("n"), 0))
    assert [tuple(r) for r in low.collect()] == [(True, False), (True, False), (False, False)]


NOW = datetime(2024, 5, 1)


def observation(place_id, seq, seen=None, **values):
    row = dict.fromkeys(OBSERVATION.fieldNames())
    row.update(values, place_id=place_id, ingest_seq=seq, seen_at=seen or NOW + timedelta(hours=seq))
    return tuple(row.values())


ROWS = [
    observation("a", 1, name="Old", rating=4.5, takeout=True, city="Tallinn"),
    observation("a", 2, name="New", rating=None, takeout=False, city=""),
    observation("a", 3, name=None, rating=0.0),
    observation("b", 4, name="B", user_rating_count=0),
    observation("", 5, name="no key"),
    observation(None, 6, name="no key"),
]


def by_id(places):
    return {r.place_id: r for r in places.collect()}


def test_fold_keeps_known_values(spark):
    got = by_id(fold.places_of(fold.fold_observations(spark.createDataFrame(ROWS, OBSERVATION))))
    assert set(got) == {"a", "b"}
    a = got["a"]
    assert (a.name, a.rating, a.takeout, a.city) == ("New", 0.0, False, "")
    assert a.first_seen_at == NOW + timedelta(hours=1) and a.last_seen_at == NOW + timedelta(hours=3)
    assert got["b"].user_rating_count == 0 and got["b"].takeout is None


def test_fold_in_any_order_any_split_and_twice_is_the_same(spark):
    df = lambda rows: spark.createDataFrame(rows, OBSERVATION)
    whole = sorted(map(repr, fold.fold_observations(df(ROWS)).collect()))
    for cut in (1, 2, 4):
        late_first = fold.upsert(fold.fold_observations(df(ROWS[cut:])), df(ROWS[:cut]))
        again = fold.upsert(late_first, df(ROWS[1:3]))
        assert sorted(map(repr, again.collect())) == whole
    ids = fold.new_places(fold.fold_observations(df(ROWS[:1])), df(ROWS)).collect()
    assert [r.place_id for r in ids] == ["b"]


def test_store_upserts_prunes_and_reopens(spark, tmp_path):
    path = str(tmp_path / "places")
    store = PlaceStore(spark, path, buckets=4)
    assert store.count() == 0
    store.upsert(spark.createDataFrame(ROWS[:1], OBSERVATION))
    store.upsert(spark.createDataFrame(ROWS[1:], OBSERVATION))
    store.upsert(spark.createDataFrame(ROWS[1:], OBSERVATION))
    held = store.places()
    results = spark.createDataFrame([("a", "crm1"), ("b", None)], "place_id string, id string")
    store.mark_synced(results, NOW + timedelta(days=1))
    store.mark_synced(results.withColumn("id", F.lit(None).cast("string")), NOW + timedelta(days=2))
    got = by_id(PlaceStore(spark, path, buckets=4).places())
    assert got["a"].salesforce_id == "crm1" and got["b"].salesforce_id is None
    assert got["b"].salesforce_synced_at == NOW + timedelta(days=2)
    assert store.prune(NOW + timedelta(hours=3, minutes=30)) == 1
    assert store.prune(NOW + timedelta(hours=3, minutes=30)) == 1
    got = by_id(store.places())
    assert got["a"].name is None and got["a"].salesforce_id == "crm1"
    assert got["a"].last_seen_at == NOW + timedelta(hours=3) and got["b"].name == "B"
    # A reader that started earlier still sees what it opened.
    assert by_id(held)["a"].name == "New"


def test_unknown_ids_and_replays_after_a_prune(spark, tmp_path):
    store = PlaceStore(spark, str(tmp_path / "places"), buckets=8)
    results = spark.createDataFrame([(f"unknown{k}", "x") for k in range(20)], "place_id string, id string")
    store.mark_synced(results, NOW)
    assert store.count() == 0
    store.upsert(spark.createDataFrame(ROWS[:4], OBSERVATION))
    before = sorted(map(repr, store.places().collect()))
    store.mark_synced(results, NOW)
    assert sorted(map(repr, store.places().collect())) == before
    store.prune(NOW + timedelta(hours=3, minutes=30))
    blank = by_id(store.places())["a"]
    assert blank.name is None
    store.upsert(spark.createDataFrame(ROWS[:3], OBSERVATION))
    assert by_id(store.places())["a"] == blank
    store.upsert(spark.createDataFrame([observation("a", 9, name="Seen again")], OBSERVATION))
    assert by_id(store.places())["a"].name == "Seen again"


def parquet_bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_small_batches_are_cheap_and_replays_add_nothing(spark, tmp_path):
    """What a batch writes follows the batch; a compaction is a job of its own."""
    path = str(tmp_path / "places")
    store = PlaceStore(spark, path, buckets=3)
    big = spark.range(5000).select(F.concat(F.lit("p"), "id").alias("place_id"))
    columns = [f for f in OBSERVATION.fields if f.name not in ("place_id", "seen_at", "ingest_seq")]
    big = big.select(
        "place_id", *[F.sha2(F.col("place_id"), 256).cast(f.dataType).alias(f.name) if f.dataType.simpleString() == "string"
                      else F.lit(None).cast(f.dataType).alias(f.name) for f in columns],
        F.lit(NOW).alias("seen_at"), F.lit(1).cast("bigint").alias("ingest_seq"),
    )
    assert store.upsert(big, "first")
    whole = parquet_bytes(path)
    few = spark.createDataFrame([observation(f"p{k}", 5, name="new") for k in range(3)], OBSERVATION)
    assert store.upsert(few, "second")
    assert parquet_bytes(path) - whole < 0.05 * whole
    files = {n: os.listdir(tmp_path / "places" / n) for n in os.listdir(tmp_path / "places")}
    assert not store.upsert(few, "second")
    assert {n: os.listdir(tmp_path / "places" / n) for n in os.listdir(tmp_path / "places")} == files
    before = sorted(map(repr, store.places().collect()))
    assert store.compact() == 2 and store.compact() == 1
    assert sorted(map(repr, store.places().collect())) == before
    # Names outlive the compaction, and later batches fold onto its rows.
    assert not store.upsert(few, "second") and not store.upsert(big, "first")
    store.upsert(spark.createDataFrame([observation("p1", 9, name="newer"), observation("q", 9)], OBSERVATION))
    got = by_id(store.places())
    assert (got["p1"].name, got["p0"].name, len(got)) == ("newer", "new", 5001)
    assert got["p4"].name == by_id(spark.createDataFrame([("p4",)], "place_id string").select("place_id", F.sha2("place_id", 256).alias("name")))["p4"].name
    assert store.compact() == 2 and store.count() == 5001


def test_compaction_stopped_half_way_and_half_written_batches(spark, tmp_path):
    path = tmp_path / "places"
    store = PlaceStore(spark, str(path))
    store.upsert(spark.createDataFrame(ROWS[:2], OBSERVATION), "a")
    store.upsert(spark.createDataFrame(ROWS[2:], OBSERVATION), "b")
    kept = {n: {f: (path / n / f).read_bytes() for f in os.listdir(path / n)} for n in ("batch=a", "batch=b")}
    want = sorted(map(repr, store.places().collect()))
    store.compact()
    for name, files in kept.items():  # as if it had ended before it removed them
        (path / name).mkdir()
        for file, content in files.items():
            (path / name / file).write_bytes(content)
    assert sorted(map(repr, store.places().collect())) == want
    store.compact()
    assert sorted(map(repr, store.places().collect())) == want
    # A folder without its end mark is not read, and its batch is written anew.
    (path / "batch=c").mkdir()
    (path / "batch=c" / "part-0.parquet").write_bytes(kept["batch=a"][next(f for f in kept["batch=a"] if f.endswith(".parquet") and not f.startswith("."))])
    assert sorted(map(repr, store.places().collect())) == want
    assert store.upsert(spark.createDataFrame([observation("c", 9, name="C")], OBSERVATION), "c")
    assert by_id(store.places())["c"].name == "C" and store.count() == 3


def test_a_pruned_store_loses_content_for_good_when_compacted(spark, tmp_path):
    store = PlaceStore(spark, str(tmp_path / "places"))
    store.upsert(spark.createDataFrame(ROWS[:4], OBSERVATION))
    store.prune(NOW + timedelta(hours=3, minutes=30))
    store.compact()
    stored = spark.read.parquet(str(tmp_path / "places" / "batch=*")).where("place_id = 'a'")
    assert stored.count() == 1 and stored.first()["name"] is None


def test_pruned_log_does_not_bring_content_back(spark):
    log = fold.prune_log(spark.createDataFrame(ROWS[:4], OBSERVATION), NOW + timedelta(hours=3.5))
    got = by_id(fold.places_of(fold.fold_observations(log)))
    assert got["a"].name is None and got["a"].rating is None and got["b"].name == "B"
    assert got["a"].first_seen_at == NOW + timedelta(hours=1)
    assert got["a"].last_seen_at == NOW + timedelta(hours=3)


def test_stale_is_strict_and_null_is_never_stale(spark):
    cutoff = filters.stale_cutoff(NOW, 30)
    rows = [(cutoff,), (cutoff - timedelta(seconds=1),), (None,)]
    df = spark.createDataFrame(rows, "t timestamp")
    assert [r[0] for r in df.select(filters.is_stale(F.col("t"), cutoff)).collect()] == [
        False, True, False]


def test_name_order_and_numbering(spark):
    rows = [("1", "b"), ("2", "A"), ("3", None), ("4", "a"), ("5", "É"), ("6", "é"), ("7", "B")]
    df = spark.createDataFrame(rows, "place_id string, name string").repartition(3)
    numbered = number_rows(df, report.name_order()).orderBy("row_no").collect()
    assert [r.row_no for r in numbered] == list(range(7))
    assert [r.place_id for r in numbered] == ["3", "2", "4", "1", "7", "5", "6"]
    assert {r.place_id for r in first_rows(df, report.name_order(), 2).collect()} == {"3", "2"}


def test_first_rows_by_heap_by_cut_and_by_partition(spark, monkeypatch):
    names = F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.concat(F.chr(F.col("id") * 7 % 26 + 65), F.col("id").cast("string")))
    df = spark.range(30_000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("place_id"), names.alias("name")).repartition(6)
    fold_name = lambda r: (r.name is not None, (r.name or "").lower(), r.place_id)
    want = [r.place_id for r in sorted(df.collect(), key=fold_name)]
    monkeypatch.setattr(numbering, "SAMPLE_KEYS", 2000)
    seen = []
    monkeypatch.setattr(numbering, "number_rows", lambda rows, *a: seen.append(rows.count()) or number_rows(rows, *a))
    for n, keys in ((500, None), (2500, report.name_keys()), (2500, None), (29_999, report.name_keys())):
        got = first_rows(df, report.name_order(), n, keys)
        assert {r.place_id for r in got.collect()} == set(want[:n])
    assert seen[0] < 5000 and seen[1] == 15_000 and seen[2] == 30_000
    assert first_rows(df, report.name_order(), 0).count() == 0
    plan = first_rows(df, report.name_order(), 500)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_scratch_of_the_application_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_root", lambda _: str(tmp_path))
    assert session.materialize(spark.range(5), "five").count() == 5
    assert session.list_folders(spark, f"{tmp_path}/placeloom") == [spark.sparkContext.applicationId]
    session.clear_scratch(spark)
    session.clear_scratch(spark)
    assert session.list_folders(spark, f"{tmp_path}/placeloom") == []
    assert session.list_folders(spark, f"{tmp_path}/nothing") == []


def test_scratch_without_a_setting(spark, monkeypatch):
    monkeypatch.setattr(session, "_CHECKPOINT_KEY", "placeloom.unset.key")
    folder = session.shared_root(spark)
    assert folder == session.shared_root(spark) and os.path.isdir(folder)
    spark.conf.unset(session._LOCAL_KEY)


def test_summaries_of_nothing(spark):
    empty = PlaceStore(spark, "/tmp/placeloom-no-such-store").places()
    assert report.dataset_summary(empty).first().asDict() == {
        "total": 0, "rated": 0, "mean_rating": 0.0, "synced": 0}
    cells = report.cell_summary(spark.createDataFrame([], CELL_LOG)).first()
    assert (cells.cells, cells.saturated, cells.max_depth) == (0, 0, 0)


def test_cell_log_appends_and_resets(spark, tmp_path):
    log = CellLog(spark, str(tmp_path / "log"))
    row = ("restaurant", 40.0, 49.0, 500.0, 0, 20, True, True, NOW)
    assert log.rows().count() == 0
    log.append(spark.createDataFrame([row], CELL_LOG))
    log.append(spark.createDataFrame([(*row[:5], 3, False, False, NOW + timedelta(1))], CELL_LOG))
    assert log.rows().count() == 2 and log.latest().count() == 1
    assert log.cells().first().saturated is False
    # Of rows searched at the same time the one appended last counts.
    for count in (11, 2, 12):
        log.append(spark.createDataFrame([(*row[:5], count, False, False, NOW + timedelta(2))], CELL_LOG))
        assert log.latest().first().result_count == count
    log.reset()
    assert CellLog(spark, str(tmp_path / "log")).rows().count() == 0


def test_exports_and_sources(spark, tmp_path):
    rows = [
        observation("x", 1, name='Say "hi"', formatted_address="a, b\nc", takeout=True,
                    phone="123", phone_international="", latitude=59.4, longitude=24.7),
        observation("y", 2, name="Äö", phone="1", phone_international="+372 5"),
    ]
    places = fold.places_of(fold.fold_observations(spark.createDataFrame(rows, OBSERVATION)))
    assert files.export_csv(places, str(tmp_path / "csv")) == 2
    parts = sorted(p for p in os.listdir(tmp_path / "csv") if p.endswith(".csv"))
    header = open(tmp_path / "csv" / parts[0], encoding="utf-8").readline().strip()
    assert header == ",".join(fixed.PLACE_COLUMNS)
    records = {r.place_id: r for r in files.collected_csv(spark, str(tmp_path / "csv")).collect()}
    assert (records["x"].name, records["x"].address) == ('Say "hi"', "a, b\nc")
    assert (records["x"].phone, records["y"].phone) == ("123", "+372 5")
    assert records["x"].lat == "59.4" and records["y"].lat is None
    assert files.export_json(places, str(tmp_path / "json")) == 2
    lines = spark.read.text(str(tmp_path / "json")).collect()
    got = {json.loads(r.value)["place_id"]: json.loads(r.value) for r in lines}
    assert list(got["x"]) == fixed.PLACE_COLUMNS and got["y"]["takeout"] is None
    assert got["x"]["takeout"] == 1 and got["y"]["name"] == "Äö"
    assert any("Äö" in r.value for r in lines)
    curated = tmp_path / "curated.json"
    curated.write_text(json.dumps([{"name": "A", "lat": 59.4, "closed": True}, {"name": "B"}]))
    read = files.curated_json(spark, str(curated)).orderBy("name").collect()
    assert (read[0].closed, read[0].lat, read[1].lat) == ("true", "59.4", None)
    assert len({r.target_id for r in read}) == 2


def test_stream_equals_batch_even_when_replayed(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    lines = [
        {"seen_at": "2024-05-02T00:00:00Z", "ingest_seq": 9, "payload": json.dumps(RICH)},
        {"seen_at": "2024-05-01T00:00:00Z", "ingest_seq": 3,
         "payload": json.dumps({"id": "r1", "displayName": "late", "websiteUri": "w"})},
        {"seen_at": "2024-05-03T00:00:00Z", "ingest_seq": 11, "payload": json.dumps({"id": "z"})},
    ]
    for k, line in enumerate(lines):
        (landing / f"{k}.json").write_text(json.dumps(line) + "\n")
    batch = normalize.normalize_payload(spark.read.schema(LANDED).json(str(landing)))
    want = sorted(map(repr, fold.places_of(fold.fold_observations(batch)).collect()))
    store = PlaceStore(spark, str(tmp_path / "store"), buckets=2)
    for checkpoint in ("c1", "c2"):
        stream = stream_payloads(spark, str(landing), files_per_batch=1)
        start_upsert(stream, store, str(tmp_path / checkpoint)).awaitTermination()
        assert sorted(map(repr, store.places().collect())) == want
    got = by_id(store.places())["r1"]
    assert (got.name, got.website) == ("Kohvik Põhjala", "w")
    # Another checkpoint is another stream; the same one, run again, adds no batch.
    before = store.table.names()
    assert len(before) == 6
    start_upsert(stream_payloads(spark, str(landing), files_per_batch=1), store, str(tmp_path / "c2")).awaitTermination()
    assert store.table.names() == before
    last = spark.read.schema("id string").json(str(tmp_path / "c2" / "metadata")).first().id
    assert not store.upsert(batch, f"{last}-2") and store.table.names() == before
