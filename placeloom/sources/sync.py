"""The outbound job: choose places, map, batch, deliver, match, mark, summarise."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom import fixed
from placeloom.operators import outbound
from placeloom.operators.filters import select_places
from placeloom.session import materialize
from placeloom.sources.tables import PlaceStore, TargetTable


@dataclass
class SyncResult:
    """Counts of the job; in a dry run the first record, else what was delivered."""

    summary: dict[str, int]
    first_record: str | None = None
    matched: DataFrame | None = None


def send_with(send: Callable[[list[str]], list[dict]]) -> Callable[[DataFrame], DataFrame]:
    """A delivery that hands each batch to ``send`` on the executors."""
    return lambda batches: outbound.deliver(batches, send)


def send_to(table: TargetTable) -> Callable[[DataFrame], DataFrame]:
    """A delivery into a keyed table: the answer tells whether the key was new."""

    def deliver(batches: DataFrame) -> DataFrame:
        key = table.key
        there = table.read().select(key, F.lit(True).alias("_there"))
        answers = batches.join(there, key, "left").select(
            "batch_id",
            "pos",
            F.lit(True).alias("success"),
            F.col("_there").isNull().alias("created"),
            F.col(key).alias("id"),
            F.lit(None).cast("string").alias("errors"),
        )
        answers = materialize(answers, "delivered")  # before the table changes
        table.upsert(batches.select(*table.schema.fieldNames()))
        return answers

    return deliver


def sync_places(
    places: DataFrame,
    deliver: Callable[[DataFrame], DataFrame],
    where: str = "",
    include_all: bool = True,
    batch_size: int = fixed.DEFAULT_BATCH_SIZE,
    dry_run: bool = False,
    **options,
) -> SyncResult:
    """Deliver chosen places; ``options`` are those of ``outbound_records``.

    A dry run delivers nothing and shows the first record instead.
    """
    records = outbound.outbound_records(select_places(places, where, include_all), **options)
    batches = outbound.payload(outbound.number_batches(records, batch_size))
    if dry_run:
        first = batches.where("batch_id = 0 and pos = 0").select("payload").first()
        empty = {"success": 0, "created": 0, "failed": 0, "total": batches.count()}
        return SyncResult(empty, first and first.payload)
    matched = materialize(outbound.match_results(batches, deliver(batches)), "matched")
    return SyncResult(outbound.sync_summary(batches, matched).first().asDict(), matched=matched)


def sync_store(store: PlaceStore, deliver, synced_at: datetime, **options) -> SyncResult:
    """Sync the places of a store and mark those delivered."""
    result = sync_places(store.places(), deliver, stamped_at=synced_at, **options)
    if result.matched is not None:
        store.mark_synced(outbound.delivered_ids(result.matched), synced_at)
    return result
