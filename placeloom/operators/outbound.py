"""Mapping places to target records and delivering them in keyed batches."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom import fixed
from placeloom.functions.text import strip
from placeloom.operators.filters import unsynced
from placeloom.operators.numbering import first_rows, number_rows
from placeloom.operators.report import name_keys, name_order
from placeloom.session import materialize

_NOT_FIELDS = {"source_place_id", "source_name", "row_no", "batch_id", "pos"}
RESULTS = "batch_id bigint, pos bigint, success boolean, created boolean, id string, errors string"


def field_map_for(object_name: str) -> dict[str, str]:
    return fixed.FIELD_MAPS.get(object_name, fixed.RESTAURANT_FIELDS)


def _field(places: DataFrame, column: str, target: str) -> Column:
    value = F.col(column)
    if column in fixed.FLAG_COLUMNS:
        return value.cast("boolean")
    if isinstance(places.schema[column].dataType, T.StringType):
        text = strip(value)
        limit = fixed.FIELD_MAX_LENGTH.get(target)
        if limit:
            text = F.left(text, F.lit(limit))
        return F.nullif(text, F.lit(""))
    if target in fixed.FIELD_DECIMALS:
        return value.cast(T.DecimalType(*fixed.FIELD_DECIMALS[target]))
    return value


def build_records(
    places: DataFrame,
    field_map: dict[str, str],
    stamped_at: datetime | None = None,
    typed: bool = False,
) -> DataFrame:
    """One target record per place, plus its source id and name.

    Text is stripped, emptied to NULL and cut to the field's length; flags stay
    three-valued.  ``typed`` casts numbers to the target's declared decimals.
    NULL fields are omitted when the record is rendered with ``payload``.
    """
    columns = {
        target: _field(places, column, target)
        for column, target in field_map.items()
        if column in places.columns
    }
    if not typed:
        for column, target in field_map.items():
            if target in fixed.FIELD_DECIMALS and target in columns:
                columns[target] = F.col(column)
    if stamped_at is not None and fixed.SYNC_STAMP_FIELD not in columns:
        columns[fixed.SYNC_STAMP_FIELD] = F.date_format(
            F.lit(stamped_at).cast("timestamp"), fixed.SYNC_STAMP_FORMAT
        )
    return places.select(
        F.col("place_id").alias("source_place_id"),
        F.col("name").alias("source_name"),
        *[value.alias(target) for target, value in columns.items()],
    )


def payload(records: DataFrame) -> DataFrame:
    """The record as JSON text with NULL fields left out."""
    fields = [c for c in records.columns if c not in _NOT_FIELDS]
    return records.withColumn("payload", F.to_json(F.struct(*fields)))


def outbound_records(
    places: DataFrame,
    object_name: str = "Restaurant__c",
    external_id: str = fixed.EXTERNAL_ID_FIELD,
    field_map: dict[str, str] | None = None,
    only_unsynced: bool = False,
    limit: int | None = None,
    stamped_at: datetime | None = None,
) -> DataFrame:
    """Records to deliver: filter, limit in name order, map, drop keyless."""
    mapping = field_map or field_map_for(object_name)
    if external_id not in mapping.values():
        raise ValueError(f"external id field {external_id!r} is not in the field map")
    chosen = unsynced(places) if only_unsynced else places
    if limit:
        chosen = first_rows(chosen, name_order(), limit, name_keys())
    stamp = stamped_at if object_name.endswith(fixed.CUSTOM_OBJECT_SUFFIX) else None
    records = build_records(chosen, mapping, stamp)
    return records.where(F.col(external_id).isNotNull())


def number_batches(records: DataFrame, batch_size: int = fixed.DEFAULT_BATCH_SIZE) -> DataFrame:
    """Batches in source-name order: ``batch_id``, and ``pos`` inside the batch."""
    order = name_order("source_name", "source_place_id")
    return number_rows(records, order).withColumns(
        {
            "batch_id": F.floor(F.col("row_no") / batch_size).cast("bigint"),
            "pos": F.pmod(F.col("row_no"), F.lit(batch_size)).cast("bigint"),
        }
    )


def deliver(batches: DataFrame, send: Callable[[list[str]], list[dict]]) -> DataFrame:
    """Hand every batch to ``send`` on the executors; one result per record.

    A batch is bounded by the batch size, so a group never grows with the data.
    ``send`` gets the payloads in order and answers in the same order; a record
    that it gives no answer for counts as failed.  Tasks can
    be retried, so it must be idempotent on the external id.  Results are
    written out at once, so nothing is sent again by a later recomputation.
    """

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("pos")
        answers = list(send(list(batch["payload"])))
        answers += [{"errors": "no answer"}] * (len(batch) - len(answers))
        rows = [
            {
                "batch_id": batch_id,
                "pos": pos,
                "success": bool(a.get("success")),
                "created": bool(a.get("created")),
                "id": a.get("id"),
                "errors": str(a["errors"]) if a.get("errors") else None,
            }
            for batch_id, pos, a in zip(batch["batch_id"], batch["pos"], answers)
        ]
        return pd.DataFrame(
            rows, columns=["batch_id", "pos", "success", "created", "id", "errors"]
        )

    answers = batches.select("batch_id", "pos", "payload").groupBy("batch_id").applyInPandas(
        run, RESULTS
    )
    return materialize(answers, "delivered")


def match_results(batches: DataFrame, results: DataFrame) -> DataFrame:
    """The i-th answer of a batch belongs to its i-th record."""
    return batches.select(
        "batch_id", "pos", F.col("source_place_id").alias("place_id")
    ).join(results, ["batch_id", "pos"])


def sync_summary(records: DataFrame, matched: DataFrame) -> DataFrame:
    """Records considered, delivered, created, failed."""
    ok = F.col("success")
    total = records.agg(F.count("*")).scalar()
    return matched.agg(
        F.count_if(ok).alias("success"),
        F.count_if(ok & F.col("created")).alias("created"),
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed"),
    ).withColumn("total", total)


def delivered_ids(matched: DataFrame) -> DataFrame:
    return matched.where("success").select("place_id", "id")


def upsert_target(target: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Keyed upsert into a target table: given fields win, omitted ones stay.

    Records that share a key are one: of each field the largest value given counts.
    Returns the target's columns plus ``change`` (created, updated, kept).
    """
    fields = [c for c in target.columns if c != key]
    old = target.select(key, *[F.col(c).alias(f"_old_{c}") for c in fields], F.lit(1).alias("_o"))
    new = records.groupBy(key).agg(*[F.max(c).alias(f"_new_{c}") for c in fields], F.lit(1).alias("_n"))
    joined = old.join(new, key, "full")
    change = (
        F.when(F.col("_o").isNull(), "created")
        .when(F.col("_n").isNotNull(), "updated")
        .otherwise("kept")
    )
    return joined.select(
        key,
        *[F.coalesce(F.col(f"_new_{c}"), F.col(f"_old_{c}")).alias(c) for c in fields],
        change.alias("change"),
    )
