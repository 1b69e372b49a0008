"""Continuous upsert of landed observations into a place store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from placeloom.operators.normalize import normalize_payload
from placeloom.sources.tables import PlaceStore

# A landed line: when a payload was collected, its sequence number, the payload.
LANDED = "seen_at timestamp, ingest_seq bigint, payload string"


def stream_payloads(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Observations from JSON Lines files as they land in ``path``."""
    landed = (
        spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_batch).json(path)
    )
    return normalize_payload(landed)


def checkpoint_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream writes into its checkpoint when it is first started."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first().id


def start_upsert(
    observations: DataFrame, store: PlaceStore, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Fold every micro-batch into the store.

    The store is the only state, so no watermark is needed: a late row loses to
    newer values by its (seen_at, ingest_seq).  A micro-batch is added under the
    checkpoint's own id and its number, so one replayed after a failure adds nothing.
    """

    def fold_batch(batch: DataFrame, batch_id: int) -> None:
        store.upsert(batch, f"{checkpoint_id(batch.sparkSession, checkpoint)}-{batch_id}")

    writer = observations.writeStream.foreachBatch(fold_batch).option(
        "checkpointLocation", checkpoint
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
