"""Folding observations into places without losing known values.

The state of a place keeps, for each content column, the newest non-NULL value
together with when it was seen: ``struct<seen_at, ingest_seq, value>``.  Merging
two states is ``max`` per column, so the fold is associative, commutative and
idempotent: partial aggregation applies (one hot place is reduced inside every
task before the shuffle), late rows cannot overwrite newer ones, and replaying
a batch changes nothing.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom import fixed
from placeloom.operators.filters import has_key, is_stale
from placeloom.schemas import CONTENT_COLUMNS, place_type


def _stamped(name: str) -> Column:
    value = F.col(name)
    stamp = F.struct(
        F.col("seen_at").alias("seen_at"),
        F.col("ingest_seq").alias("ingest_seq"),
        value.alias("value"),
    )
    return F.when(value.isNotNull(), stamp)


def content_of(df: DataFrame) -> list[str]:
    """Content columns present in ``df``; partial tables fold like full ones."""
    return [c for c in CONTENT_COLUMNS if c in df.columns]


def lift(observations: DataFrame) -> DataFrame:
    """Observations (place_id, content.., seen_at, ingest_seq) as one-row states."""
    content = content_of(observations)
    return observations.where(has_key(F.col("place_id"))).select(
        "place_id",
        *[_stamped(c).alias(c) for c in content],
        F.col("seen_at").alias("first_seen_at"),
        F.col("seen_at").alias("last_seen_at"),
        F.lit(None).cast("string").alias("salesforce_id"),
        F.lit(None).cast("timestamp").alias("salesforce_synced_at"),
        F.lit(None).cast("timestamp").alias("pruned_before"),
    )


def fold_state(states: DataFrame) -> DataFrame:
    """Merge states (lifted observations and/or earlier states) per place.

    Content seen before the time up to which a place was pruned stays away, so
    folding an old observation again does not bring it back.
    """
    content = content_of(states)
    linked = F.col("salesforce_id").isNotNull()
    newest_link = F.max(
        F.when(linked, F.struct("salesforce_synced_at", "salesforce_id"))
    )
    return states.groupBy("place_id").agg(
        *[F.max(c).alias(c) for c in content],
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
        newest_link["salesforce_id"].alias("salesforce_id"),
        F.max("salesforce_synced_at").alias("salesforce_synced_at"),
        F.max("pruned_before").alias("pruned_before"),
    ).withColumns(
        {c: F.when(F.coalesce(F.col(c)["seen_at"] >= F.col("pruned_before"), F.lit(True)), F.col(c)) for c in content}
    )


def places_of(state: DataFrame) -> DataFrame:
    """The places table: each column's newest known value."""
    content = content_of(state)
    return state.select(
        "place_id",
        *[F.col(c)["value"].alias(c) for c in content],
        "first_seen_at",
        "last_seen_at",
        "salesforce_id",
        "salesforce_synced_at",
    )


def fold_observations(observations: DataFrame) -> DataFrame:
    return fold_state(lift(observations))


def upsert(state: DataFrame, observations: DataFrame) -> DataFrame:
    """State after the observations; columns absent on one side stay NULL."""
    return fold_state(state.unionByName(lift(observations), allowMissingColumns=True))


def new_places(state: DataFrame, observations: DataFrame) -> DataFrame:
    """Ids the state does not hold yet."""
    ids = observations.where(has_key(F.col("place_id"))).select("place_id").distinct()
    return ids.join(state.select("place_id"), "place_id", "left_anti")


def state_schema(content: list[str] | None = None) -> T.StructType:
    def stamped(kind: T.DataType) -> T.StructType:
        return T.StructType(
            [
                T.StructField("seen_at", T.TimestampType()),
                T.StructField("ingest_seq", T.LongType()),
                T.StructField("value", kind),
            ]
        )

    names = CONTENT_COLUMNS if content is None else content
    return T.StructType(
        [T.StructField("place_id", T.StringType())]
        + [T.StructField(c, stamped(place_type(c))) for c in names]
        + [
            T.StructField("first_seen_at", T.TimestampType()),
            T.StructField("last_seen_at", T.TimestampType()),
            T.StructField("salesforce_id", T.StringType()),
            T.StructField("salesforce_synced_at", T.TimestampType()),
            T.StructField("pruned_before", T.TimestampType()),
        ]
    )


def prune_stale(df: DataFrame, cutoff: datetime) -> DataFrame:
    """Blank all content of stale places; works on states and on place tables.

    The id, the seen times and the downstream link stay.  A state also keeps the
    time it was pruned up to.
    """
    stale = is_stale(F.col("last_seen_at"), cutoff)
    blank = {c: F.when(~stale, F.col(c)) for c in content_of(df)}
    if "pruned_before" in df.columns:
        pruned = F.greatest("pruned_before", F.lit(cutoff).cast("timestamp"))
        blank["pruned_before"] = F.when(stale, pruned).otherwise(F.col("pruned_before"))
    return df.withColumns(blank)


def count_stale(df: DataFrame, cutoff: datetime) -> DataFrame:
    """How many rows a prune affects; already blank rows count again."""
    return df.agg(
        F.count_if(is_stale(F.col("last_seen_at"), cutoff)).alias("n_pruned")
    )


def prune_log(observations: DataFrame, cutoff: datetime) -> DataFrame:
    """Drop pruned content from an observation log, so no re-fold brings it back.

    Staleness belongs to the place, not to the observation: a place seen after
    the cutoff keeps all its observations, one that was not keeps two rows
    without content (its first and last sighting).
    """
    content = content_of(observations)
    last = observations.groupBy("place_id").agg(F.max("seen_at").alias("_last"))
    marked = observations.join(last, "place_id")
    stale = is_stale(F.col("_last"), cutoff)
    fresh = marked.where(~stale).drop("_last")
    ends = (
        observations.groupBy("place_id")
        .agg(
            F.min(F.struct("seen_at", "ingest_seq")).alias("first"),
            F.max(F.struct("seen_at", "ingest_seq")).alias("last"),
        )
        .where(is_stale(F.col("last.seen_at"), cutoff))
        .select("place_id", F.explode(F.array_distinct(F.array("first", "last"))).alias("s"))
        .select("place_id", "s.seen_at", "s.ingest_seq")
    )
    blanks = {c: F.lit(None).cast(observations.schema[c].dataType) for c in content}
    return fresh.unionByName(ends.withColumns(blanks).select(*fresh.columns))


def mark_synced(df: DataFrame, results: DataFrame, synced_at: datetime) -> DataFrame:
    """Record successful deliveries: (place_id, id) rows, id may be NULL."""
    delivered = results.groupBy("place_id").agg(
        F.max("id").alias("_id"), F.lit(True).alias("_done")
    )
    joined = df.join(delivered, "place_id", "left")
    return joined.withColumns(
        {
            "salesforce_id": F.coalesce(F.col("_id"), F.col("salesforce_id")),
            "salesforce_synced_at": F.when(
                F.col("_done"), F.lit(synced_at).cast("timestamp")
            ).otherwise(F.col("salesforce_synced_at")),
        }
    ).drop("_id", "_done")
