"""Row filters: place kind, review bar, user predicates, closed, stale."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom import fixed
from placeloom.functions.text import strip


def is_restaurant(primary_type: Column) -> Column:
    """Everything but the deny list; NULL and unknown kinds count as restaurants."""
    denied = primary_type.isin(*fixed.NON_RESTAURANT_TYPES)
    return ~F.coalesce(denied, F.lit(False))


def wanted_kind(primary_type: Column, included: list[str] | None = None) -> Column:
    """Restaurant, or a kind the caller asked for by name."""
    if not included:
        return is_restaurant(primary_type)
    asked_for = F.coalesce(primary_type.isin(*included), F.lit(False))
    return asked_for | is_restaurant(primary_type)


def below_bar(review_count: Column, min_reviews: int) -> Column:
    if not min_reviews:
        return F.lit(False)
    return F.coalesce(review_count, F.lit(0)) < min_reviews


def has_any_type(types: Column, included: list[str]) -> Column:
    """The place's comma list of types contains any requested type."""
    listed = F.split(F.coalesce(types, F.lit("")), ",")
    return F.arrays_overlap(listed, F.array(*[F.lit(t) for t in included]))


def has_key(key: Column) -> Column:
    return F.nullif(key, F.lit("")).isNotNull()


def is_closed(closed: Column) -> Column:
    """True, a number other than zero, or one of the accepted words when it is text."""
    kind = F.typeof(closed)
    numeric = kind.isin("tinyint", "smallint", "int", "bigint", "float", "double") | kind.startswith("decimal")
    word = F.lower(strip(closed.cast("string")))
    closed_by_number = closed.cast("string").try_cast("double") != 0
    return F.coalesce(F.when(numeric, closed_by_number).otherwise(word.isin(*fixed.CLOSED_WORDS)), F.lit(False))


def unsynced(places: DataFrame) -> DataFrame:
    return places.where(F.col("salesforce_synced_at").isNull())


def stale_cutoff(as_of: datetime, older_than_days: int = fixed.DEFAULT_PRUNE_DAYS) -> datetime:
    return as_of - timedelta(days=older_than_days)


def is_stale(last_seen_at: Column, cutoff: datetime) -> Column:
    """Strictly before the cutoff; a missing time is never stale."""
    return F.coalesce(last_seen_at < F.lit(cutoff), F.lit(False))


def select_places(flat: DataFrame, where: str = "", include_all: bool = True) -> DataFrame:
    """User predicate (SQL text over the stored shape) and the kind filter."""
    chosen = flat.where(where) if where else flat
    return chosen if include_all else chosen.where(is_restaurant(F.col("primary_type")))
