"""Ordering and summaries of a place table and of a cell log."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeloom import fixed


def name_key(name: Column) -> Column:
    """Case-insensitive for ASCII letters only; other characters keep their order."""
    return F.translate(name, string.ascii_uppercase, string.ascii_lowercase)


def name_keys(name: str = "name", key: str = "place_id") -> list[Column]:
    """What ``name_order`` sorts by."""
    return [name_key(F.col(name)), F.col(key)]


def name_order(name: str = "name", key: str = "place_id") -> list[Column]:
    """By name, NULL first; ties by key, so the order is total."""
    return [name_key(F.col(name)).asc_nulls_first(), F.col(key).asc()]


def dataset_summary(places: DataFrame) -> DataFrame:
    """Total, rated, mean rating (0 when none) and synced, in one pass."""
    return places.agg(
        F.count("*").alias("total"),
        F.count("rating").alias("rated"),
        F.coalesce(F.avg("rating"), F.lit(0.0)).alias("mean_rating"),
        F.count("salesforce_synced_at").alias("synced"),
    )


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))


def _city() -> Column:
    return F.coalesce(F.nullif(F.col("city"), F.lit("")), F.lit(fixed.UNKNOWN_CITY))


def city_counts(places: DataFrame) -> DataFrame:
    return places.groupBy(_city().alias("city")).agg(F.count("*").alias("n_places"))


def top_cities(places: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent cities; ties in order of their first place by name."""
    first = F.struct(
        name_key(F.col("name")).isNotNull().alias("named"),
        name_key(F.col("name")).alias("key"),
        F.col("place_id"),
    )
    counted = places.groupBy(_city().alias("city")).agg(
        F.count("*").alias("n_places"), F.min(first).alias("_first")
    )
    return counted.orderBy(F.desc("n_places"), F.asc("_first")).limit(n).drop("_first")


def cell_summary(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count("*").alias("cells"),
        F.coalesce(F.sum(F.col("saturated").cast("int")), F.lit(0)).alias("saturated"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
    )


def recall_cost(found: DataFrame, calls: DataFrame, truth: DataFrame) -> DataFrame:
    """Per setting and run: calls, calls so far, rows stored, recall of the truth.

    ``found``: (setting, run_id, place_id) kept in that run; ``calls``:
    (setting, run_id, calls); ``truth``: (place_id).  A place counts in the
    first run that found it.  The running sums go over one row per run.
    """
    first = found.groupBy("setting", "place_id").agg(F.min("run_id").alias("run_id"))
    first = first.join(truth.select("place_id", F.lit(1).alias("_true")), "place_id", "left")
    per_run = first.groupBy("setting", "run_id").agg(
        F.count("*").alias("_rows"), F.count("_true").alias("_hits")
    )
    running = (
        Window.partitionBy("setting")
        .orderBy("run_id")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    so_far = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).over(running).cast("bigint")
    rows = calls.join(per_run, ["setting", "run_id"], "left").select(
        "setting",
        "run_id",
        "calls",
        so_far("calls").alias("cumulative_calls"),
        so_far("_rows").alias("rows_stored"),
        so_far("_hits").alias("true_found"),
    )
    n_truth = truth.agg(F.count("*")).scalar()
    rows = rows.withColumn("n_truth", n_truth)
    recall = F.when(F.col("n_truth") > 0, F.col("true_found") / F.col("n_truth")).otherwise(0.0)
    return rows.withColumn("recall", recall).drop("n_truth")
