"""Reading landed responses, collected exports and curated lists; exporting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from placeloom import fixed
from placeloom.operators.normalize import flat_view
from placeloom.operators.numbering import number_rows
from placeloom.operators.report import name_order
from placeloom.schemas import CURATED
from placeloom.session import materialize


def explode_response(responses: DataFrame, response: str = "response") -> DataFrame:
    """One row per place of each response; a response without places gives none."""
    doc = F.try_parse_json(F.col(response))
    places = F.try_variant_get(doc, "$.places", "array<variant>")
    kept = [c for c in responses.columns if c != response]
    exploded = responses.select(*kept, F.posexplode(places).alias("response_pos", "_place"))
    return exploded.withColumn("payload", F.to_json(F.col("_place"))).drop("_place")


def landed_payloads(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Place payloads from files of JSON responses (one per line, or per file)."""
    text = spark.read.text(path, wholetext=one_per_file)
    return explode_response(text.withColumnRenamed("value", "response"))


def collected_csv(spark: SparkSession, path: str) -> DataFrame:
    """An exported CSV as linkage records, in name order (``record_pos``)."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return collected_records(rows)


def collected_records(places: DataFrame) -> DataFrame:
    """Place rows as linkage records; the international number comes first."""
    records = places.select(
        "place_id",
        "name",
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lng"),
        F.coalesce(
            F.nullif(F.col("phone_international"), F.lit("")), F.col("phone")
        ).alias("phone"),
        F.col("formatted_address").alias("address"),
    )
    return number_rows(records, name_order(), "record_pos")


def curated_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A curated list (JSON array, or JSON Lines for large ones).

    Rows without ``target_id`` are numbered; the numbers are written out once
    so that they stay the same for every later step.
    """
    rows = spark.read.schema(CURATED).json(path, multiLine=not lines)
    given = F.coalesce(F.col("target_id"), F.monotonically_increasing_id().cast("string"))
    return materialize(rows.withColumn("target_id", given), "curated")


def export_rows(places: DataFrame) -> DataFrame:
    """The export columns in order, flags as 0/1."""
    return flat_view(places.select(*fixed.PLACE_COLUMNS))


def _write_ordered(places: DataFrame, write) -> int:
    seen = Observation()
    # Counted above the sort: what lies below is also read to sample its ranges.
    ordered = export_rows(places).orderBy(*name_order())
    write(ordered.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite"))
    return seen.get["n"]


def export_csv(places: DataFrame, path: str) -> int:
    """Sharded CSV in name order, header in every shard; returns the row count."""
    options = {"quote": '"', "escape": '"', "nullValue": "", "emptyValue": ""}
    # The writer trims values unless told otherwise.
    exact = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    return _write_ordered(places, lambda w: w.csv(path, header=True, **options, **exact))


def export_json(places: DataFrame, path: str) -> int:
    """Sharded JSON Lines in name order, NULLs written out; returns the row count."""
    return _write_ordered(places, lambda w: w.json(path, ignoreNullFields=False))
