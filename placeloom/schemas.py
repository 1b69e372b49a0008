"""Declared schemas; nothing in the package infers one on read."""

from pyspark.sql import types as T

from placeloom import fixed


def place_type(column: str) -> T.DataType:
    if column in fixed.DOUBLE_COLUMNS:
        return T.DoubleType()
    if column in fixed.BIGINT_COLUMNS:
        return T.LongType()
    if column in fixed.INT_COLUMNS:
        return T.IntegerType()
    if column in fixed.FLAG_COLUMNS:
        return T.BooleanType()
    return T.StringType()


PLACE = T.StructType([T.StructField(c, place_type(c)) for c in fixed.PLACE_COLUMNS])

# Content columns: everything an observation can carry about a place.
CONTENT_COLUMNS = [c for c in fixed.PLACE_COLUMNS if c != "place_id"] + ["raw_json"]

OBSERVATION = T.StructType(
    PLACE.fields
    + [
        T.StructField("raw_json", T.StringType()),
        T.StructField("seen_at", T.TimestampType()),
        T.StructField("ingest_seq", T.LongType()),
    ]
)

SNAPSHOT = T.StructType(
    PLACE.fields
    + [
        T.StructField("raw_json", T.StringType()),
        T.StructField("first_seen_at", T.TimestampType()),
        T.StructField("last_seen_at", T.TimestampType()),
        T.StructField("salesforce_id", T.StringType()),
        T.StructField("salesforce_synced_at", T.TimestampType()),
    ]
)

CELL_LOG = T.StructType(
    [
        T.StructField("scope", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lng", T.DoubleType()),
        T.StructField("radius_m", T.DoubleType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("result_count", T.LongType()),
        T.StructField("saturated", T.BooleanType()),
        T.StructField("split", T.BooleanType()),
        T.StructField("searched_at", T.TimestampType()),
    ]
)

# The stored log also tells which append a row came with.
NUMBERED_LOG = T.StructType([*CELL_LOG.fields, T.StructField("run_seq", T.LongType())])

CURATED = T.StructType(
    [
        T.StructField("target_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("lat", T.StringType()),
        T.StructField("lng", T.StringType()),
        T.StructField("phone", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("closed", T.StringType()),
        T.StructField("place_id", T.StringType()),
    ]
)
