"""Global row numbers without a single-partition window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.session import materialize, materialize_with, shuffle_width

_IN_PARTITION = (1 << 33) - 1


def number_rows(df: DataFrame, order: list[Column], out: str = "row_no") -> DataFrame:
    """Number all rows 0.. in ``order`` (which must be total).

    Rows are range partitioned and sorted, each partition numbers its own rows,
    and the partitions' starting offsets (one number per partition) are added.
    The sorted rows are written once, so both passes see the same partitions.
    """
    spark = df.sparkSession
    ranged = (
        df.repartitionByRange(shuffle_width(spark), *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(_IN_PARTITION))
    )
    ranged = materialize(ranged, "numbered")
    # At most one row per shuffle partition comes to the driver.
    sizes = {r._part: r.n for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(sizes):
        starts.append((part, total))
        total += sizes[part]
    offsets = spark.createDataFrame(starts, "_part int, _start bigint")
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_start") + F.col("_at"))
        .drop("_part", "_at", "_start")
    )


# So many rows are taken by a bounded heap in each task and one that merges them.
HEAP_ROWS = 1_000
# Keys looked at to choose a cut.
SAMPLE_KEYS = 10_000


def first_rows(df: DataFrame, order: list[Column], n: int, keys: list[Column] | None = None) -> DataFrame:
    """The first ``n`` rows in ``order``, however large ``n`` is.

    Few rows are kept by a heap inside each task.  For more, ``keys`` (the plain columns
    of an ascending ``order``, NULL first) give a cut: the key of a sampled row that has at
    least ``n`` rows up to it, so that only those are shuffled and sorted.  Without them
    each partition sorts its own rows and sends its first ``n``.
    """
    if n <= 0:
        return df.limit(0)
    if n <= HEAP_ROWS:
        return df.orderBy(*order).limit(n)
    if keys is None:
        within = df.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(_IN_PARTITION))
        return number_rows(within.where(F.col("_at") < n).drop("_at"), order, "_no").where(F.col("_no") < n).drop("_no")
    kept = df
    if (up_to := _cut(df, keys, n)) is not None:
        kept, seen = materialize_with(df.where(F.struct(*keys) <= up_to), "first", n=F.count(F.lit(1)))
        if seen["n"] < n:
            kept = df
    return number_rows(kept, order, "_no").where(F.col("_no") < n).drop("_no")


def _cut(df: DataFrame, keys: list[Column], n: int) -> Column | None:
    """A key that very likely has ``n`` rows up to it and not many more; None for no cut."""
    total = df.count()
    share = SAMPLE_KEYS / max(total, 1)
    place = math.ceil(n * share + 5 * math.sqrt(n * share) + 5)
    named = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    if share >= 1 or place >= SAMPLE_KEYS:
        return None
    # As many keys as are sampled, whatever the table holds.
    first = named.sample(share, seed=7).orderBy(*named.columns).limit(place).collect()
    if len(first) < place:
        return None
    values = [F.lit(first[-1][f.name]).cast(f.dataType).alias(f.name) for f in named.schema.fields]
    return F.struct(*values)
