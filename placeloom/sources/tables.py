"""Parquet tables the jobs keep: append-only keyed tables and the cell log."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom.operators import fold
from placeloom.operators.skew import BROADCAST_ROWS, is_small
from placeloom.operators.sweep import latest_log, with_scope
from placeloom.schemas import CELL_LOG, NUMBERED_LOG
from placeloom.session import list_folders, materialize, path_exists, remove_path

_WHOLE = "whole-"


class DeltaFolder:
    """A keyed table as folders of Parquet files that are only ever added.

    Each batch of changes is one folder of rows, at most one per key, and the table is
    what folding all folders gives.  The fold must not care how often or in which order
    it sees a row.  A batch with a name that is there already, or was before a
    ``compact``, adds nothing, so a stream can replay it.  ``compact`` is a job of its
    own: it writes what all folders give as one, and removes them.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        key: str,
        fold_rows: Callable[[DataFrame], DataFrame],
        files: int = 16,
    ):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key
        self.fold_rows, self.files = fold_rows, files

    def _folder(self, name: str) -> str:
        return f"{self.path}/batch={name}"

    def names(self) -> list[str]:
        """Complete batches; one per call since the last compaction."""
        found = [n.partition("=")[2] for n in list_folders(self.spark, self.path) if n.startswith("batch=")]
        return sorted(n for n in found if path_exists(self.spark, f"{self._folder(n)}/_SUCCESS"))

    def _compacted(self) -> DataFrame:
        path = f"{self.path}/compacted"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], "name string")
        return self.spark.read.schema("name string").parquet(path)

    def holds(self, name: str) -> bool:
        """Whether a batch of this name was added before."""
        if path_exists(self.spark, f"{self._folder(name)}/_SUCCESS"):
            return True
        return not self._compacted().where(F.col("name") == name).isEmpty()

    def add(self, rows: DataFrame, name: str | None = None) -> bool:
        """Add one folder with ``rows``, one per key; False if the batch is there already.

        A folder that a failed job left half-written is written anew.
        """
        name = name or uuid.uuid4().hex
        if self.holds(name):
            return False
        rows.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(self._folder(name))
        return True

    def _rows(self, names: list[str]) -> DataFrame:
        paths = [self._folder(n) for n in names]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        """The table.  Behind a compaction only keys that changed since are folded.

        The other rows come straight from the compacted folder, without a shuffle.
        """
        names = self.names()
        whole = [n for n in names if n.startswith(_WHOLE)]
        later = [n for n in names if not n.startswith(_WHOLE)]
        if len(whole) != 1 or not later:
            return self._rows(names) if len(names) == 1 else self.fold_rows(self._rows(names))
        base, changes = self._rows(whole), self._rows(later)
        keys = changes.select(self.key).distinct()
        if not is_small(keys, BROADCAST_ROWS):
            return self.fold_rows(base.unionByName(changes))
        keys = F.broadcast(keys)
        touched = base.join(keys, self.key, "left_semi").unionByName(changes)
        return base.join(keys, self.key, "left_anti").unionByName(self.fold_rows(touched))

    def keep_known(self, rows: DataFrame) -> DataFrame:
        """``rows`` whose key the table holds."""
        return rows.join(self._rows(self.names()).select(self.key).distinct(), self.key, "left_semi")

    def compact(self) -> int:
        """Fold all batches into one; how many there were.

        Stopped anywhere it loses nothing: until the old folders are gone they fold to
        the same table once more.  Readers that began before must have ended.
        """
        names = self.names()
        if len(names) < 2:
            return len(names)
        whole = self.fold_rows(self._rows(names)).repartition(self.files, self.key)
        whole.write.parquet(self._folder(f"{_WHOLE}{uuid.uuid4().hex}"))
        done = self.spark.createDataFrame([(n,) for n in names if not n.startswith(_WHOLE)], "name string")
        done.coalesce(1).write.mode("append").parquet(f"{self.path}/compacted")
        for name in names:
            remove_path(self.spark, self._folder(name))
        return len(names)


class PlaceStore:
    """The place snapshot: every change is added as fold states and folded on reading."""

    def __init__(
        self, spark: SparkSession, path: str, buckets: int = 16, content: list[str] | None = None
    ):
        """``buckets``: files that a compaction writes."""
        self.spark = spark
        self.table = DeltaFolder(spark, path, fold.state_schema(content), "place_id", fold.fold_state, buckets)

    def state(self) -> DataFrame:
        return self.table.read()

    def places(self) -> DataFrame:
        return fold.places_of(self.state())

    def count(self) -> int:
        return self.state().count()

    def _add(self, changes: DataFrame, name: str | None = None) -> bool:
        missing = [f for f in self.table.schema.fields if f.name not in changes.columns]
        blank = {f.name: F.lit(None).cast(f.dataType) for f in missing}
        return self.table.add(changes.withColumns(blank), name)

    def upsert(self, observations: DataFrame, batch: str | None = None) -> bool:
        """Fold observations in, as one batch; False if ``batch`` was folded in before.

        What is written grows with the batch, not with the store.
        """
        if batch is not None and self.table.holds(batch):
            return False
        return self._add(fold.fold_state(fold.lift(observations)), batch)

    def mark_synced(self, results: DataFrame, synced_at: datetime) -> None:
        """Record deliveries; ids the store does not hold change nothing.  Later ones win."""
        known = self.table.keep_known(results.select("place_id", "id"))
        marks = known.groupBy("place_id").agg(F.max("id").alias("salesforce_id"))
        self._add(marks.withColumn("salesforce_synced_at", F.lit(synced_at).cast("timestamp")))

    def prune(self, cutoff: datetime) -> int:
        """Blank stale content; returns the rows affected, blank ones included.

        Readers no longer see it at once; it leaves the files with the next ``compact``.
        """
        stale = self.state().where(F.col("last_seen_at") < F.lit(cutoff))
        limit = F.lit(cutoff).cast("timestamp")
        marks = materialize(stale.select("place_id", "pruned_before"), "stale")
        affected = marks.count()
        due = marks.where(F.coalesce(F.col("pruned_before") < limit, F.lit(True)))
        if affected and not due.isEmpty():
            self._add(due.select("place_id", limit.alias("pruned_before")))
        return affected

    def compact(self) -> int:
        return self.table.compact()


class TargetTable:
    """A keyed Parquet table standing at the receiving end of outbound records.

    Every upsert is one batch of records; of each field the newest value given counts.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 16
    ):
        self.schema, self.key = schema, key
        self.fields = [f for f in schema.fields if f.name != key]
        stamped = [
            T.StructField(f.name, T.StructType([T.StructField("at", T.LongType()), T.StructField("value", f.dataType)]))
            for f in self.fields
        ]
        stored = T.StructType([schema[key], *stamped, T.StructField("at", T.LongType())])
        self.table = DeltaFolder(spark, path, stored, key, self._fold, buckets)

    def _fold(self, rows: DataFrame) -> DataFrame:
        names = [f.name for f in self.fields]
        return rows.groupBy(self.key).agg(*[F.max(c).alias(c) for c in names], F.max("at").alias("at"))

    def read(self) -> DataFrame:
        values = [F.col(f.name)["value"].alias(f.name) for f in self.fields]
        return self.table.read().select(self.key, *values).select(*self.schema.fieldNames())

    def upsert(self, records: DataFrame) -> dict[str, int]:
        """Apply records; returns how many were created and updated.

        Records that share a key are one: of each field the largest value given counts.
        Fields left out or NULL keep what they were.  One writer at a time.
        """
        held = self.table.read()
        at = held.agg(F.coalesce(F.max("at") + 1, F.lit(0))).first()[0]
        new = records.groupBy(self.key).agg(*[F.max(f.name).alias(f.name) for f in self.fields])
        there = held.select(self.key, F.lit(True).alias("_there"))
        new = materialize(new.join(there, self.key, "left"), "target")
        counted = new.agg(F.count_if(F.col("_there").isNull()).alias("created"), F.count("_there").alias("updated")).first()
        if counted.created or counted.updated:
            stamped = [
                F.when(F.col(f.name).isNotNull(), F.struct(F.lit(at).cast("bigint").alias("at"), F.col(f.name).alias("value")))
                .cast(self.table.schema[f.name].dataType).alias(f.name)
                for f in self.fields
            ]
            self.table.add(new.select(self.key, *stamped, F.lit(at).cast("bigint").alias("at")))
        return counted.asDict()

    def compact(self) -> int:
        return self.table.compact()


class CellLog:
    """Append-only log of searched cells; a reset starts a new version.

    Appends are numbered: of rows searched at the same time the one appended last
    is the newest.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _version(self) -> int:
        path = f"{self.path}/versions"
        if not path_exists(self.spark, path):
            return 0
        rows = self.spark.read.schema("version int").parquet(path)
        return rows.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def _data(self) -> str:
        return f"{self.path}/log-{self._version()}"

    def append(self, rows: DataFrame) -> None:
        names = CELL_LOG.fieldNames()
        number = 0
        if path_exists(self.spark, self._data()):
            number = self.rows().agg(F.coalesce(F.max("run_seq") + 1, F.lit(0))).first()[0]
        numbered = with_scope(rows).select(*names, F.lit(number).cast("bigint").alias("run_seq"))
        numbered.write.mode("append").parquet(self._data())

    def rows(self) -> DataFrame:
        path = self._data()
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], NUMBERED_LOG)
        return self.spark.read.schema(NUMBERED_LOG).parquet(path)

    def latest(self) -> DataFrame:
        return latest_log(self.rows())

    def cells(self) -> DataFrame:
        """What a miss diagnosis needs of the log."""
        return self.latest().select("lat", "lng", "radius_m", "saturated")

    def reset(self) -> None:
        version = self._version() + 1
        row = self.spark.createDataFrame([(version,)], "version int")
        row.write.mode("append").parquet(f"{self.path}/versions")
