"""Landed answers of searches straight into the store, level after level.

One streaming job keeps, for each cell of the first level, which cells below it are asked
for.  An answer to a cell that is asked for is taken at once: its places go into the
store, its cell into the log, and if it is to be split its four children are asked for.
An answer that lands before its parent's waits in the state.  No driver loop advances the
levels, and the state of a first-level cell is bounded by the cells below it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from placeloom.operators.cover import split_children
from placeloom.operators.filters import below_bar
from placeloom.operators.normalize import normalize_payload
from placeloom.operators.sweep import REASON_SPLIT, SweepSettings, judge_hits, split_reason
from placeloom.session import materialize_at, remove_path, scratch_path
from placeloom.sources.tables import CellLog, PlaceStore
from placeloom.streaming.upsert import checkpoint_id

# A landed answer: the cell as it was asked for, when it was answered, the payloads found.
ANSWER = (
    "area_id string, queue_pos bigint, depth int, lat double, lng double, radius_m double, "
    "status string, seen_at timestamp, ingest_seq bigint, payloads array<string>"
)
_JUDGED = (
    "queue_pos bigint, depth int, lat double, lng double, radius_m double, seen_at timestamp, "
    "ingest_seq bigint, payloads array<string>, result_count bigint, saturated boolean, split boolean"
)
_ACCEPTED = f"area_id string, {_JUDGED}"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ASKED, _ANSWERED = 0, 1


def judge_answers(answers: DataFrame, settings: SweepSettings) -> DataFrame:
    """Each answer with its counts and whether its cell is to be split.

    Failed answers are left out: their cells stay asked for.  A cell without results is
    one with an empty array (or null) and the status 'ok'.
    """
    if settings.split_only_if_new:
        raise ValueError("whether a place is new is known to the store only, not to an answer")
    counts = F.transform(
        F.coalesce("payloads", F.array().cast("array<string>")),
        lambda p: F.get_json_object(p, "$.userRatingCount").cast("bigint"),
    )
    low = F.size(F.filter(counts, lambda n: below_bar(n, settings.min_reviews)))
    judged = answers.where("status = 'ok'").withColumns(
        {"result_count": F.size(counts).cast("bigint"), "n_below_bar": low.cast("bigint")}
    )
    return judged.withColumns(
        {
            "saturated": F.col("result_count") >= settings.max_results,
            "split": split_reason(settings) == REASON_SPLIT,
            # The first-level cell that this one lies in: a child's number is four times its parent's, and up to three.
            "root": F.expr("shiftright(queue_pos, 2 * depth)"),
        }
    )


class Frontier(StatefulProcessor):
    """The cells asked for below one first-level cell, which itself is always asked for."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Numbers repeat from level to level.
        self.cells = handle.getMapState("cells", "depth int, queue_pos bigint", "status int")
        self.waiting = handle.getMapState("waiting", "depth int, queue_pos bigint", _JUDGED)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Of several answers to one cell in a batch the earliest counts, in whatever order they come.
        first: dict[tuple[int, int], Row] = {}
        for row in rows:
            cell = (row.depth, row.queue_pos)
            held = first.get(cell)
            if held is None or (row.seen_at, row.ingest_seq) < (held.seen_at, held.ingest_seq):
                first[cell] = row
        todo = sorted(first)  # parents before children
        while todo:
            cell = todo.pop(0)
            row = first.pop(cell)
            depth, number = cell
            status = self.cells.getValue(cell) if self.cells.containsKey(cell) else None
            if status is None and depth > 0:
                if not self.waiting.containsKey(cell):
                    self.waiting.updateValue(cell, _values(row))
                continue
            if status is not None and status[0] == _ANSWERED:
                continue
            self.cells.updateValue(cell, (_ANSWERED,))
            yield Row(area_id=key[0], **dict(zip(_NAMES, _values(row))))
            for child in [(depth + 1, 4 * number + k) for k in range(4)] if row.split else ():
                self.cells.updateValue(child, (_ASKED,))
                if self.waiting.containsKey(child):
                    if child not in first:
                        todo.append(child)
                    first[child] = Row(*_NAMES)(*self.waiting.getValue(child))
                    self.waiting.removeKey(child)

    def close(self) -> None:
        pass


_NAMES = [part.split()[0] for part in _JUDGED.split(", ")]


def _values(row: Row) -> tuple:
    return tuple(row[name] for name in _NAMES)


def accepted_answers(answers: DataFrame, settings: SweepSettings) -> DataFrame:
    """The stream of answers to cells asked for, each cell once, in the order they can be told."""
    judged = judge_answers(answers, settings).select("area_id", "root", *_NAMES)
    return judged.groupBy("area_id", "root").transformWithState(
        statefulProcessor=Frontier(), outputStructType=_ACCEPTED, outputMode="Append", timeMode="None"
    )


def observations_of(accepted: DataFrame, settings: SweepSettings) -> DataFrame:
    """The places of accepted answers that the settings keep, as the store takes them."""
    payloads = accepted.select("seen_at", "ingest_seq", F.explode("payloads").alias("payload"))
    return judge_hits(normalize_payload(payloads), settings).where("is_kept").drop(
        "is_below_bar", "is_wrong_kind", "is_kept"
    )


def start_sweep(
    answers: DataFrame,
    store: PlaceStore,
    log: CellLog,
    requests: str,
    checkpoint: str,
    settings: SweepSettings = SweepSettings(),
    once: bool = True,
) -> StreamingQuery:
    """Take landed answers (``ANSWER``) into the store, the log and the folder ``requests``.

    ``requests`` gets the cells to search next, as Parquet, one folder a batch.  A second
    answer to a cell changes nothing, as a cell searched before is not searched again.  A
    restart goes on from the checkpoint, and a batch replayed after a failure leaves the
    same store, log and requests.  Cells that coincide below different first-level cells
    are asked for below each; what they find folds into the same places.
    """
    spark: SparkSession = answers.sparkSession

    def land(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        name = f"{checkpoint_id(own, checkpoint)}-{batch_id}"
        if store.table.holds(name):
            return
        path = scratch_path(own, "accepted")
        accepted = materialize_at(batch, path)
        split = accepted.where("split").select("area_id", "queue_pos", "depth", "lat", "lng", "radius_m")
        split_children(split).write.mode("overwrite").parquet(f"{requests}/batch={name}")
        logged = accepted.select(
            F.lit(settings.scope).alias("scope"), "lat", "lng", "radius_m", "depth", "result_count",
            "saturated", "split", F.col("seen_at").alias("searched_at"),
        )
        log.append(logged)
        # The store's batch is the last: with it the whole micro-batch counts as done.
        store.upsert(observations_of(accepted, settings), name)
        remove_path(own, path)

    writer = accepted_answers(answers, settings).writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # keyed state of several kinds needs this store
    try:
        return writer.start()
    finally:
        spark.conf.set(_PROVIDER, before)
