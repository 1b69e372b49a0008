"""Size checks and joins that stay balanced when one key is very frequent."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.session import materialize_with

# Narrow rows only (keys and numbers): about 20 MB at the limit.
BROADCAST_ROWS = 200_000
# A task of the balanced join meets at most about SIDE_ROWS x SIDE_ROWS pairs.
SIDE_ROWS = 10_000
# A key with more rows than this on either side is cut, however few it meets.
KEY_ROWS = 1_000_000
# Keys that a sketch reports, and that it keeps counters for: one with more than a few
# ten-thousandths of the rows is never missed.
FREQUENT_KEYS, TRACKED_KEYS = 1_000, 100_000


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; stops counting there."""
    return df.limit(max_rows + 1).count() <= max_rows


def balanced_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_id: Sequence[str],
    right_id: Sequence[str],
    broadcast_rows: int = BROADCAST_ROWS,
    side_rows: int = SIDE_ROWS,
    left_rows: int | None = None,
) -> DataFrame:
    """Inner equi join whose hot keys are cut into blocks.

    A side that is small (counted here, or for ``left`` bounded by the caller's
    count ``left_rows``) is broadcast and the other is never shuffled.
    Otherwise each side is evaluated once: it is written, and the same write counts
    its rows and sketches its most frequent keys.  A key with too many rows on one
    side, or whose two sides multiply to more than ``side_rows`` squared, is cut into
    ``l x r`` blocks, each side salted by its own row identity and repeated for the
    other side's salts, so every pair still meets exactly once.  Keys that the sketch
    misses are less frequent than any it reports, and skewed partitions among them are
    left to adaptive execution.
    """
    keys = list(keys)
    if left_rows is None:
        left, l = _written(left, keys)
        left_rows = l.rows
    elif left_rows > broadcast_rows:
        left, l = _written(left, keys)
    if left_rows <= broadcast_rows:
        return right.join(F.broadcast(left), keys)
    right, r = _written(right, keys)
    if r.rows <= broadcast_rows:
        return left.join(F.broadcast(right), keys)

    hot = _hot(l, r, side_rows)
    if not hot:
        return left.hint("merge").join(right, keys)
    # At most twice the keys that a sketch reports.
    hot = F.broadcast(left.sparkSession.createDataFrame(hot, "_hash bigint, _l_blocks int, _r_blocks int"))

    def blocks(df: DataFrame, identity: Sequence[str], mine: str, other: str) -> DataFrame:
        # Keys that are not hot keep one block, 0 x 0.
        own = F.pmod(F.xxhash64(*identity), F.coalesce(F.col(f"{mine}_blocks"), F.lit(1)))
        copies = F.sequence(F.lit(0), F.coalesce(F.col(f"{other}_blocks"), F.lit(1)) - 1)
        return df.withColumn("_hash", F.xxhash64(*keys)).join(hot, "_hash", "left").select(
            *df.columns,
            own.cast("int").alias(f"{mine}_block"),
            F.explode(copies).alias(f"{other}_block"),
        )

    cut = [*keys, "_l_block", "_r_block"]
    left_blocks = blocks(left, left_id, "_l", "_r")
    right_blocks = blocks(right, right_id, "_r", "_l")
    return left_blocks.hint("merge").join(right_blocks, cut).drop("_l_block", "_r_block")


@dataclass(frozen=True)
class _Side:
    """Rows of a side, and of its most frequent keys, by hash, about how many have each."""

    rows: int
    frequent: dict[int, int]

    def count(self, key: int) -> int:
        """For a key that is not reported: no more than the least frequent one that is."""
        rest = min(self.frequent.values()) if len(self.frequent) >= FREQUENT_KEYS else 1
        return self.frequent.get(key, rest)


def _written(df: DataFrame, keys: list[str]) -> tuple[DataFrame, _Side]:
    """``df`` written once, with what the write counted."""
    named = ", ".join(f"`{k}`" for k in keys)
    sketch = F.expr(f"approx_top_k(xxhash64({named}), {FREQUENT_KEYS}, {TRACKED_KEYS})")
    df, seen = materialize_with(df, "side", n=F.count(F.lit(1)), frequent=sketch)
    return df, _Side(seen["n"], {r["item"]: r["count"] for r in seen["frequent"] or []})


def _hot(left: _Side, right: _Side, side_rows: int) -> list[tuple[int, int, int]]:
    """Keys too heavy for one task: hash, blocks of the left side, blocks of the right."""
    found = []
    for key in {*left.frequent, *right.frequent}:
        l, r = left.count(key), right.count(key)
        if l * r > side_rows * side_rows or max(l, r) > KEY_ROWS:
            found.append((key, math.ceil(l / side_rows), math.ceil(r / side_rows)))
    return found
