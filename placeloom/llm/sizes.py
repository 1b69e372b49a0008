"""Broadcasts behind a count, names no column bears, memory given back."""

from __future__ import annotations

import ctypes
import inspect
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Beyond so many rows a side is shuffled instead.
BROADCAST_ROWS = 500_000


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` bears it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_side(df: DataFrame) -> DataFrame:
    """``df`` (of a few short columns) marked for broadcast when it is small; counted no further."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


@lru_cache(maxsize=1)
def _allocator():
    """The C library's own way to return freed memory, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def giving_back(run):
    """``run`` (of a group, or of a pair of groups), after which freed memory goes back to the system.

    Workers are used again by later stages and else keep the most they ever held.
    """

    def one(rows):
        try:
            return run(rows)
        finally:
            _give_back()

    def two(left, right):
        try:
            return run(left, right)
        finally:
            _give_back()

    # Spark tells by the number of parameters what it is to hand over.
    return one if len(inspect.signature(run).parameters) == 1 else two


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if trim := _allocator():
        trim(0)
