"""Packing into optimal length buckets.

Documents are cut into sequences of at most ``max_tokens``. The global histogram of
sequence lengths, in steps of ``step`` tokens (1: exact lengths), has at most
``max_tokens / step`` rows whatever the corpus; dynamic programming over it chooses the bucket boundaries
with the least padding. Sequences of a bucket, in the order of their documents, fill
batches of ``budget`` tokens, padding included.

A sequence's place in its bucket is its global row number less the size of the
buckets before, so neither a bucket nor the corpus passes through one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.llm import token_counts
from placeloom.llm.words import words
from placeloom.operators.numbering import number_rows
from placeloom.session import materialize


_MORE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Packing:
    max_tokens: int = 2048
    step: int = 16
    buckets: int = 8
    budget: int = 16384


def sequences(docs: DataFrame, length: Column, packing: Packing, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, piece (0..), n_tokens: each document in runs of ``max_tokens``."""
    size = F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long")
    sized = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), size.alias("size"))
    return sized.select(
        "doc_id", "size", F.explode(F.sequence(F.lit(0), (F.greatest(F.ceil(F.col("size") / packing.max_tokens), F.lit(1)) - 1).cast("int"))).alias("piece")
    ).select(
        "doc_id",
        "piece",
        F.least(F.col("size") - F.col("piece") * packing.max_tokens, F.lit(packing.max_tokens)).cast("int").alias("n_tokens"),
    )


def boundaries(counts: dict[int, int], packing: Packing) -> list[int]:
    """The upper ends, in steps, of the buckets with the least padding.

    ``counts`` maps a bin (length in steps, rounded up) to its sequences. As many
    buckets as allowed are used, no more than there are bins. Of equally good
    choices the one with the smaller ends is taken.
    """
    if not counts:
        return []
    bins = np.array(sorted(counts), np.int64)
    before = np.cumsum([counts[b] for b in bins.tolist()])
    ends = [[b] for b in bins.tolist()]
    # Padding is the padded length less the fixed sum of lengths: minimise the former.
    cost, place = packing.step * bins * before, np.arange(len(bins))
    between = packing.step * bins[:, None] * (before[:, None] - before[None, :])
    reachable = np.tri(len(bins), k=-1, dtype=bool)
    for used in range(1, min(packing.buckets, len(bins))):
        # The best state with one bucket less that ends earlier; ``place`` ranks their ends.
        total = np.where(reachable, cost[None, :] + between, _MORE)
        total[:, : used - 1] = _MORE
        least = total.min(axis=1)
        chosen = np.where(total == least[:, None], place[None, :], len(bins)).argmin(axis=1)
        ends = [[*ends[a], b] for a, b in zip(chosen.tolist(), bins.tolist())]
        order = np.lexsort((bins, place[chosen]))
        cost, place = least, np.empty(len(bins), np.int64)
        place[order] = np.arange(len(bins))
    return ends[-1]


def pack(
    docs: DataFrame,
    packing: Packing = Packing(),
    length: Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per sequence: doc_id, piece, n_tokens, padded, batch, slot.

    ``length`` gives the tokens of a document; by default its words are counted, which
    are fewer than its tokens: ``pack_tokens`` counts these. A document without tokens
    (null or empty text) is one sequence of length 0 that takes no place: its padded,
    batch and slot are null. Sequences with the same id
    (repeated rows, null ids) are packed each on its own. An empty table packs to an
    empty one. Other columns are not read.
    """
    if length is None:
        length = F.size(words(F.col(f"`{text}`")))
    cut = sequences(docs, length, packing, doc_id)
    step = F.ceil(F.col("n_tokens") / packing.step).cast("int")
    # Numbering by length first makes every bucket, of whatever bounds, a run of rows.
    numbered = number_rows(
        cut.withColumn("_step", step), [F.col("_step"), F.col("doc_id"), F.col("piece"), F.col("n_tokens")], "_row"
    )
    histogram = numbered.groupBy("_step").agg(F.count("*").alias("n")).collect()  # at most max_tokens / step + 1
    counts = {r._step: r.n for r in histogram}
    first, batches = counts.pop(0, 0), 0
    ends = boundaries(counts, packing)
    padded, start, offset, per_batch = (F.lit(None).cast(kind) for kind in ("int", "bigint", "bigint", "bigint"))
    low = 0
    for end in ends:
        size = sum(n for b, n in counts.items() if low < b <= end)
        fits = max(1, packing.budget // (end * packing.step))
        inside = (F.col("_step") > low) & (F.col("_step") <= end)
        padded = F.when(inside, F.lit(end * packing.step)).otherwise(padded)
        start = F.when(inside, F.lit(first).cast("bigint")).otherwise(start)
        offset = F.when(inside, F.lit(batches).cast("bigint")).otherwise(offset)
        per_batch = F.when(inside, F.lit(fits).cast("bigint")).otherwise(per_batch)
        first, batches, low = first + size, batches - (-size // fits), end
    placed = numbered.withColumns({"_padded": padded, "_rank": F.col("_row") - start, "_offset": offset, "_fits": per_batch})
    return placed.select(
        "doc_id",
        "piece",
        "n_tokens",
        F.col("_padded").alias("padded"),
        (F.col("_offset") + F.floor(F.col("_rank") / F.col("_fits"))).alias("batch"),
        F.pmod(F.col("_rank"), F.col("_fits")).cast("int").alias("slot"),
    )


def pack_tokens(
    docs: DataFrame, tokenizer: str, packing: Packing = Packing(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``pack`` by the pieces of a tokenizer, so that all limits are in its tokens.

    ``tokenizer`` is a path as for ``token_counts.count_tokens``. A text of one very
    long word is cut like any other. Null, empty and repeated rows, null ids, ties (by
    id, then piece), empty tables and other columns are as in ``pack``.
    """
    counted = token_counts.count_tokens(docs, tokenizer, doc_id, text).select("doc_id", "n_tokens")
    # Written once: the range partitioning reads its input twice.
    return pack(materialize(counted, "token-lengths"), packing, F.col("n_tokens"))
