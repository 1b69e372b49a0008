"""Token counts of documents without encoding them.

A tokenizer that first splits at white space counts a text as the sum of its
pre-tokens. So pieces are counted once per distinct pre-token of the corpus and the
counts are joined to the pre-token frequencies of each document; ids are never made.

Frequencies travel as blocks: a block is some documents of one partition, with the
distinct pre-tokens of the block and, per document, which of them it has and how
often. Pre-tokens are dealt to buckets by their hash. A block sends its distinct
pre-tokens to the buckets, each once however frequent it is, gets their piece counts
back in the same order, and sums. A word found in every document costs one entry per
block, so there is no hot key.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from placeloom.llm.sizes import giving_back
from placeloom.session import materialize, shuffle_width

# Text bytes of a block: bounds the memory of a task.
BLOCK_BYTES = 4 << 20
# Text bytes whose pre-tokens a bucket stands for, about.
BUCKET_BYTES = 16 << 20


@lru_cache(maxsize=4)
def _tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def pre_tokens(text: str) -> list[str]:
    """The runs between spaces and line feeds, some of them empty.

    Other white space stays inside a run, where the tokenizer itself splits at it.
    """
    return text.replace("\n", " ").split(" ")


def piece_counts(tokens: list[str], path: str) -> list[int]:
    """Pieces of each pre-token, as the tokenizer gives them."""
    return [len(e) for e in _tokenizer(path).encode_batch_fast(tokens, add_special_tokens=False)]


def _packed(values: np.ndarray) -> bytes:
    """Small numbers: first all low bytes, then the next, which are mostly zero."""
    return zstandard.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _block_rows(block: int, buckets: int, ids: list, sizes: list[int], counts: list[Counter]) -> list[dict]:
    distinct: set[str] = set()
    for found in counts:
        distinct.update(found)
    by_bucket: list[list[str]] = [[] for _ in range(buckets)]
    for token in distinct:
        by_bucket[zlib.crc32(token.encode()) % buckets].append(token)
    place: dict[str, int] = {}
    rows = []
    for bucket, tokens in enumerate(by_bucket):
        if not tokens:
            continue
        tokens.sort()
        for token in tokens:
            place[token] = len(place)
        # Pre-tokens hold no line feed, so one can separate them.
        rows.append({"block": block, "bucket": bucket, "tokens": zstandard.compress("\n".join(tokens).encode(), 3)})
    lengths = np.array([len(found) for found in counts], np.int64)
    total = int(lengths.sum())
    where = np.fromiter(map(place.__getitem__, chain.from_iterable(counts)), np.int64, total)
    often = np.fromiter(chain.from_iterable(found.values() for found in counts), np.int64, total)
    # Places of a document in order, as steps from one to the next.
    order = np.lexsort((where, np.repeat(np.arange(len(counts)), lengths)))
    where, often = where[order], often[order]
    steps = np.diff(where, prepend=0)
    heads = (np.cumsum(lengths) - lengths)[lengths > 0]
    steps[heads] = where[heads]
    rows.append(
        {
            "block": block,
            "bucket": -1,
            "doc_ids": ids,
            "n_bytes": sizes,
            "lengths": _packed(lengths),
            "steps": _packed(steps),
            "often": _packed(often),
        }
    )
    return rows


def _cut(buckets: int, schema: pa.Schema):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filled = TaskContext.get().partitionId() << 32, 0
        ids, sizes, counts = [], [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                size = len(text.encode())
                found = Counter(pre_tokens(text))
                found.pop("", None)
                ids.append(doc_id.as_py())
                sizes.append(size)
                counts.append(found)
                filled += size + 16
                if filled >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_pylist(_block_rows(block, buckets, ids, sizes, counts), schema)
                    block, filled, ids, sizes, counts = block + 1, 0, [], [], []
        if ids:
            yield pa.RecordBatch.from_pylist(_block_rows(block, buckets, ids, sizes, counts), schema)

    return cut


def _count(path: str, schema: pa.Schema):
    def count(rows: pa.Table) -> pa.Table:
        lists = [zstandard.decompress(x.as_py()).decode().split("\n") for x in rows["tokens"]]
        distinct = list(set(chain.from_iterable(lists)))
        pieces: dict[str, int] = {}
        for at in range(0, len(distinct), 20_000):
            part = distinct[at : at + 20_000]
            pieces.update(zip(part, piece_counts(part, path)))
        out = [_packed(np.fromiter(map(pieces.__getitem__, tokens), np.int64, len(tokens))) for tokens in lists]
        return pa.table([rows["block"], rows["bucket"], pa.array(out, pa.binary())], schema=schema)

    return count


def _sum(schema: pa.Schema):
    def add(postings: pa.Table, counts: pa.Table) -> pa.Table:
        ordered = sorted(zip(counts["bucket"].to_pylist(), counts["pieces"].to_pylist()))
        pieces = np.concatenate([_unpacked(x) for _, x in ordered] or [np.zeros(0, np.int64)])
        ids, sizes, totals = [], [], []
        for row in postings.to_pylist():
            lengths = _unpacked(row["lengths"])
            ends = np.cumsum(lengths)
            walked = np.concatenate([[0], np.cumsum(_unpacked(row["steps"]))])
            places = walked[1:] - np.repeat(walked[ends - lengths], lengths)
            sums = np.concatenate([[0], np.cumsum(pieces[places] * _unpacked(row["often"]))])
            totals.extend((sums[ends] - sums[ends - lengths]).tolist())
            ids.extend(row["doc_ids"])
            sizes.extend(row["n_bytes"])
        columns = [pa.array(ids, schema.field(0).type), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())]
        return pa.table(columns, schema=schema)

    return add


def count_tokens(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens.

    ``tokenizer`` is the path of a tokenizers file whose pre-tokenizer never joins
    across white space; it must be readable on every executor. A null text counts as
    empty: no bytes, no tokens. Null ids and repeated rows give a row each; an empty
    table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    id_type = named.schema["doc_id"].dataType
    wide = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("bucket", T.IntegerType()),
            T.StructField("tokens", T.BinaryType()),
            T.StructField("doc_ids", T.ArrayType(id_type)),
            T.StructField("n_bytes", T.ArrayType(T.LongType())),
            T.StructField("lengths", T.BinaryType()),
            T.StructField("steps", T.BinaryType()),
            T.StructField("often", T.BinaryType()),
        ]
    )
    counted = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("pieces", T.BinaryType())]
    )
    out = T.StructType(
        [T.StructField("doc_id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_width(spark), -(-total // BUCKET_BYTES))
    # Written once: both uses must see the same blocks, also after a lost executor.
    blocks = materialize(named.mapInArrow(_cut(buckets, _arrow(wide)), wide), "token-blocks")
    pieces = (
        blocks.where(F.col("bucket") >= 0)
        .select("block", "bucket", "tokens")
        .groupBy("bucket")
        .applyInArrow(giving_back(_count(tokenizer, _arrow(counted))), counted)
    )
    postings = blocks.where(F.col("bucket") < 0).drop("bucket", "tokens")
    return postings.groupBy("block").cogroup(pieces.groupBy("block")).applyInArrow(giving_back(_sum(_arrow(out))), out)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
