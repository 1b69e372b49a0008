"""The best documents of each item, by weighted terms, through pairs of trees.

One pass over the documents counts, per block of some thousand, the items' terms in each;
the blocks are written, and the statistics of the weights added up from them. Each block
then becomes a tree that is searched together with a tree of the items (``dual_tree``).
One block in some is searched first: its kth scores are bars that the others must beat,
so the number of rows that leave the other blocks does not grow with the documents.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from placeloom.llm import dual_tree
from placeloom.session import remove_path, scratch_path

# A block of documents ends with so many of them or of their terms that items have.
BLOCK_DOCS, BLOCK_HITS = 4096, 1 << 21
# Bytes of item texts that are searched for together; more items take more passes.
BATCH_BYTES = 8 << 20
# One block in so many is searched first.
FIRST = 32
_CHUNK = 4 << 20
# What is not a letter, a digit or beyond ASCII parts terms; A-Z are lower-cased.
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
_BLOCK = "block bigint, n_with bigint, n_terms bigint, docs array<bigint>, sizes binary, counts binary, terms binary, often binary, held array<struct<term int, df bigint>>"  # noqa: E501
_FOUND = "item int, item_id bigint, doc_id bigint, score bigint"


@dataclass(frozen=True)
class RankSettings:
    """How many documents an item gets, and how far their length lowers the weight of a count."""

    top: int = 50
    slope: int = 50
    saturation: int = 20


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some megabytes at a time."""
    plain, at = text.translate(_TABLE), 0
    while at < len(plain):
        end = plain.find(b" ", at + _CHUNK) if len(plain) - at > _CHUNK else -1
        yield plain[at : end if end >= 0 else len(plain)].split()
        at = end if end >= 0 else len(plain)


def _packed(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class _Block:
    """Documents of a block with the terms that items have; the others only count."""

    def __init__(self, number: int):
        self.number, self.n_with, self.n_terms = number, 0, 0
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.hits: list[int] = []
        self.found = array("i")

    def add(self, doc_id: int | None, text: bytes, vocabulary: dict[bytes, int]) -> None:
        n, before = 0, len(self.found)
        for terms in term_lists(text):
            n += len(terms)
            self.found.extend(filter(None, map(vocabulary.get, terms)))
        self.n_with += n > 0
        self.n_terms += n
        if len(self.found) > before:
            self.ids.append(doc_id)
            self.sizes.append(n)
            self.hits.append(len(self.found) - before)

    def row(self, n_terms: int) -> dict:
        of = np.repeat(np.arange(len(self.ids)), np.array(self.hits, np.int64))
        keys, often = np.unique(of * n_terms + np.frombuffer(self.found, np.int32), return_counts=True)
        terms = keys % n_terms
        held, df = np.unique(terms, return_counts=True)
        return {
            "block": self.number,
            "n_with": self.n_with,
            "n_terms": self.n_terms,
            "docs": self.ids,
            "sizes": _packed(np.array(self.sizes, np.int64)),
            "counts": _packed(np.bincount(keys // n_terms, minlength=len(self.ids))),
            "terms": _packed(terms),
            "often": _packed(often),
            "held": [{"term": t, "df": n} for t, n in zip(held.tolist(), df.tolist())],
        }


def _count(vocabulary: dict[bytes, int], schema: pa.Schema):
    n_terms = len(vocabulary) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(TaskContext.get().partitionId() << 32)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for doc_id, text in zip(batch.column(0), texts):
                block.add(doc_id.as_py(), text.as_py() or b"", vocabulary)
                if len(block.ids) >= BLOCK_DOCS or len(block.found) >= BLOCK_HITS:
                    yield pa.RecordBatch.from_pylist([block.row(n_terms)], schema=schema)
                    block = _Block(block.number + 1)
        if block.n_with:
            yield pa.RecordBatch.from_pylist([block.row(n_terms)], schema=schema)

    return run


@dataclass(frozen=True)
class _Question:
    """What the search of a block needs: the items, the weights and the corpus."""

    ids: list[int | None]
    tree: dual_tree.ItemTree
    n_docs: int
    n_all: int
    settings: RankSettings

    def documents(self, row: dict) -> tuple[dual_tree.DocumentTree, np.ndarray]:
        """The tree of a block, and in its order whether an id is null, and the id."""
        s, n_terms = self.settings, len(self.tree.weights)
        sizes, counts, terms, often = (_unpacked(row[c]) for c in ("sizes", "counts", "terms", "often"))
        of = np.repeat(np.arange(len(sizes)), counts)
        placed = dual_tree.order(of, terms, len(sizes), n_terms)
        place = np.empty(len(sizes), np.int64)
        place[placed] = np.arange(len(sizes))
        length = 100 - s.slope + (s.slope * sizes * self.n_docs) // self.n_all
        values = (1_000_000_000 * often) // (1000 * often + s.saturation * length[of])
        moved = np.argsort(place[of], kind="stable")
        rows = dual_tree.rows_of(place[of][moved], terms[moved], values[moved], len(sizes))
        docs = np.array([(d is None, d or 0) for d in row["docs"]], np.int64).reshape(-1, 2)
        return dual_tree.DocumentTree(rows, n_terms), docs[placed]


def _search(question: _Question, bars: dict[int, tuple[int, int, int]], schema: pa.Schema):
    """Blocks to the rows of each item that beat its bar, at most ``top`` of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = question.tree
        best = dual_tree.Best(len(tree.items), question.settings.top, bars)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["docs"]:
                    dual_tree.search(*question.documents(row), tree, best)
        for place, rows in enumerate(best.rows):
            if len(rows):
                number = int(tree.order[place])
                docs = [None if null else doc for _, null, doc in rows.tolist()]
                columns = [[number] * len(rows), [question.ids[number]] * len(rows), docs, rows[:, 0].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return run


def _written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _ranked(found: DataFrame, top: int) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def _of_items(docs: DataFrame, items: list, settings: RankSettings) -> DataFrame | None:
    """The ranking of a batch of items, given as (id, text); None if no document has a term."""
    spark = docs.sparkSession
    term_sets = [{t for terms in term_lists((text or "").encode()) for t in terms} for _, text in items]
    vocabulary = {t: k for k, t in enumerate(sorted(set().union(*term_sets)), 1)}
    block_schema, found_schema = T.StructType.fromDDL(_BLOCK), T.StructType.fromDDL(_FOUND)
    blocks, path = _written(docs.mapInArrow(_count(vocabulary, to_arrow_schema(block_schema)), block_schema), "term-blocks")
    whole = blocks.agg(F.sum("n_with").alias("n"), F.sum("n_terms").alias("l"), F.count(F.lit(1)).alias("blocks")).first()
    if not whole.n:
        return None
    weights = np.zeros(len(vocabulary) + 1, np.int64)
    # One row per term of the batch at most.
    for r in blocks.select(F.explode("held").alias("h")).groupBy("h.term").agg(F.sum("h.df").alias("df")).collect():
        weights[r.term] = math.floor(1000 * math.log((2 * whole.n + 2) / (2 * r.df + 1)))
    terms = [np.array(sorted(vocabulary[t] for t in found), np.int64) for found in term_sets]
    tree = dual_tree.ItemTree(terms, weights)
    question = _Question([i for i, _ in items], tree, whole.n, whole.l, settings)
    place = {int(number): at for at, number in enumerate(tree.order)}

    arrow, every = to_arrow_schema(found_schema), max(1, min(FIRST, whole.blocks // 4))
    is_first = F.pmod(F.xxhash64("block"), F.lit(every)) == 0
    first, _ = _written(blocks.where(is_first).mapInArrow(_search(question, {}, arrow), found_schema), "ranked-first")
    last = _ranked(first, settings.top).where(F.col("rank") == settings.top).collect()  # a row per item of the batch
    bars = {place[r.item]: (r.score, int(r.doc_id is None), r.doc_id or 0) for r in last}
    rest, _ = _written(blocks.where(~is_first).mapInArrow(_search(question, bars, arrow), found_schema), "ranked-rest")
    remove_path(spark, path)
    return _ranked(first.unionByName(rest), settings.top)


def rank(
    docs: DataFrame,
    items: DataFrame,
    settings: RankSettings = RankSettings(),
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score of the ``settings.top`` best documents with a score above 0 of each item.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z
    lower-cased. Ids are whole numbers. Texts that are null, empty or hold no term match
    nothing and count for no statistic; of equal scores the smaller id comes first and a
    null id last. Repeated documents are ranked each; items that repeat are answered each,
    so their ranks repeat. An empty table on either side gives an empty result. Other
    columns are not read, whatever their names.

    Items are searched for in batches of ``BATCH_BYTES`` of text, each by one pass over
    the documents.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    asked = items.select(F.col(f"`{item_id}`").cast("bigint").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches, found = -(-size // BATCH_BYTES), []
    for k in range(batches):
        # Like texts fall into one batch, so a batch is dealt by row, not by text alone.
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(batches)) == k) if batches > 1 else asked
        rows = [(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()]
        ranked = _of_items(own, rows, settings) if rows else None
        if ranked is not None:
            found.append(ranked.select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
