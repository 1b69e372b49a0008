"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is found in a document when at least ``threshold`` per cent of its
distinct word shingles occur in the document. Jaccard similarity says little here,
because an item is short and a document may be long, so the search is for
containment:

* Items are partitioned by the size of their shingle set, in powers of two. Each
  partition keeps, per item, the smallest hash values of its shingles (a bottom-m
  MinHash sketch). ``m`` is set by the partition's upper size so that an item of
  that size with the threshold met must share one of its minima with the
  document: it can miss at most ``size - needed`` shingles, and m is one more.
  Nothing is lost, however long the document is.
* The hashed shingles of the documents are looked up among the minima. Documents
  too short for the smallest item of a partition are skipped.
* Each pair found is verified on the shingles themselves, as strings.

Everything is DataFrame expressions. The minima and the item shingles are broadcast
only when their counted rows are within a bound; else they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.llm.sizes import small_side, unused
from placeloom.llm.words import lowered, shingle_hashes, words
from placeloom.session import materialize

@dataclass(frozen=True)
class Containment:
    """``shingle`` words per shingle; ``threshold`` per cent of an item's shingles."""

    shingle: int = 5
    threshold: int = 80


def _needed(size: Column, rules: Containment) -> Column:
    return F.ceil(size * rules.threshold / 100)


def _texts_of(words_column: Column, width: Column) -> Column:
    """All runs of ``width`` words as strings; words hold no blanks, so none collide."""
    count = F.size(words_column) - width + 1
    return F.when(
        (count >= 1) & (width >= 1),
        F.transform(
            F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
            lambda at: F.array_join(F.slice(words_column, at, width), " "),
        ),
    ).otherwise(F.array().cast("array<string>"))


def item_sketches(benchmark: DataFrame, rules: Containment, item_id: str, text: str) -> DataFrame:
    """One row per item: key, width, size, minima and shingles.

    An item with fewer words than a shingle has its whole sequence as one, whose
    ``width`` is its number of words. An item without words matches nothing.
    """
    split = benchmark.select(
        F.col(f"`{item_id}`").alias("item_id"), words(lowered(F.col(f"`{text}`"))).alias("item_words")
    ).where(F.size("item_words") > 0)
    split = split.withColumn("width", F.least(F.size("item_words"), F.lit(rules.shingle)))
    split = split.withColumn("texts", F.array_distinct(_texts_of(F.col("item_words"), F.col("width"))))
    # Repeated rows are one item; rows that share an id but not a text are two.
    sized = split.select(
        "item_id",
        F.xxhash64("texts").alias("item_key"),
        "width",
        "texts",
        F.size("texts").alias("size"),
    ).dropDuplicates(["item_id", "item_key"])
    part = F.floor(F.log2("size")).cast("int")
    upper = F.pow(F.lit(2.0), part + 1).cast("int") - 1
    hashes = F.sort_array(
        F.array_distinct(F.transform("texts", lambda x: _run_hash(F.split(x, " "))))
    )
    return (
        sized.withColumn("part", part)
        .withColumn("minima", F.slice(hashes, F.lit(1), (upper - _needed(upper, rules) + 1).cast("int")))
        .withColumn("least", _needed(F.col("size"), rules).cast("int"))
    )


def _run_hash(run: Column) -> Column:
    return F.xxhash64(F.transform(run, lambda x: F.xxhash64(x)))


def _document_runs(word_hashes: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` word hashes, equal to ``_run_hash`` of the words."""
    return shingle_hashes(word_hashes, width)


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    rules: Containment = Containment(),
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Pairs of document and item: doc_id, doc_key, item_id, item_shingles, matched.

    ``doc_key`` tells apart rows that share a doc_id (or have none): it is a hash
    of id and text, so exact repeats of a row are found once. Null or blank texts
    and items match nothing; empty tables give no pairs; other columns are not read.
    """
    id_column, body = F.col(f"`{doc_id}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    items = materialize(item_sketches(benchmark, rules, item_id, item_text), "items")
    widths = [r.width for r in items.select("width").distinct().collect()]  # at most ``shingle`` values
    minima = small_side(items.select("part", "width", "item_id", "item_key", "least", F.explode("minima").alias("hash")))
    named = docs.select(
        id_column.alias("doc_id"), F.xxhash64(id_column, body).alias("doc_key"), body.alias("body")
    )
    split = named.select("doc_id", "doc_key", words(lowered(F.col("body"))).alias("doc_words"))
    hashed = split.select("doc_id", "doc_key", F.transform("doc_words", lambda x: F.xxhash64(x)).alias("singles"))
    found = None
    for width in sorted(widths):
        # explode() would infer a filter on the size of the runs, which Catalyst pushes
        # below their making, where it cuts the text anew for every run; the outer form
        # does not, and its one row without a hash for short documents joins nothing.
        runs = hashed.select("doc_id", "doc_key", _document_runs(F.col("singles"), width).alias("runs"))
        rows = runs.select("doc_id", "doc_key", F.size("runs").alias("n_runs"), F.explode_outer("runs").alias("hash"))
        hits = (
            rows.join(minima.where(F.col("width") == width), "hash")
            .where(F.col("n_runs") >= F.col("least"))
            .select("doc_id", "doc_key", "item_id", "item_key")
        )
        found = hits if found is None else found.unionByName(hits)
    if found is None:  # no item has a word
        found = named.join(items, F.lit(False)).select("doc_id", "doc_key", "item_id", "item_key")
    candidates = materialize(found.distinct(), "leak-candidates")
    # Verify on strings: only documents with a candidate are cut into shingles again.
    keys = small_side(candidates.select("doc_key").distinct())
    suspects = named.join(keys, "doc_key", "left_semi").dropDuplicates(["doc_key"])
    suspects = suspects.select("doc_key", words(lowered(F.col("body"))).alias("doc_words"))
    shingles = None
    for width in sorted(widths):
        rows = suspects.select("doc_key", F.explode_outer(_texts_of(F.col("doc_words"), F.lit(width))).alias("shingle"))
        shingles = rows if shingles is None else shingles.unionByName(rows)
    wanted = items.select(
        "item_id", "item_key", F.col("size").alias("item_shingles"), "least", F.explode("texts").alias("shingle")
    )
    if shingles is None:
        return candidates.select("doc_id", "doc_key", "item_id", F.lit(0).alias("item_shingles"), F.lit(0).alias("matched"))
    matched = (
        shingles.join(small_side(wanted), "shingle")
        .groupBy("doc_key", "item_id", "item_key", "item_shingles", "least")
        .agg(F.count_distinct("shingle").cast("int").alias("matched"))
        .where(F.col("matched") >= F.col("least"))
    )
    same = [matched[c].eqNullSafe(candidates[c]) for c in ("doc_key", "item_id", "item_key")]
    return candidates.join(matched, same[0] & same[1] & same[2]).select(
        candidates["doc_id"], candidates["doc_key"], candidates["item_id"], "item_shingles", "matched"
    )


def remove(
    docs: DataFrame,
    benchmark: DataFrame,
    rules: Containment = Containment(),
    doc_id: str = "doc_id",
    text: str = "text",
    **names: str,
) -> DataFrame:
    """``docs`` without the documents in which an item is found; all columns stay.

    Rows are told apart by id and text, null ids included; rows that repeat both go or
    stay together. Null and blank texts hold no item and stay, as all rows do when the
    benchmark is empty; an empty table stays empty. No column name is reserved.
    """
    own_id, own_key = unused(docs, "_leak_id"), unused(docs, "_leak_key")
    found = find(docs, benchmark, rules, doc_id, text, **names)
    leaks = materialize(
        found.select(F.col("doc_id").alias(own_id), F.col("doc_key").alias(own_key)).distinct(), "leaks"
    )
    identity = F.col(f"`{doc_id}`")
    key = F.xxhash64(identity, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return docs.join(small_side(leaks), (key == F.col(own_key)) & identity.eqNullSafe(F.col(own_id)), "left_anti")
