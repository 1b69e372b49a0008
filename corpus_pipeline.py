"""A training-data pipeline: rules, near-duplicates, passages, leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm import decontaminate, near_dedup, packing, quality_rules, suffix_dedup
from placeloom.llm.registry import table
from placeloom.llm.sizes import small_side, unused
from placeloom.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Verdicts belong to rows, which are told apart by id and text: rows that repeat
    both are judged alike. An empty table stays empty.
    """
    own_id, own_key = unused(docs, "_rejected_id"), unused(docs, "_rejected")
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    keyed = docs.select("doc_id", key.alias("key"), "text", "lang")
    rejected = quality_rules.judge(keyed).where(~F.col("kept"))
    rejected = rejected.select(F.col("doc_id").alias(own_id), F.col("key").alias(own_key)).distinct()
    rejected = materialize(rejected, "rejected")
    same = (key == F.col(own_key)) & F.col("doc_id").eqNullSafe(F.col(own_id))
    return docs.join(small_side(rejected), same, "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id.

    Five words a shingle and a similarity of 0.8. Rows with a null id and blank
    texts are no one's duplicates and stay. An empty table stays empty.
    """
    return near_dedup.deduplicate(docs).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has.

    n_chars is counted anew where something went; a document stays even if nothing
    of it is left, and a null text comes back empty. An empty table stays empty.
    """
    cut = suffix_dedup.remove_repeats(docs.select(*COLUMNS))
    length = F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut.withColumn("n_chars", F.coalesce(length, F.col("n_chars"))).select(*COLUMNS)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Null and blank texts hold none and stay. An empty table stays empty.
    """
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of all documents, packed into batches by the tokens that op3 counts.

    A null, empty or blank document is one sequence without tokens, whose batch is null.
    Rows with one id are packed each on its own; ties go by id. An empty table packs to
    an empty one, and other columns are not read.
    """
    return packing.pack_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), packing.Packing(step=1))


STAGES = [
    ("quality rules", rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", passages),
    ("benchmark leaks", leaks),
    ("packing", batches),
]
# Connected components and byte spans over intermediate results: see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, stages: list = STAGES) -> DataFrame:
    """Apply all stages to the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in stages[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return stages[-1][1](spark, docs, sf_dir)
