"""Packing: the queries, and the SQL of the one that counts words."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from placeloom.llm import packing
from placeloom.llm.registry import query, table


def _levels(count: int) -> str:
    """SQL of the dynamic program, one common table per number of buckets.

    A state is a list: the padded length so far, then the ends chosen; the least
    list is the best state and, of equally good ones, the one with smaller ends.
    """
    levels = ["best1 AS (SELECT b, [16 * b * c, b] AS state FROM sums)"]
    for k in range(2, count + 1):
        levels.append(
            f"""best{k} AS (
  SELECT t.b, min(list_concat([p.state[1] + 16 * t.b * (t.c - s.c)], p.state[2:], [t.b])) AS state
  FROM best{k - 1} p JOIN sums s USING (b) JOIN sums t ON t.b > s.b GROUP BY t.b)"""
        )
    return ",\n".join(levels)


def _chosen(count: int) -> str:
    picks = " ".join(
        f"WHEN {k} THEN (SELECT state FROM best{k} ORDER BY b DESC LIMIT 1)" for k in range(1, count + 1)
    )
    return f"CASE (SELECT least(count(*), {count}) FROM sums) {picks} END"


OP5_SQL = rf"""
WITH sized AS (
  SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                                 lambda x: x <> '')) AS size
  FROM documents),
seqs AS (
  SELECT doc_id, piece, least(size - piece * 2048, 2048) AS n_tokens
  FROM (SELECT doc_id, size, unnest(range(0, greatest((size + 2047) // 2048, 1))) AS piece FROM sized)),
hist AS (SELECT ((n_tokens + 15) // 16)::BIGINT AS b, count(*) AS n FROM seqs WHERE n_tokens > 0 GROUP BY b),
sums AS (SELECT b, (sum(n) OVER (ORDER BY b))::BIGINT AS c FROM hist),
{_levels(8)},
picked AS (SELECT ({_chosen(8)})[2:] AS ends),
ends AS (SELECT unnest(ends) AS hi FROM picked),
buckets AS (
  SELECT coalesce(lag(hi) OVER (ORDER BY hi), 0) AS lo, hi, greatest(16384 // (16 * hi), 1) AS fits FROM ends),
filled AS (
  SELECT lo, hi, fits, sum(n) AS n FROM buckets JOIN hist ON b > lo AND b <= hi GROUP BY ALL),
offsets AS (
  SELECT *, coalesce(sum((n + fits - 1) // fits) OVER (
           ORDER BY hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS skip
  FROM filled),
ranked AS (
  SELECT doc_id, piece, n_tokens, hi, fits, skip,
         row_number() OVER (PARTITION BY hi ORDER BY (n_tokens + 15) // 16, doc_id, piece) - 1 AS r
  FROM seqs LEFT JOIN offsets ON (n_tokens + 15) // 16 > lo AND (n_tokens + 15) // 16 <= hi)
SELECT doc_id, piece::INTEGER AS piece, n_tokens::INTEGER AS n_tokens, (16 * hi)::INTEGER AS padded,
       CASE WHEN hi IS NOT NULL THEN (skip + r // fits)::BIGINT END AS batch,
       CASE WHEN hi IS NOT NULL THEN (r % fits)::INTEGER END AS slot
FROM ranked
"""


TOKENIZER = "word_bpe_49k.json"


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By tokens, and buckets by exact lengths."""
    rules = packing.Packing(max_tokens=2048, step=1, buckets=8, budget=16384)
    return packing.pack_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), rules)


@query("op5_word_packing", OP5_SQL)
def op5_word_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By words, under the name of tokens, so that SQL can follow."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op5_token_packing")
def op5_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By tokens, bucket ends at multiples of sixteen."""
    return packing.pack_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
