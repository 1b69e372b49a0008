"""Ranked lexical search: the query and its SQL."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from placeloom.llm import ranked_search
from placeloom.llm.registry import query, table


def _terms(source: str, key: str) -> str:
    """SQL of all terms of a table's texts, with repeats."""
    low = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return f"SELECT {key}, unnest(regexp_extract_all({low}, '{term}')) AS term FROM {source}"


OP11_SQL = f"""
WITH d AS MATERIALIZED ({_terms("documents", "doc_id")}),
q AS MATERIALIZED (SELECT DISTINCT item_id, term FROM ({_terms("benchmark", "item_id")})),
sizes AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
held AS (SELECT doc_id, term, count(*) AS tf FROM d SEMI JOIN q USING (term) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM held, whole GROUP BY term, docs),
impacts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))) AS part
  FROM held JOIN weights USING (term) JOIN sizes USING (doc_id), whole),
scores AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM q JOIN impacts USING (term) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 50
"""


@query("op11_ranked_search", OP11_SQL)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = ranked_search.RankSettings(top=50, slope=50, saturation=20)
    return ranked_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), settings)
