"""Benchmark decontamination: the query and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placeloom.llm import decontaminate
from placeloom.llm.registry import query, table


def _shingles(source: str, key: str) -> str:
    """SQL of the distinct runs of five words (fewer: the whole sequence)."""
    blank = r"[\x20\x09-\x0D]+"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    leads = ", ".join(f"lead(word, {k}) OVER run" for k in range(1, 5))
    return f"""
      SELECT DISTINCT {key}, shingle
      FROM (
        SELECT {key}, pos, count(*) OVER (PARTITION BY {key}) AS n, concat_ws(' ', word, {leads}) AS shingle
        FROM (
          SELECT {key}, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
          FROM (
            SELECT {key}, list_filter(regexp_split_to_array(
                     translate(coalesce(text, ''), '{upper}', '{lower}'), '{blank}'), lambda x: x <> '') AS ws
            FROM {source}))
        WINDOW run AS (PARTITION BY {key} ORDER BY pos))
      WHERE pos + 4 <= n OR (n < 5 AND pos = 1)"""


OP4_SQL = f"""
WITH d AS ({_shingles("documents", "doc_id")}),
b AS ({_shingles("benchmark", "item_id")}),
sizes AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY item_id),
hits AS (
  SELECT d.doc_id, b.item_id, count(*) AS matched FROM d JOIN b USING (shingle) GROUP BY ALL)
SELECT doc_id, item_id, item_shingles::INTEGER AS item_shingles, matched::INTEGER AS matched
FROM hits JOIN sizes USING (item_id)
WHERE 100 * matched >= 80 * item_shingles
"""


@query("op4_decontamination", OP4_SQL)
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.select("doc_id", "item_id", "item_shingles", "matched")
