"""Near-duplicates and repeated passages: the queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placeloom.llm import near_dedup, suffix_dedup
from placeloom.llm.registry import query, table

OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
runs AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id) AS n,
         concat_ws(' ', word, lead(word) OVER r, lead(word, 2) OVER r) AS shingle
  FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w)
  WINDOW r AS (PARTITION BY doc_id ORDER BY pos)),
sets AS (SELECT DISTINCT doc_id, shingle FROM runs WHERE pos + 2 <= n OR (n < 3 AND pos = 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n_both
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
  WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
ends AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reach.doc_id, ends.v FROM reach JOIN ends ON ends.u = reach.other)
SELECT d.doc_id, coalesce(any_value(sizes.n), 0)::BIGINT AS n_shingles, min(other) AS component_id,
       d.doc_id = min(other) AS kept
FROM documents d JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id)
GROUP BY d.doc_id
"""

RULES = near_dedup.MinHash(shingle=3, threshold=85)


@query("op1_near_dedup", OP1_SQL)
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), RULES)


# Bytes as pairs of hexadecimal digits.
OP7_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits, strlen(coalesce(text, '')) AS n FROM documents),
runs AS (
  SELECT doc_id, p, substr(digits, 2 * p + 1, 100) AS run
  FROM (SELECT doc_id, digits, unnest(range(0, greatest(n - 49, 0))) AS p FROM d)),
hits AS (
  SELECT doc_id, p FROM runs QUALIFY min(doc_id) OVER (PARTITION BY run) < doc_id),
marked AS (
  SELECT doc_id, p, p > coalesce(lag(p) OVER w + 50, -1) AS fresh
  FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
spans AS (
  SELECT doc_id, min(p) AS a, max(p) + 50 AS b
  FROM (SELECT doc_id, p, sum(fresh::INTEGER) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked)
  GROUP BY doc_id, k),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL
  SELECT doc_id, coalesce(max(b), 0), any_value(n) FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(digits, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS digits
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.digits)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""


@query("op7_suffix_dedup", OP7_SQL)
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
