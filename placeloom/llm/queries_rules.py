"""Quality rules: the query and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placeloom.llm import quality_rules
from placeloom.llm.registry import query, table

_COMMON = ", ".join(f"'{word}'" for word in quality_rules.COMMON_WORDS)

OP9_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lang FROM documents),
w AS (
  SELECT doc_id, t, lang,
         list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM d),
wd AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
win AS (
  SELECT doc_id, pos, word AS a,
         lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS b,
         lead(word, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS c
  FROM wd),
twice AS (
  SELECT doc_id, pos FROM win WHERE c IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM twice) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT w.doc_id, t, lang, len(ws) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
found AS (
  SELECT *, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS upper_n,
         length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS digit_n,
         length(t) - length(regexp_replace(t, '[!"''()+,\-./:;=?@\[\\\]^_`{{}}~]', '', 'g')) AS mark_n
  FROM base),
bins AS (
  SELECT doc_id, lang, n_words, 'c' AS kind, unnest(range(1, 8))::VARCHAR AS bin,
         unnest([upper_n, digit_n, n_symbols, mark_n, length(t) - word_chars, strlen(t) - length(t),
                 word_chars - upper_n - digit_n - n_symbols - mark_n]) AS n
  FROM found
  UNION ALL
  SELECT b.doc_id, b.lang, b.n_words, 'w', k.bin, coalesce(h.n, 0)
  FROM base b CROSS JOIN (SELECT unnest([{_COMMON}, '']) AS bin) k
  LEFT JOIN (
    SELECT doc_id, CASE WHEN word IN ({_COMMON}) THEN word ELSE '' END AS bin, count(*) AS n
    FROM wd GROUP BY ALL) h ON h.doc_id = b.doc_id AND h.bin = k.bin),
shares AS (
  SELECT *, CASE WHEN sum(n) OVER (PARTITION BY doc_id, kind) > 0
            THEN n / sum(n) OVER (PARTITION BY doc_id, kind) ELSE 0.0 END AS share
  FROM bins),
refs AS (
  SELECT lang, kind, bin, avg(share) AS ref FROM shares WHERE n_words >= 100 AND lang IS NOT NULL
  GROUP BY ALL HAVING count(*) >= 20),
whole AS (SELECT kind, bin, avg(share) AS ref FROM shares WHERE n_words >= 100 GROUP BY ALL),
pairs AS (
  SELECT s.doc_id, s.kind, s.n_words, s.share AS p, coalesce(r.ref, a.ref) AS q
  FROM shares s JOIN whole a USING (kind, bin)
  LEFT JOIN refs r ON r.lang = s.lang AND r.kind = s.kind AND r.bin = s.bin),
dist AS (
  SELECT doc_id, kind, sqrt(greatest(sum(
    CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
    + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS js
  FROM pairs GROUP BY ALL),
far AS (
  SELECT doc_id, bool_or(kind = 'c' AND js > 0.30 OR kind = 'w' AND n_words >= 100 AND js > 0.26) AS far
  FROM dist JOIN base USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(far, false) AS kept
FROM base LEFT JOIN far USING (doc_id)
"""


@query("op9_quality_rules", OP9_SQL)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
