"""Main text of pages: the query and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm import html_text
from placeloom.llm.registry import query, table

# For pages of the given tables: one article element of headings and paragraphs.
OP2_SQL = r"""
WITH inner_html AS (
  SELECT page_id, url, regexp_replace(
           regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '<[^>]*$', '') AS body
  FROM pages),
parts AS (
  SELECT page_id, url, string_split_regex(regexp_replace(body, '<br>', ' ', 'g'), '</?(p|h1)>') AS blocks
  FROM inner_html),
plain AS (
  SELECT page_id, url, list_filter(list_transform(blocks, lambda b:
    trim(regexp_replace(
      regexp_replace(replace(replace(replace(replace(replace(replace(
        regexp_replace(b, '<[^>]*>', '', 'g'),
        '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'),
        '&amp;?', '&', 'g'),
      '\s+', ' ', 'g'))), lambda b: b <> '') AS blocks
  FROM parts)
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text,
       length(array_to_string(blocks, chr(10)))::BIGINT AS n_chars
FROM plain
"""


@query("op2_html_text", OP2_SQL)
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
