"""URL filter: the query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placeloom.llm import url_filter
from placeloom.llm.registry import query, table

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query("op8_url_filter")
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = url_filter.train(url_filter.default_labels(spark))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, fitted, RULES).select("page_id", "host", "path", "rule", "verdict")
