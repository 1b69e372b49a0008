"""All registered queries of this subpackage."""

from __future__ import annotations

from placeloom.llm import (  # noqa: F401  (importing registers the queries)
    queries_clusters,
    queries_codec,
    queries_dedup,
    queries_leaks,
    queries_packing,
    queries_pages,
    queries_quality,
    queries_rules,
    queries_search,
    queries_tokens,
    queries_urls,
)
from placeloom.llm.registry import CHECKS, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def checks() -> dict[str, str]:
    return dict(CHECKS)
