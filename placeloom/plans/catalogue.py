"""All registered queries."""

from __future__ import annotations

from placeloom.plans import (  # noqa: F401  (importing registers the queries)
    cover_queries,
    linkage_queries,
    outbound_queries,
    place_queries,
    sweep_queries,
)
from placeloom.plans.registry import CHECKS, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def checks() -> dict[str, str]:
    return dict(CHECKS)
