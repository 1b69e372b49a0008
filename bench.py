"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the tables (default /root/testdata/sf0.1), BENCH_CPUS the
number of local cores (default 8).
"""

from __future__ import annotations

import json
import os
import time

from placeloom.plans import catalogue
from placeloom.session import build_session

HEADLINE = [
    "cover_disc",
    "capped_search_distance",
    "capped_search_popularity",
    "split_decision",
    "two_level_cover",
    "adaptive_cover",
    "normalize_payload",
    "latest_non_null",
    "upsert_snapshot",
    "prune_stale",
    "stream_upsert",
    "dataset_summary",
    "top_cities",
    "name_order_rank",
    "export_csv_roundtrip",
    "link_by_phone",
    "link_by_address",
    "link_waterfall",
    "miss_diagnosis",
    "outbound_batches",
    "mark_synced",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "placeloom-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    queries["dataset_summary"](spark, sf_dir).collect()  # start the JVM side once

    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall-clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
