"""Run the headline queries and print one JSON line with their median times.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS``
the timed runs after one warm-up. Queries named as arguments replace the list.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from barograph.plans.queries import REGISTRY
from barograph.session import get_spark

HEADLINE = [
    "daily_series",
    "daily_by_type_region",
    "shipping_daily",
    "rolling_features",
    "ema_features",
    "burst_by_type",
    "seasonal_decomposition",
    "top_regions",
    "dedupe_keep_last",
    "clean_text",
    "text_metrics",
    "entities",
    "keywords_topn",
    "keyword_counts",
    "tfidf_top",
    "processed_alerts",
    "document_daily",
    "page_sections",
    "stream_hourly",
    "anomaly_scores",
    "forecast_7d",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_spark(
        "barograph-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    medians = {}
    for name in sys.argv[1:] or HEADLINE:
        once(name)
        medians[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(name, medians[name], file=sys.stderr, flush=True)
    total = round(sum(medians.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": medians, "sf": scale}))


if __name__ == "__main__":
    main()
