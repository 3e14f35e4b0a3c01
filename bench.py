"""Headline queries at one scale: warm seconds per query, as one JSON line.

Each query first runs once on the smallest tables next to the benchmarked ones, which loads classes and compiles code,
then BENCH_RUNS times, of which the median is reported. Results go to Spark's no-op sink, so every row and column is
computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from cartlens.catalog import QUERIES
from cartlens.session import local_session

HEADLINE = [
    "events_clean",
    "events_validation_stats",
    "interactions_production",
    "item_metadata",
    "category_stats",
    "split_per_user_train",
    "split_global_test",
    "subsample_views_last",
    "matrix_coordinates",
    "top_popular_items",
    "popular_unseen_recommendations",
    "cold_fallback_by_category",
    "category_rerank_production",
    "diversity_constraint",
    "served_recommendations",
    "all_metrics",
    "ab_comparison",
    "business_rates_sliding",
    "latency_quantiles",
    "alerts_firing",
    "user_activity",
    "als_reranked_metrics",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    warm = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    warm = warm if os.path.isdir(warm) else folder
    spark = local_session(cores, app="cartlens-bench")

    def run(name: str, where: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds: dict[str, float] = {}
    for name in wanted:
        run(name, warm)
        seconds[name] = round(statistics.median(run(name, folder) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, warm, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cores": int(cores),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
