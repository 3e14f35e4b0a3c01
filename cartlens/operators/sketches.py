"""Mergeable sketches, kept per window or day, so that a longer range is worked out without its rows.

Quantile sketches (KLL) hold about ``QUANTILE_SIZE`` values each: the rank of an answer is off by about 1 / QUANTILE_SIZE
times three. Distinct sketches (theta) are exact up to 2 ** DISTINCT_LOG2 values and off by about 2 / sqrt of that beyond.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.config import DAY_MS
from cartlens.functions.columns import millis

QUANTILE_SIZE = 800
DISTINCT_LOG2 = 12
LATENCY_QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def latency_sketches(log: DataFrame, width_s: int = 300) -> DataFrame:
    """(window_start_ms, requests, sketch): the latencies of every window."""
    known = log.filter(F.col("latency_s").isNotNull())
    windows = known.groupBy(F.window("ts", f"{width_s} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), F.kll_sketch_agg_double("latency_s", QUANTILE_SIZE).alias("sketch")
    )
    return windows.select(F.unix_millis("w.start").alias("window_start_ms"), "requests", "sketch")


def merged_quantiles(sketches: DataFrame, keys: Sequence, quantiles: Mapping[str, float] = LATENCY_QUANTILES) -> DataFrame:
    """Quantiles of all rows behind the sketches that share the keys."""
    together = sketches.groupBy(*keys).agg(F.sum("requests").alias("requests"), F.kll_merge_agg_double("sketch", QUANTILE_SIZE).alias("_all"))
    picked = [F.kll_sketch_get_quantile_double("_all", F.lit(float(q))).alias(name) for name, q in quantiles.items()]
    return together.select(*[c for c in together.columns if c != "_all"], *picked)


def audience_sketches(events: DataFrame, categories: DataFrame, span_days: int = 1) -> DataFrame:
    """(span, category_id, n_events, users, items): counts and distinct sketches per span of days and category.

    A sketch of few users costs more than the users themselves, so thin logs want longer spans.
    """
    known = categories.filter(F.col("category_id").isNotNull()).select("item_id", "category_id")
    # Repeats of a pair in one span combine before they meet the categories.
    span = F.floor(millis(events, "timestamp") / F.lit(span_days * DAY_MS)).alias("span")
    pairs = events.groupBy(span, "user_id", "item_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        pairs.join(known, "item_id")
        .groupBy("span", "category_id")
        .agg(
            F.sum("_n").alias("n_events"),
            F.theta_sketch_agg("user_id", DISTINCT_LOG2).alias("users"),
            F.theta_sketch_agg("item_id", DISTINCT_LOG2).alias("items"),
        )
    )


def save_spans(sketches: DataFrame, folder: str) -> None:
    """Replace the spans that the sketches hold and leave the others as they are, so a repeated span counts once."""
    writer = sketches.repartition("span").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("span").parquet(folder)


def audience(sketches: DataFrame) -> DataFrame:
    """(category_id, n_events, n_users, n_items) over all spans given; users and items are estimates."""
    together = sketches.groupBy("category_id").agg(
        F.sum("n_events").alias("n_events"),
        F.theta_sketch_estimate(F.theta_union_agg("users", DISTINCT_LOG2)).cast("long").alias("n_users"),
        F.theta_sketch_estimate(F.theta_union_agg("items", DISTINCT_LOG2)).cast("long").alias("n_items"),
    )
    return together.select("category_id", "n_events", "n_users", "n_items")
