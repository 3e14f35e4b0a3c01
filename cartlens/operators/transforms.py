"""Decay, filters and sampling of interactions, events and recommendations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.config import DAY_MS
from cartlens.functions.columns import millis
from cartlens.functions.ranking import top_per_group


def apply_time_decay(
    interactions: DataFrame, max_timestamp: int | None = None, decay_period_days: float = 14.0
) -> DataFrame:
    """rating * exp(-age in days / period), aged from the given or the latest time."""
    timed = interactions.withColumn("timestamp", millis(interactions, "timestamp"))
    newest = F.lit(max_timestamp) if max_timestamp is not None else timed.agg(F.max("timestamp")).scalar()
    age_days = (newest - F.col("timestamp")) / F.lit(float(DAY_MS))
    return timed.withColumn("rating", F.col("rating") * F.exp(-age_days / F.lit(float(decay_period_days))))


def filter_purchased_items(
    interactions: DataFrame, purchased: DataFrame | None, filter_mode: str = "exclude"
) -> DataFrame:
    """Drop bought pairs ("exclude"), or keep only them (any other mode)."""
    if purchased is None:
        raise ValueError("purchased pairs are required")
    how = "left_anti" if filter_mode == "exclude" else "left_semi"
    return interactions.join(purchased.select("user_id", "item_id"), ["user_id", "item_id"], how)


def subsample_views(
    events: DataFrame, max_views_per_user: int = 10, strategy: str = "last", seed: int = 42
) -> DataFrame:
    """At most n views per user, by time or by a seeded hash; other events stay, null event names go."""
    ties = [F.col("item_id")]
    orders: dict[str, Sequence[Column]] = {
        "last": [F.desc("timestamp"), *ties],
        "first": [F.asc("timestamp"), *ties],
        "random": [F.md5(F.concat_ws("|", F.lit(str(seed)), "user_id", "item_id", "timestamp"))],
    }
    if strategy not in orders:
        raise ValueError(f"unknown strategy: {strategy}")
    views = events.filter(F.col("event") == "view")
    sampled = top_per_group(views, ["user_id"], orders[strategy], max_views_per_user)
    return events.filter(F.col("event") != "view").unionByName(sampled)


def filter_purchased_categories(
    recs: DataFrame,
    purchased: DataFrame,
    metadata: DataFrame,
    heavy_category_ids: Sequence[int] | None = None,
) -> DataFrame:
    """Drop recommendations in categories the user bought from; uncategorised ones stay and ranks keep their gaps."""
    categories = metadata.select("item_id", "category_id")
    known = categories.filter(F.col("category_id").isNotNull())
    if heavy_category_ids:
        known = known.filter(F.col("category_id").isin(list(heavy_category_ids)))
    owned = purchased.select("user_id", "item_id").join(known, "item_id").select("user_id", "category_id").distinct()
    return (
        recs.join(categories, "item_id", "left")
        .join(owned, ["user_id", "category_id"], "left_anti")
        .select("user_id", "item_id", "rank")
    )
