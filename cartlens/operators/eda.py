"""Exploratory aggregates over events, properties and the category tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.config import DAY_MS
from cartlens.functions.columns import distinct_total, millis
from cartlens.functions.ranking import nearest_rank_quantiles

# Reported quantiles and the properties with a known meaning.
USER_QUANTILES = {"median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
ITEM_QUANTILES = {"median": 0.5, "p90": 0.9, "p99": 0.99}
SPECIAL_PROPERTIES = ("categoryid", "available")


def _all() -> Column:
    return F.count(F.lit(1))


def totals(events: DataFrame) -> DataFrame:
    return events.agg(_all().alias("n_events")).select(
        "n_events", distinct_total(events, "user_id").alias("n_users"), distinct_total(events, "item_id").alias("n_items")
    ).select(
        "*",
        (F.col("n_events") / F.col("n_users")).alias("events_per_user"),
        (F.col("n_events") / F.col("n_items")).alias("events_per_item"),
    )


def event_mix(events: DataFrame) -> DataFrame:
    counts = events.groupBy("event").agg(_all().alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row per event name
    return counts.withColumn("pct", F.col("n") / total * 100.0)


def calendar(events: DataFrame) -> DataFrame:
    """Events per calendar day with its parts."""
    moment = F.timestamp_millis(millis(events, "timestamp"))
    return events.groupBy(
        F.year(moment).alias("year"), F.month(moment).alias("month"), F.day(moment).alias("day")
    ).agg(_all().alias("n_events"))


def time_span(events: DataFrame) -> DataFrame:
    t = millis(events, "timestamp")
    return events.agg(F.min(t).alias("first_ms"), F.max(t).alias("last_ms")).withColumn(
        "days", F.floor((F.col("last_ms") - F.col("first_ms")) / F.lit(DAY_MS))
    )


def user_stats(events: DataFrame) -> DataFrame:
    """Events, items and event types per user, over (user, item) counts so repeats combine first.

    A pair carries the set of its event types, which has as many members as there are types.
    """
    pairs = events.groupBy("user_id", "item_id").agg(_all().alias("_c"), F.collect_set("event").alias("_e"))
    return pairs.groupBy("user_id").agg(
        F.sum("_c").alias("n_events"),
        F.count("item_id").alias("n_items"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.array_sort("_e"))))).cast("long").alias("n_event_types"),
    )


def item_stats(events: DataFrame) -> DataFrame:
    pairs = events.groupBy("item_id", "user_id").agg(_all().alias("_c"))
    return pairs.groupBy("item_id").agg(F.sum("_c").alias("n_events"), F.count("user_id").alias("n_users"))


def user_quantiles(events: DataFrame) -> DataFrame:
    return nearest_rank_quantiles(events.groupBy("user_id").agg(_all().alias("n")), "n", USER_QUANTILES)


def item_quantiles(events: DataFrame) -> DataFrame:
    return nearest_rank_quantiles(events.groupBy("item_id").agg(_all().alias("n")), "n", ITEM_QUANTILES)


def property_totals(properties: DataFrame) -> DataFrame:
    return properties.agg(_all().alias("n_rows")).select(
        "n_rows",
        distinct_total(properties, "item_id").alias("n_items"),
        distinct_total(properties, "property").alias("n_properties"),
    )


def _property_counts(properties: DataFrame) -> DataFrame:
    cells = properties.groupBy("property", "item_id").agg(_all().alias("_c"))
    return cells.groupBy("property").agg(F.sum("_c").alias("n"), F.count("item_id").alias("n_items"))


def top_properties(properties: DataFrame, k: int = 20) -> DataFrame:
    return _property_counts(properties).orderBy(F.desc("n"), F.asc("property")).limit(k)


def special_properties(properties: DataFrame) -> DataFrame:
    return _property_counts(properties.filter(F.col("property").isin(*SPECIAL_PROPERTIES)))


def _category_rows(properties: DataFrame) -> DataFrame:
    return (
        properties.filter(F.col("property") == "categoryid")
        .groupBy(F.col("value").cast("long").alias("category_id"))
        .agg(_all().alias("n_items"))
    )


def items_per_category(properties: DataFrame) -> DataFrame:
    """One row: median and maximum of property rows per category (history rows, not items)."""
    rows = _category_rows(properties)
    middle = nearest_rank_quantiles(rows, "n_items", {"median": 0.5})
    return rows.agg(_all().alias("n_categories"), F.max("n_items").alias("max")).select(
        "n_categories", F.lit(middle.scalar()).alias("median"), "max"
    )


def largest_categories(properties: DataFrame, k: int = 10) -> DataFrame:
    return _category_rows(properties).orderBy(F.desc("n_items"), F.asc("category_id")).limit(k)


def tree_summary(tree: DataFrame, levels: DataFrame) -> DataFrame:
    """One row: nodes, roots, deepest and mean level."""
    roots = tree.filter(F.col("parent_id").isNull()).agg(F.count_distinct("category_id").alias("n"))
    depth = levels.agg(F.max("level").alias("max_depth"), F.avg("level").alias("mean_depth"))
    return tree.agg(_all().alias("n_categories")).select(
        "n_categories",
        F.lit(roots.scalar()).alias("n_roots"),
        F.lit(depth.select("max_depth").scalar()).alias("max_depth"),
        F.lit(depth.select("mean_depth").scalar()).alias("mean_depth"),
    )


def level_histogram(levels: DataFrame) -> DataFrame:
    return levels.groupBy("level").agg(_all().alias("n"))


def metadata_coverage(events: DataFrame, properties: DataFrame) -> DataFrame:
    """One row: items in events, with properties, with categories, and the shared shares in percent.

    One aggregate per item over both tables replaces three intersections.
    """
    has_category = F.max((F.col("property") == "categoryid").cast("int"))
    described = properties.groupBy("item_id").agg(F.coalesce(has_category, F.lit(0)).alias("_cat"))
    used = events.select("item_id").distinct().withColumn("_used", F.lit(1))
    both = used.join(described, "item_id", "full")
    in_events, described_too = F.col("_used").isNotNull(), F.col("_cat").isNotNull()
    with_category = F.coalesce(F.col("_cat") == 1, F.lit(False))

    def n(condition: Column) -> Column:
        return F.count(F.when(condition, F.lit(1)))

    counted = both.agg(
        n(in_events).alias("items_in_events"),
        n(described_too).alias("items_with_properties"),
        n(in_events & described_too).alias("items_in_both"),
        n(with_category).alias("items_with_category"),
        n(in_events & with_category).alias("event_items_with_category"),
    )
    share = F.nullif("items_in_events", F.lit(0).cast("bigint"))
    return counted.select(
        "*",
        (F.col("items_in_both") / share * 100.0).alias("property_coverage_pct"),
        (F.col("event_items_with_category") / share * 100.0).alias("category_coverage_pct"),
    )


def event_coverage(events: DataFrame, categories: DataFrame) -> DataFrame:
    """One row: events whose item has a category, and their share in percent."""
    per_item = events.groupBy("item_id").agg(_all().alias("_n"))
    known = categories.filter(F.col("category_id").isNotNull()).select("item_id", "category_id")
    joined = per_item.join(known, "item_id", "left")
    return joined.agg(
        F.sum("_n").alias("n_events"),
        F.coalesce(F.sum(F.when(F.col("category_id").isNotNull(), F.col("_n"))), F.lit(0)).alias("n_with_category"),
    ).withColumn("pct", F.col("n_with_category") / F.col("n_events") * 100.0)


def top_categories(stats: DataFrame, k: int = 10) -> DataFrame:
    return stats.orderBy(F.desc("n_events"), F.asc("category_id")).limit(k)
