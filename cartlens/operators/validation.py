"""Row validation of the three input tables.

Statistics tag every row with the first check it fails (null when it passes all), so one scan counts every check.
Clean rows come from the same checks as plain filters, which file scans can use to skip data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.config import MAX_TIMESTAMP_MS, MIN_TIMESTAMP_MS, VALID_EVENTS
from cartlens.functions.columns import millis, require_columns

REASON = "reject_reason"

# Statistic names in report order, with the reject reason each one counts.
_EVENT_STATS = (
    ("nulls_removed", "null"),
    ("invalid_events", "event"),
    ("invalid_timestamps", "timestamp"),
    ("invalid_ids", "id"),
)
_PROPERTY_STATS = (("nulls_removed", "null"), ("invalid_timestamps", "timestamp"), ("invalid_ids", "id"))
_TREE_STATS = (("nulls_removed", "null"), ("invalid_ids", "id"))


def _first_failure(checks: list[tuple[str, Column]]) -> Column:
    reason = F.lit(None).cast("string")
    for name, passes in reversed(checks):
        reason = F.when(passes, reason).otherwise(F.lit(name))
    return reason


def _all_present(*columns: str) -> Column:
    present = F.lit(True)
    for name in columns:
        present = present & F.col(name).isNotNull()
    return present


def _in_bounds(column: str) -> Column:
    return F.col(column).between(F.lit(MIN_TIMESTAMP_MS), F.lit(MAX_TIMESTAMP_MS))


def _prepared(df: DataFrame, required: list[str], what: str) -> DataFrame:
    require_columns(df, required, what)
    return df.withColumn("timestamp", millis(df, "timestamp")) if "timestamp" in required else df


def _event_checks(events: DataFrame) -> list[tuple[str, Column]]:
    return [
        ("null", _all_present("user_id", "item_id", "timestamp", "event")),
        ("event", F.col("event").isin(*VALID_EVENTS)),
        ("timestamp", _in_bounds("timestamp")),
        ("id", (F.col("user_id") > 0) & (F.col("item_id") > 0)),
    ]


def _property_checks(properties: DataFrame) -> list[tuple[str, Column]]:
    return [
        ("null", _all_present("item_id", "property", "timestamp")),
        ("timestamp", _in_bounds("timestamp")),
        ("id", F.col("item_id") > 0),
    ]


def _tree_checks(tree: DataFrame) -> list[tuple[str, Column]]:
    positive = F.col("category_id") > 0
    if "parent_id" in tree.columns:
        positive = positive & (F.col("parent_id").isNull() | (F.col("parent_id") > 0))
    return [("null", _all_present("category_id")), ("id", positive)]


def _tag(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    return df.withColumn(REASON, _first_failure(checks))


def _clean(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Passing rows without whole-row duplicates. Plain conditions, so that file scans can skip what fails them."""
    for _, passes in checks:
        df = df.filter(passes)
    return df.distinct()


def _prepared_events(events: DataFrame) -> DataFrame:
    return _prepared(events, ["user_id", "item_id", "timestamp", "event"], "events")


def _prepared_properties(properties: DataFrame) -> DataFrame:
    return _prepared(properties, ["item_id", "property", "timestamp", "value"], "item properties")


def _prepared_tree(tree: DataFrame) -> DataFrame:
    return _prepared(tree, ["category_id"], "category tree")


def tag_events(events: DataFrame) -> DataFrame:
    return _tag(_prepared_events(events), _event_checks(events))


def tag_item_properties(properties: DataFrame) -> DataFrame:
    return _tag(_prepared_properties(properties), _property_checks(properties))


def tag_category_tree(tree: DataFrame) -> DataFrame:
    return _tag(_prepared_tree(tree), _tree_checks(tree))


def clean_events(events: DataFrame) -> DataFrame:
    return _clean(_prepared_events(events), _event_checks(events))


def clean_item_properties(properties: DataFrame) -> DataFrame:
    return _clean(_prepared_properties(properties), _property_checks(properties))


def clean_category_tree(tree: DataFrame) -> DataFrame:
    return _clean(_prepared_tree(tree), _tree_checks(tree))


def reject_stats(tagged: DataFrame, reasons: tuple[tuple[str, str], ...]) -> DataFrame:
    """(stat, n): initial rows, rows per failing check, duplicates, final rows.

    Rejected rows collapse to one per reason before the shuffle; only passing rows are grouped by their content.
    """
    content = [c for c in tagged.columns if c != REASON]
    kept = [F.when(F.col(REASON).isNull(), F.col(c)).alias(c) for c in content]
    groups = tagged.select(*kept, REASON).groupBy(*content, REASON).agg(F.count(F.lit(1)).alias("_copies"))
    passed = F.col(REASON).isNull()
    sums = [
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("initial_rows"),
        *[
            F.coalesce(F.sum(F.when(F.col(REASON) == reason, F.col("_copies"))), F.lit(0)).alias(stat)
            for stat, reason in reasons
        ],
        F.coalesce(F.sum(F.when(passed, F.col("_copies") - 1)), F.lit(0)).alias("duplicates_removed"),
        F.count(F.when(passed, F.lit(1))).alias("final_rows"),
    ]
    totals = groups.agg(*sums)
    return totals.unpivot([], totals.columns, "stat", "n").select("stat", F.col("n").cast("long").alias("n"))


def validate_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean events with millisecond timestamps, statistics)."""
    return clean_events(events), reject_stats(tag_events(events), _EVENT_STATS)


def validate_item_properties(properties: DataFrame) -> tuple[DataFrame, DataFrame]:
    return clean_item_properties(properties), reject_stats(tag_item_properties(properties), _PROPERTY_STATS)


def validate_category_tree(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    return clean_category_tree(tree), reject_stats(tag_category_tree(tree), _TREE_STATS)


def pass_percent(stats: DataFrame) -> DataFrame:
    """One row: final rows as a percentage of initial rows."""
    return stats.agg(
        F.max(F.when(F.col("stat") == "initial_rows", F.col("n"))).alias("initial_rows"),
        F.max(F.when(F.col("stat") == "final_rows", F.col("n"))).alias("final_rows"),
    ).withColumn(
        "pass_pct",
        F.when(F.col("initial_rows") > 0, F.col("final_rows") / F.col("initial_rows") * 100.0).otherwise(F.lit(0.0)),
    )
