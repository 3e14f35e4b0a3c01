"""Exploratory aggregates."""

from pyspark.sql import functions as F

from cartlens.catalog.files import new_folder
from cartlens.catalog.registry import query
from cartlens.operators import eda, features, sketches


@query(
    "event_totals",
    """
SELECT count(*) AS n_events, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items,
       round(count(*) / count(DISTINCT user_id)::DOUBLE, 6) AS events_per_user,
       round(count(*) / count(DISTINCT item_id)::DOUBLE, 6) AS events_per_item FROM clean_events""",
)
def _(s):
    return eda.totals(s.events)


@query(
    "event_mix",
    """
SELECT event, count(*) AS n, round(count(*) / (SELECT count(*) FROM clean_events)::DOUBLE * 100.0, 6) AS pct
FROM clean_events GROUP BY 1""",
)
def _(s):
    return eda.event_mix(s.events)


@query(
    "event_calendar",
    """
SELECT CAST(year(t) AS INTEGER) AS year, CAST(month(t) AS INTEGER) AS month, CAST(day(t) AS INTEGER) AS day, count(*) AS n_events
FROM (SELECT make_timestamp(timestamp * 1000) AS t FROM clean_events) GROUP BY ALL""",
)
def _(s):
    return eda.calendar(s.events)


@query(
    "event_time_span",
    """
SELECT min(timestamp) AS first_ms, max(timestamp) AS last_ms, (max(timestamp) - min(timestamp)) // 86400000 AS days
FROM clean_events""",
)
def _(s):
    return eda.time_span(s.events)


@query(
    "user_activity",
    """
SELECT user_id, count(*) AS n_events, count(DISTINCT item_id) AS n_items, count(DISTINCT event) AS n_event_types
FROM clean_events GROUP BY 1""",
)
def _(s):
    return eda.user_stats(s.events)


@query("item_activity", "SELECT item_id, count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM clean_events GROUP BY 1")
def _(s):
    return eda.item_stats(s.events)


def _quantiles(key: str, quantiles) -> str:
    picks = ", ".join(f"max(n) FILTER (r = round({q}::DOUBLE * (total - 1))) AS {name}" for name, q in quantiles.items())
    return f"""
SELECT {picks} FROM (SELECT n, row_number() OVER (ORDER BY n) - 1 AS r, count(*) OVER () AS total
                     FROM (SELECT count(*) AS n FROM clean_events GROUP BY {key}))"""


@query("user_activity_quantiles", _quantiles("user_id", eda.USER_QUANTILES))
def _(s):
    return eda.user_quantiles(s.events)


@query("item_activity_quantiles", _quantiles("item_id", eda.ITEM_QUANTILES))
def _(s):
    return eda.item_quantiles(s.events)


@query(
    "property_totals",
    """
SELECT count(*) AS n_rows, count(DISTINCT item_id) AS n_items, count(DISTINCT property) AS n_properties FROM clean_properties""",
)
def _(s):
    return eda.property_totals(s.properties)


_PROPERTIES = "SELECT property, count(*) AS n, count(DISTINCT item_id) AS n_items FROM clean_properties GROUP BY 1"


@query("top_properties", f"{_PROPERTIES} ORDER BY n DESC, property LIMIT 20")
def _(s):
    return eda.top_properties(s.properties)


@query("special_properties", f"SELECT * FROM ({_PROPERTIES}) WHERE property IN ('categoryid', 'available')")
def _(s):
    return eda.special_properties(s.properties)


_CATEGORY_ROWS = "SELECT CAST(value AS BIGINT) AS category_id, count(*) AS n_items FROM clean_properties WHERE property = 'categoryid' GROUP BY 1"


@query(
    "items_per_category",
    f"""
SELECT count(*) AS n_categories, max(n_items) FILTER (r = round(0.5::DOUBLE * (total - 1))) AS median, max(n_items) AS max
FROM (SELECT n_items, row_number() OVER (ORDER BY n_items) - 1 AS r, count(*) OVER () AS total FROM ({_CATEGORY_ROWS}))""",
)
def _(s):
    return eda.items_per_category(s.properties)


@query("largest_categories", f"{_CATEGORY_ROWS} ORDER BY n_items DESC, category_id LIMIT 10")
def _(s):
    return eda.largest_categories(s.properties)


@query(
    "category_tree_summary",
    """
SELECT count(*) AS n_categories, count(DISTINCT category_id) FILTER (parent_id IS NULL) AS n_roots,
       max(level) AS max_depth, round(avg(level), 6) AS mean_depth FROM tree_levels""",
)
def _(s):
    return eda.tree_summary(s.tree, features.category_levels(s.tree))


@query("category_level_histogram", "SELECT level, count(*) AS n FROM tree_levels GROUP BY 1")
def _(s):
    return eda.level_histogram(features.category_levels(s.tree))


@query(
    "metadata_coverage",
    """
WITH e AS (SELECT DISTINCT item_id FROM clean_events), p AS (SELECT DISTINCT item_id FROM clean_properties),
c AS (SELECT DISTINCT item_id FROM clean_properties WHERE property = 'categoryid'),
t AS (SELECT (SELECT count(*) FROM e) AS items_in_events, (SELECT count(*) FROM p) AS items_with_properties,
             (SELECT count(*) FROM (SELECT * FROM e INTERSECT SELECT * FROM p)) AS items_in_both,
             (SELECT count(*) FROM c) AS items_with_category,
             (SELECT count(*) FROM (SELECT * FROM e INTERSECT SELECT * FROM c)) AS event_items_with_category)
SELECT *, round(items_in_both / items_in_events::DOUBLE * 100.0, 6) AS property_coverage_pct,
       round(event_items_with_category / items_in_events::DOUBLE * 100.0, 6) AS category_coverage_pct FROM t""",
)
def _(s):
    return eda.metadata_coverage(s.events, s.properties)


@query(
    "event_category_coverage",
    """
SELECT count(*) AS n_events, count(category_id) AS n_with_category, round(count(category_id) / count(*)::DOUBLE * 100.0, 6) AS pct
FROM clean_events LEFT JOIN item_categories USING (item_id)""",
)
def _(s):
    return eda.event_coverage(s.events, s.categories)


@query(
    "top_categories_by_events",
    "SELECT category_id, n_events, n_users, n_items FROM cat_stats ORDER BY n_events DESC, category_id LIMIT 10",
)
def _(s):
    return eda.top_categories(features.category_stats(s.events, s.categories))


@query(
    "category_audience_from_sketches",
    "SELECT category_id, n_events, true AS users_near, true AS items_near FROM cat_stats",
)
def _(s):
    """Users and items of categories from monthly sketches, saved in two halves and the second one twice, within 5 %."""
    folder, events = new_folder(s, "audience"), s.stored_events
    early = F.floor(F.col("timestamp") / (30 * 86_400_000)) % 2 == 0
    for half in (early, ~early, ~early):
        sketches.save_spans(sketches.audience_sketches(events.filter(half), s.categories, span_days=30), folder)
    found = sketches.audience(s.spark.read.parquet(folder))
    exact = s.category_stats.select("category_id", F.col("n_users").alias("u"), F.col("n_items").alias("i"))
    near = lambda a, b: (F.abs(F.col(a) - F.col(b)) <= F.col(b) * 0.05)
    return found.join(exact, "category_id").select("category_id", "n_events", near("n_users", "u").alias("users_near"), near("n_items", "i").alias("items_near"))
